import json
import statistics

import pytest
from pyspark.sql import functions as F

from handful.operators import runs as R
from handful.sources import runs as SR
from tests.conftest import rows

# One published cell: accuracies and macro F1 of five seeds per method.
ACCURACY = {
    "vanilla": [77.84210526315789, 76.5657894736842, 78.78947368421053, 79.52631578947368, 80.76315789473684],
    "random_aug": [62.17105263157895, 64.76315789473685, 50.31578947368421, 66.82894736842105, 69.52631578947368],
    "error_driven": [57.88157894736842, 63.71052631578947, 57.56578947368421, 66.34210526315789, 64.89473684210526],
}
MEANS = {"vanilla": (78.69736842105263, 1.599861489849544), "random_aug": (62.72105263157895, 7.442272061333356), "error_driven": (62.07894736842105, 4.08508663622753)}


@pytest.fixture(scope="module")
def runs(spark):
    data = [
        ("ag_news", 4, seed, method, value, value - 1.0)
        for method, values in ACCURACY.items()
        for seed, value in enumerate(values)
    ] + [("ag_news", 8, 0, "vanilla", 82.0, None)]
    return spark.createDataFrame(data, "dataset string, sample_size int, seed int, method string, accuracy double, macro_f1 double").withColumn(
        "iteration", F.lit(None).cast("int")
    )


def test_compare_gives_the_published_cell(runs):
    row = R.compare(runs).filter("sample_size = 4").first()
    assert row["n_runs"] == 5
    for method, (mean, std) in MEANS.items():
        assert row[f"{method}_accuracy_mean"] == pytest.approx(mean, abs=1e-9)
        assert row[f"{method}_accuracy_std"] == pytest.approx(std, abs=1e-9)
    assert row["error_driven_vs_random_aug_accuracy_delta"] == pytest.approx(-0.6421052631579016, abs=1e-9)


def test_summary_of_a_single_run(runs):
    row = R.summarize(runs).filter("sample_size = 8").first()
    assert (row["n_runs"], row["accuracy_std"], row["macro_f1_mean"], row["macro_f1_std"]) == (1, 0.0, None, None)
    assert row["delta_random_aug_vs_vanilla"] is None


def test_metrics_and_scaling(runs):
    long = {(r["sample_size"], r["method"], r["metric"]): r for r in R.metrics_long(runs).collect()}
    assert long[4, "vanilla", "accuracy"]["std"] == pytest.approx(statistics.stdev(ACCURACY["vanilla"]))
    step = R.shot_scaling(runs).collect()
    assert [(r["from_shot"], r["to_shot"], r["method"]) for r in step] == [(4, 8, "vanilla")]
    assert step[0]["mean_accuracy_delta"] == pytest.approx(82.0 - MEANS["vanilla"][0])


def test_deviations_are_not_mixed(spark):
    scores = spark.createDataFrame([("d", 4, s, 1.0 * s, "m") for s in range(4)], "dataset string, sample_size int, seed int, score double, measure string")
    row = R.score_table(scores, [4]).filter("dataset = 'd'").first()
    assert row["4_std"] == pytest.approx(statistics.pstdev([0, 1, 2, 3]))
    box = R.box_stats(scores, ["dataset"]).first()
    assert tuple(box)[1:] == (0.0, 0.75, 1.5, 2.25, 3.0)


def test_average_row_is_a_mean_of_means(spark):
    data = [("a", 4, 1.0), ("a", 4, 3.0), ("a", 4, 5.0), ("b", 4, 11.0)]
    scores = spark.createDataFrame(data, "dataset string, sample_size int, score double").withColumn("measure", F.lit("m"))
    assert R.score_table(scores, [4]).filter("dataset = 'Average'").first()["4_avg"] == 7.0


def test_dedupe_prefers_files_other_than_csv(spark):
    data = [("x", 4, 1, None, "", "vanilla", v, f, 0) for v, f in ((1.0, "a.csv"), (2.0, "b.json"), (3.0, "c.json"), (4.0, "d.csv"))]
    data.append(("x", 4, None, 7, "", "vanilla", 9.0, "e.csv", 0))
    df = spark.createDataFrame(data, "dataset string, sample_size int, seed int, iteration int, split string, method string, accuracy double, result_file string, position int")
    assert sorted(r["accuracy"] for r in R.dedupe_runs(df).collect()) == [2.0, 9.0]


def test_missing_and_pending(spark):
    data = [("d", 4, s, m) for m, n in (("vanilla", 3), ("random_aug", 3), ("augmented", 2)) for s in range(n)]
    df = spark.createDataFrame(data, "dataset string, sample_size int, seed int, method string")
    assert rows(R.missing_runs(df)) == [("d", 4, "augmented", 2, 3, "0;1")]
    assert rows(R.pending_runs(df.select("dataset", "sample_size", "seed").distinct(), df)) == [("d", 4, 2)]
    assert rows(R.seed_coverage(df, [3, 4])) == [("d", 4, 3, True, False)]


def test_per_class_delta_keeps_both_sides(spark):
    data = [("r", "vanilla", "a", 50.0), ("r", "vanilla", "b", 10.0), ("r", "error_driven", "a", 75.0), ("r", "error_driven", "c", 1.0)]
    df = spark.createDataFrame(data, "run string, method string, label string, accuracy double")
    got = [r[2:] for r in rows(R.per_class_delta(df, ["run"]).filter("method = 'error_driven'").fillna(-1.0))]
    assert got == [("a", 25.0), ("b", -1.0), ("c", -1.0)]


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("results")
    run = {"dataset": "sst2", "shot": 4, "seed": 1, "method": "vanilla", "accuracy": 50.0, "macro_f1": 40.0}
    deep = root / "sst2" / "4-shot" / "seed-1"
    deep.mkdir(parents=True)
    (deep / "vanilla.json").write_text(json.dumps({**run, "improvement_delta": {"per_class_accuracy_delta": {"0": 1.5}}}))
    (deep / "augmented.json").write_text(json.dumps({**run, "method": "", "accuracy": "60.5"}))
    (root / "broken.json").write_text('{"results": [')
    (root / "nested.json").write_text(json.dumps({"results": {"items": [[{**run, "seed": 2, "method": "Random Aug"}], {"x": 1}]}}))
    (root / "useless.json").write_text(json.dumps([{"dataset": "d"}, 3, "text", {"metrics": {**run, "seed": 3, "accuracy": "bad"}}]))
    (root / "lines.jsonl").write_text(json.dumps({**run, "seed": 4}) + "\n\nnot json\n" + json.dumps({"runs": [{**run, "seed": 5}]}) + "\n")
    (root / "own.csv").write_text("﻿task,shots,iter,method,acc,macro_f1_score\nsst2,8,3,baseline,70,\nsst2,,3,baseline,70,\nsst2,8,4,unknown,70,1\n")
    (root / "raw_results.csv").write_text("dataset,sample_size,seed,method,accuracy\nsst2,4,9,vanilla,1\n")
    (root / "run.log").write_text(
        "x\nCompleted dataset=trec shot=16 seed=7: vanilla=1.5, random=-2, error-driven=3.25\nRuntimeError: no\nCompleted dataset=trec shot=16 seed=8: failed\n"
    )
    return str(root)


def test_read_runs(spark, tree):
    got = SR.read_runs(spark, tree).select("dataset", "sample_size", "seed", "method", "accuracy").collect()
    want = [
        ("sst2", "4", "1", "vanilla", 50.0), ("sst2", "4", "1", "error_driven", 60.5), ("sst2", "4", "2", "random_aug", 50.0),
        ("sst2", "4", "4", "vanilla", 50.0), ("sst2", "4", "5", "vanilla", 50.0), ("sst2", "8", None, "vanilla", 70.0),
        ("trec", "16", "7", "vanilla", 1.5), ("trec", "16", "7", "random_aug", -2.0), ("trec", "16", "7", "error_driven", 3.25),
    ]
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want))


def test_rejects_and_logs(spark, tree):
    texts = SR.read_texts(spark, tree, "*.json")
    assert [r[0].rsplit("/", 1)[1] for r in SR.rejected_json(texts).select("result_file").collect()] == ["broken.json"]
    status = SR.log_status(SR.read_texts(spark, tree, "*.log")).first()
    assert (status["line_count"], status["contains_completed"], status["contains_error"]) == (4, True, True)
    assert status["completed_runs"] == ["trec:16:7", "trec:16:8"]


def test_records_and_files(spark, tree):
    records = SR.read_records(spark, tree)
    # a container that is an object is not searched for full records
    assert records.count() == 2
    flat = records.select(F.col("source_file").alias("result_file"), "record")
    files = {r["result_file"].rsplit("/", 1)[1]: r for r in SR.run_files(SR.audit_records(flat)).collect()}
    assert files["vanilla.json"]["unique_dataset"] == ["sst2"] and files["vanilla.json"]["has_seed_field"]
    # a blank method is taken from the file name
    assert files["augmented.json"]["unique_method"] == ["augmented"]
    targets = SR.file_targets(spark, tree)
    assert targets.filter("size_bytes > 0 and mtime is not null").count() == targets.count() >= 8


def test_write_runs(spark, runs, tmp_path):
    path = str(tmp_path / "out")
    SR.write_runs(runs.limit(1), path, R.RAW_FIELDS)
    lines = [r[0] for r in spark.read.text(path).collect()]
    assert lines[0] == ",".join(R.RAW_FIELDS) and lines[1].count(",") == len(R.RAW_FIELDS) - 1 and ",," in lines[1]


def test_stale_files(spark):
    data = [("results/a.json", "2024-01-10 00:00:00"), ("scripts/results/b.json", "2024-01-02 00:00:00"), ("tmp/c.json", "2024-01-09 00:00:00")]
    df = spark.createDataFrame(data, "path string, m string").select("path", F.col("m").cast("timestamp").alias("mtime"))
    got = dict(rows(R.stale_files(df), "path", "old_reason"))
    assert got["results/a.json"] == "" and got["tmp/c.json"] == "temporary path"
    assert got["scripts/results/b.json"] == "under scripts/results; >7 days older than newest scanned result"


def test_latencies(spark):
    values = [0.01 * (i * i % 97) for i in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "latency_s double")
    row = R.latency_stats(df).first()
    ordered = sorted(values)
    place = 0.95 * 199
    low = ordered[int(place)]
    want = low + (place - int(place)) * (ordered[int(place) + 1] - low)
    assert row["p95_s"] == pytest.approx(want) and row["std_s"] == pytest.approx(statistics.pstdev(values))
    assert row["mean_s"] == pytest.approx(statistics.mean(values)) and row["total_s"] == pytest.approx(sum(values))
    one = R.latency_stats(spark.createDataFrame([(2.0,)], "latency_s double")).first()
    assert (one["p95_s"], one["std_s"]) == (2.0, 0.0)
