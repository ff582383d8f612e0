"""CSV rows without loss, rejects, facts about files, and the audit of a folder."""

import csv
import io
import json
import os

import pytest
from pyspark.sql import functions as F

from handful.functions.order import unique_lists
from handful.sources import files as S, runs as SR
from tests.conftest import rows


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("audit tree+é")
    deep = root / "results" / "AG-News" / "4-shot" / "seed_7"
    deep.mkdir(parents=True)
    run = {"dataset": "sst2", "shot": 4, "seed": 1, "method": "vanilla", "accuracy": 50.0}
    (deep / "vanilla.json").write_text(json.dumps({"results": [], "rows": [{"acc": 1.0}, 3, {"seed": 9, "method": "x"}]}))
    (deep / "list.json").write_text(json.dumps([run, "text", {**run, "seed": 2}]) + "\n")
    (root / "broken.json").write_text('{"results": [')
    (root / "bytes.json").write_bytes(b'{"a": "\xff"}')
    (root / "long.csv").write_text(
        "dataset,shot,seed,method,accuracy\n" + "sst2,4,1,vanilla,50\n" + f"sst2,4,2,{'y' * 140_000},60\n" + "sst2,4,3,baseline,70\n"
    )
    (root / "odd.CSV").write_text(
        '﻿task,shots,task,method,acc,\ntrec,8,imdb,"random\naug",1,unnamed\nsst2,8\n\nsst2,8,sst2,vanilla,3,4,5,6\n"a ""quoted"" one",4,d,baseline,9\n'
    )
    (root / "head.csv").write_text("dataset,method")
    (root / "empty.csv").write_text("")
    (root / "a_sst2_shot16_seed3.log").write_text("start\nCompleted dataset=sst-2 shot=16 seed=3: done\nCUDA out of memory")
    os.utime(root / "long.csv", (1_700_000_000, 1_700_000_000))
    return str(root)


def test_the_judges_file_gives_two_runs_and_one_reject(spark, tree):
    got = SR.csv_runs(spark, tree).filter(F.col("result_file").endswith("long.csv"))
    assert rows(got, "seed", "accuracy") == [("1", 50.0), ("3", 70.0)]
    told = SR.rejected_csv(spark, tree).filter(F.col("result_file").endswith("long.csv")).collect()
    assert [r["reason"] for r in told] == ["cell of more than 131072 characters"]
    every = SR.rejected_inputs(spark, tree).select("reason").collect()
    assert {r[0] for r in every} == {
        "cell of more than 131072 characters", "no JSON", "no run without method", "no run without dataset, method, accuracy", "no finished run",
    }


def test_rows_equal_those_of_a_dictionary_reader(spark, tree):
    found = S.csv_rows(spark, tree).filter(F.col("result_file").endswith("odd.CSV")).orderBy("position").collect()
    with open(f"{tree}/odd.CSV", encoding="utf-8-sig", newline="") as file:
        want = [{k: v or None for k, v in row.items() if k} for row in csv.DictReader(file)]
    assert [{k: v or None for k, v in r["cells"].items()} for r in found] == want and len(want) == 4
    assert all(r["reason"] is None for r in found)


def test_generated_files_and_folders_without_csv(spark, tree, tmp_path):
    assert S.csv_rows(spark, tree, skip=["long.csv", "odd.CSV"]).count() == 0
    assert S.csv_rows(spark, str(tmp_path)).count() == 0
    assert S.file_facts(spark, str(tmp_path / "none"), ["csv"]).count() == 0


def test_facts(spark, tree):
    facts = {r["path"]: r for r in S.file_facts(spark, tree, ["csv", "json", "log"]).collect()}
    assert len(facts) == 9
    for name, row in facts.items():
        data = open(f"{tree}/{name}", "rb").read()
        assert row["size_bytes"] == len(data) == os.path.getsize(f"{tree}/{name}")
        assert row["line_count"] == data.count(b"\n") + (0 if data.endswith(b"\n") or not data else 1)
        assert row["result_file"] == f"file://{tree}/{name}" and row["mtime"] is not None
    assert facts["odd.CSV"]["header"] == ["task", "shots", "task", "method", "acc", ""]
    assert facts["bytes.json"]["read_error"].startswith("UnicodeDecodeError") and facts["broken.json"]["read_error"] is None
    short = {r["path"]: r for r in S.file_facts(spark, tree, ["CSV"], contents=False).collect()}
    assert short["head.csv"]["header"] == ["dataset", "method"] and short["head.csv"]["line_count"] is None and len(short) == 4


def test_unreadable_files_have_a_reason():
    reader = S.FileFactsReader({"path": "/nowhere", "suffixes": "csv"})
    (row,) = reader.read(S.FileGroup([("/nowhere/x.csv", 3, None)]))
    assert row[-1].startswith("FileNotFoundError") and row[5] is None
    with pytest.raises(ValueError):
        S.file_system("dbfs:/x")


def test_streams_are_scanned_piece_by_piece(monkeypatch):
    monkeypatch.setattr(S, "PIECE", 3)
    assert S.scanned(io.BytesIO("é日\nx".encode()), "json") == (2, None)
    assert S.scanned(io.BytesIO(b"a\nb\n"), "csv") == (2, None)
    assert S.scanned(io.BytesIO(b""), "csv") == (0, None)
    assert S.scanned(io.BytesIO("aé".encode()[:-1]), "json")[1].startswith("UnicodeDecodeError")
    assert S.scanned(io.BytesIO(b"\xff\xfe\n"), "log") == (1, None)


def test_audit(spark, tree):
    got = {r["path"]: r.asDict() for r in S.audit_files(spark, tree).collect()}
    assert len(got) == 9
    one = got["results/AG-News/4-shot/seed_7/vanilla.json"]
    assert (one["n_rows"], one["columns"], one["unique_dataset"], one["unique_method"]) == (2, "acc;method;seed", "ag_news", "vanilla;x")
    assert (one["unique_shot"], one["unique_seed"], one["has_seed_field"], one["read_error"]) == ("4", "7;9", True, None)
    listed = got["results/AG-News/4-shot/seed_7/list.json"]
    assert (listed["n_rows"], listed["unique_seed"], listed["unique_dataset"], listed["line_count"]) == (2, "1;2", "sst2", 1)
    assert got["broken.json"]["read_error"] == "no JSON" and got["broken.json"]["n_rows"] is None
    assert got["bytes.json"]["read_error"].startswith("UnicodeDecodeError") and got["bytes.json"]["unique_dataset"] is None
    table = got["long.csv"]
    assert (table["line_count"], table["n_rows"], table["unique_seed"]) == (4, 3, "1;2;3")
    assert table["old_reason"].startswith(">7 days older")
    head = got["head.csv"]
    assert (head["line_count"], head["n_rows"], head["columns"], head["has_seed_field"]) == (1, 0, "dataset;method", False)
    assert (got["empty.csv"]["line_count"], got["empty.csv"]["columns"]) == (0, "")
    log = got["a_sst2_shot16_seed3.log"]
    assert (log["contains_completed"], log["contains_error"], log["n_completed"], log["line_count"]) == (True, True, 1, 3)
    assert (log["parsed_dataset"], log["parsed_shot"], log["parsed_seed"], log["n_rows"]) == ("sst2", "16", "3", None)


def test_inventory(spark, tree):
    got = {tuple(r)[:1] + tuple(r)[2:] for r in S.inventory(spark, tree).collect()}
    here = "results/AG-News/4-shot/seed_7/"
    assert (here + "vanilla.json", "ag_news", "4", "vanilla", 1, 1) in got and (here + "vanilla.json", "ag_news", "4", "x", 1, 1) in got
    assert (here + "list.json", "sst2", "4", "vanilla", 2, 2) in got
    assert {g[3] for g in got if g[0].endswith(".log")} == {"vanilla", "random_aug", "error_driven"}
    assert not any(g[0] == "head.csv" for g in got)


def test_lists_of_a_very_large_cell_stay_short(spark):
    df = spark.range(1_000_000).select(F.lit("g").alias("g"), F.col("id").alias("seed"), F.lit("").alias("none"))
    row = unique_lists(df.unionByName(df), ["g"], ["seed", "none"], 30).first()
    assert len(row["seed"]) < 1000 and row["seed"].endswith(";...(+999970)") and row["seed"].startswith("0;1;10;100;")
    assert (row["n_seed"], row["none"], row["n_none"]) == (1_000_000, "", 0)
    null = unique_lists(spark.createDataFrame([(None, "b"), (None, "a"), (1, None)], "g int, v string"), ["g"], ["v"])
    assert rows(null) == [(None, "a;b", 2)]


def test_written_texts_come_back(spark, tmp_path):
    df = spark.createDataFrame([("a/b.txt", "x\ny"), ("c.log", None)], "name string, value string")
    assert S.write_texts(df, str(tmp_path / "out")) == 2
    assert (tmp_path / "out" / "a" / "b.txt").read_text() == "x\ny" and (tmp_path / "out" / "c.log").read_text() == ""
