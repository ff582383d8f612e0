"""Run analytics over run rows that are grouped out of the order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import big, documents, r6, register, table
from handful.functions import cells as L, text as X
from handful.functions.order import unique_lists
from handful.operators import runs as R
from handful.sources import files as SF, runs as SR
from handful.session import shared_path

# Runs: the flag gives the dataset, supplier the seed, line number the size, part the method.
_RUN_ROWS = """run_rows AS (
    SELECT CASE l_returnflag WHEN 'A' THEN 'ag_news' WHEN 'N' THEN 'sst2' ELSE 'trec' END AS dataset,
           CASE l_linenumber % 3 WHEN 0 THEN 4 WHEN 1 THEN 8 ELSE 16 END AS sample_size, l_suppkey AS seed,
           l_linestatus AS split,
           CASE WHEN l_partkey % 3 = 2 THEN 'error_driven' WHEN l_partkey % 3 = 1 AND l_quantity > 40 THEN 'random_aug' ELSE 'vanilla' END AS method, l_discount, l_tax, l_quantity
    FROM lineitem)"""
_RUNS = f"""{_RUN_ROWS},
    runs AS (SELECT dataset, sample_size, seed, split, method, 100 * avg(CAST(l_discount <= 0.05 AS INTEGER)) AS accuracy,
                    100 * avg(CAST(l_tax <= 0.04 AS INTEGER)) AS macro_f1
             FROM run_rows GROUP BY 1, 2, 3, 4, 5)"""
# The runs of each split as a dataset of its own.
_SPLITS = f"""{_RUNS}, by_split AS (SELECT * REPLACE (dataset || '-' || split AS dataset) FROM runs)"""


def run_rows(spark, sf):
    dataset = F.when(F.col("l_returnflag") == "A", "ag_news").when(F.col("l_returnflag") == "N", "sst2").otherwise("trec")
    size = F.when(F.col("l_linenumber") % 3 == 0, 4).when(F.col("l_linenumber") % 3 == 1, 8).otherwise(16)
    method = (
        F.when(F.col("l_partkey") % 3 == 2, "error_driven")
        .when((F.col("l_partkey") % 3 == 1) & (F.col("l_quantity") > 40), "random_aug")
        .otherwise("vanilla")
    )
    return table(spark, sf, "lineitem").select(
        dataset.alias("dataset"),
        size.alias("sample_size"),
        F.col("l_suppkey").alias("seed"),
        F.col("l_linestatus").alias("split"),
        method.alias("method"),
        "l_discount",
        "l_tax",
        "l_quantity",
    )


def runs(spark, sf):
    return (
        run_rows(spark, sf)
        .groupBy("dataset", "sample_size", "seed", "split", "method")
        .agg(
            (100 * F.avg((F.col("l_discount") <= 0.05).cast("int"))).alias("accuracy"),
            (100 * F.avg((F.col("l_tax") <= 0.04).cast("int"))).alias("macro_f1"),
        )
        .withColumn("iteration", F.lit(None).cast("bigint"))
    )


def runs_by_split(spark, sf):
    return runs(spark, sf).withColumn("dataset", F.concat_ws("-", "dataset", "split"))


def _rounded(df, *keys):
    return df.select(*keys, *[r6(c).alias(c) for c, t in df.dtypes if c not in keys and t == "double"])


# Copies of every run in three files, the CSV first in half of them.
_COPIES = f"""{_RUNS},
    copies AS (SELECT *, i AS position, CASE WHEN i = 0 AND seed % 2 = 0 THEN 'a.csv' WHEN i = 0 THEN 'a.json'
                      WHEN i = 1 THEN 'b.json' ELSE 'c.csv' END AS result_file, accuracy + i AS value
               FROM runs, range(3) AS r(i))"""


def _copies(spark, sf):
    i = F.col("position")
    file = (
        F.when((i == 0) & (F.col("seed") % 2 == 0), "a.csv").when(i == 0, "a.json").when(i == 1, "b.json").otherwise("c.csv")
    )
    spread = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("position")
    return runs(spark, sf).select("*", spread).withColumn("result_file", file).withColumn("value", F.col("accuracy") + i)


@register(
    "dedupe_runs",
    f"""WITH {_COPIES} SELECT dataset, sample_size, seed, split, method, result_file, round(value, 6) AS value FROM (
        SELECT *, row_number() OVER (PARTITION BY dataset, sample_size, seed, split, method
               ORDER BY CAST(result_file LIKE '%.csv' AS INTEGER), result_file, position) AS rn FROM copies) WHERE rn = 1""",
)
def dedupe_runs(spark, sf):
    best = R.dedupe_runs(_copies(spark, sf))
    return best.select("dataset", "sample_size", "seed", "split", "method", "result_file", r6("value").alias("value"))


@register(
    "latest_runs",
    f"""WITH {_COPIES} SELECT dataset, sample_size, seed, method, result_file, split, round(value, 6) AS value FROM (
        SELECT *, row_number() OVER (PARTITION BY dataset, sample_size, seed, method
               ORDER BY result_file DESC, position DESC, split DESC) AS rn FROM copies) WHERE rn = 1""",
)
def latest_runs(spark, sf):
    last = R.latest_runs(_copies(spark, sf), order=["result_file", "position", "split"])
    return last.select("dataset", "sample_size", "seed", "method", "result_file", "split", r6("value").alias("value"))


@register(
    "method_deltas",
    f"""WITH {_RUNS}, w AS (SELECT dataset, sample_size, seed, split, max(accuracy) FILTER (method = 'vanilla') AS v,
                                  max(accuracy) FILTER (method = 'random_aug') AS r FROM runs GROUP BY 1, 2, 3, 4)
        SELECT dataset, sample_size, seed, split, method, round(accuracy - v, 6) AS delta_vs_vanilla,
               round(accuracy - r, 6) AS delta_vs_random_aug FROM runs JOIN w USING (dataset, sample_size, seed, split)""",
)
def method_deltas(spark, sf):
    d = R.method_deltas(runs(spark, sf)).drop("accuracy", "macro_f1")
    return _rounded(d, "dataset", "sample_size", "seed", "split", "method")


@register(
    "raw_wide",
    f"""WITH {_SPLITS}, f AS (SELECT * FROM by_split),
        w AS (SELECT dataset, sample_size, seed, max(accuracy) FILTER (method = 'vanilla') AS v, max(accuracy) FILTER (method = 'random_aug') AS r,
                     max(accuracy) FILTER (method = 'error_driven') AS e, max(macro_f1) FILTER (method = 'vanilla') AS vf FROM f GROUP BY 1, 2, 3)
        SELECT dataset, sample_size, seed, method, round(v, 6) AS vanilla_accuracy, round(r, 6) AS random_aug_accuracy,
               round(e, 6) AS error_driven_accuracy, round(accuracy - v, 6) AS accuracy_delta, round(macro_f1 - vf, 6) AS macro_f1_delta
        FROM f JOIN w USING (dataset, sample_size, seed)""",
)
def raw_wide(spark, sf):
    wide = R.raw_wide(runs_by_split(spark, sf)).drop("accuracy", "macro_f1", "split")
    return _rounded(wide, "dataset", "sample_size", "seed", "method")


_SUMMARY = f"""{_RUNS},
    s AS (SELECT dataset, sample_size, split, method, count(*) AS n_runs, avg(accuracy) AS accuracy_mean,
                 coalesce(stddev_samp(accuracy), 0) AS accuracy_std, avg(macro_f1) AS macro_f1_mean,
                 coalesce(stddev_samp(macro_f1), 0) AS macro_f1_std FROM runs GROUP BY 1, 2, 3, 4)"""


@register(
    "summarize",
    f"""WITH {_SUMMARY}, w AS (SELECT dataset, sample_size, split, max(accuracy_mean) FILTER (method = 'vanilla') AS v,
             max(accuracy_mean) FILTER (method = 'random_aug') AS r, max(accuracy_mean) FILTER (method = 'error_driven') AS e FROM s GROUP BY 1, 2, 3)
        SELECT dataset, sample_size, split, method, n_runs, round(accuracy_mean, 6) AS accuracy_mean, round(accuracy_std, 6) AS accuracy_std,
               round(macro_f1_mean, 6) AS macro_f1_mean, round(macro_f1_std, 6) AS macro_f1_std,
               round(e - v, 6) AS delta_error_driven_vs_vanilla, round(r - v, 6) AS delta_random_aug_vs_vanilla,
               round(e - r, 6) AS delta_error_driven_vs_random_aug FROM s JOIN w USING (dataset, sample_size, split)""",
)
def summarize(spark, sf):
    return _rounded(R.summarize(runs(spark, sf)), "dataset", "sample_size", "split", "method", "n_runs")


def _compare_sql() -> str:
    parts = []
    for metric in ("accuracy", "macro_f1"):
        for m in L.METHODS:
            parts.append(f"round(avg({metric}) FILTER (method = '{m}'), 6) AS {m}_{metric}_mean")
            parts.append(
                f"round(CASE WHEN count(*) FILTER (method = '{m}') = 1 THEN 0 ELSE stddev_samp({metric}) FILTER (method = '{m}') END, 6) AS {m}_{metric}_std"
            )
        for a, b in (("random_aug", "vanilla"), ("error_driven", "vanilla"), ("error_driven", "random_aug")):
            parts.append(
                f"round(avg({metric}) FILTER (method = '{a}') - avg({metric}) FILTER (method = '{b}'), 6) AS {a}_vs_{b}_{metric}_delta"
            )
    counts = ", ".join(f"count(*) FILTER (method = '{m}')" for m in L.METHODS)
    return (
        f"WITH {_RUNS} SELECT dataset, sample_size, split, greatest({counts}) AS n_runs, {', '.join(parts)} FROM runs GROUP BY 1, 2, 3"
    )


@register("compare", _compare_sql())
def compare(spark, sf):
    return _rounded(R.compare(runs(spark, sf)), "dataset", "sample_size", "split", "n_runs")


@register(
    "metrics_long",
    f"""WITH {_RUNS}, l AS (SELECT dataset, sample_size, method, 'accuracy' AS metric, accuracy AS v FROM runs
                           UNION ALL SELECT dataset, sample_size, method, 'macro_f1', macro_f1 FROM runs)
        SELECT dataset, sample_size, method, metric, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std FROM l GROUP BY 1, 2, 3, 4""",
)
def metrics_long(spark, sf):
    return _rounded(R.metrics_long(runs(spark, sf)), "dataset", "sample_size", "method", "metric")


@register(
    "shot_scaling",
    f"""WITH {_RUNS}, m AS (SELECT dataset, method, sample_size, avg(accuracy) AS a FROM runs GROUP BY 1, 2, 3),
        l AS (SELECT dataset, method, lag(sample_size) OVER w AS from_shot, sample_size AS to_shot, a - lag(a) OVER w AS d
              FROM m WINDOW w AS (PARTITION BY dataset, method ORDER BY sample_size))
        SELECT dataset, method, from_shot, to_shot, round(d, 6) AS mean_accuracy_delta FROM l WHERE from_shot IS NOT NULL""",
)
def shot_scaling(spark, sf):
    return _rounded(R.shot_scaling(runs(spark, sf)), "dataset", "method", "from_shot", "to_shot")


# Scores by split: suppliers are seeds, shares of 1 rather than percent.
def _scores(spark, sf):
    return runs(spark, sf).select(
        "dataset",
        "sample_size",
        F.col("split").alias("split_idx"),
        "seed",
        (F.col("accuracy") / 100).alias("score"),
        F.lit("accuracy").alias("measure"),
    )


_SCORES = f"{_RUNS}, scores AS (SELECT dataset, sample_size, split AS split_idx, seed, accuracy / 100 AS score FROM runs)"


@register(
    "seed_medians",
    f"""WITH {_SCORES} SELECT dataset, sample_size, split_idx, round(median(score * 100), 6) AS score,
               round(quantile_cont(score * 100, 0.75::DOUBLE) - quantile_cont(score * 100, 0.25::DOUBLE), 6) AS iqr FROM scores GROUP BY 1, 2, 3""",
)
def seed_medians(spark, sf):
    return _rounded(R.seed_medians(_scores(spark, sf)), "dataset", "sample_size", "split_idx")


@register(
    "score_table",
    f"""WITH {_SCORES}, c AS (SELECT dataset, sample_size, avg(score) AS a, stddev_pop(score) AS s FROM scores GROUP BY 1, 2),
        t AS (SELECT dataset, 'accuracy' AS measure, sample_size, a, s FROM c UNION ALL SELECT 'Average', 'N/A', sample_size, a, s FROM c)
        SELECT dataset, measure, """
    + ", ".join(
        f'round(avg(a) FILTER (sample_size = {z}), 6) AS "{z}_avg", round(avg(s) FILTER (sample_size = {z}), 6) AS "{z}_std"'
        for z in (4, 8, 16)
    )
    + " FROM t GROUP BY 1, 2",
)
def score_table(spark, sf):
    return _rounded(R.score_table(_scores(spark, sf), [4, 8, 16]), "dataset", "measure")


@register(
    "seed_stats",
    f"""WITH {_RUNS}, x AS (SELECT dataset, sample_size, CASE dataset WHEN 'sst2' THEN 2 ELSE 4 END AS n_classes, accuracy, macro_f1 FROM runs)
        SELECT dataset, sample_size, round(avg(accuracy), 6) AS mean_acc, round(stddev_pop(accuracy), 6) AS acc_std,
               round(avg(accuracy + 1), 6) AS mean_f1_mic, round(stddev_pop(accuracy + 1), 6) AS f1_mic_std,
               round(avg(macro_f1), 6) AS mean_f1_mac, round(stddev_pop(macro_f1), 6) AS f1_mac_std,
               round(avg(CASE WHEN n_classes <= 2 THEN macro_f1 * 2 END), 6) AS mean_avg_pre,
               round(stddev_pop(CASE WHEN n_classes <= 2 THEN macro_f1 * 2 END), 6) AS avg_pre_std,
               round(avg(CASE WHEN n_classes <= 2 THEN macro_f1 * 3 END), 6) AS mean_logit_ap,
               round(stddev_pop(CASE WHEN n_classes <= 2 THEN macro_f1 * 3 END), 6) AS logit_ap_std FROM x GROUP BY 1, 2""",
)
def seed_stats(spark, sf):
    rows = runs(spark, sf).select(
        "dataset",
        "sample_size",
        F.when(F.col("dataset") == "sst2", 2).otherwise(4).alias("n_classes"),
        F.col("accuracy").alias("acc"),
        (F.col("accuracy") + 1).alias("f1_mic"),
        F.col("macro_f1").alias("f1_mac"),
        (F.col("macro_f1") * 2).alias("avg_pre"),
        (F.col("macro_f1") * 3).alias("logit_ap"),
    )
    return _rounded(R.seed_stats(rows, ["dataset", "sample_size"]), "dataset", "sample_size")


@register(
    "box_stats",
    f"""WITH {_SCORES} SELECT dataset, sample_size, round(min(score), 6) AS low, round(quantile_cont(score, 0.25::DOUBLE), 6) AS q1,
               round(median(score), 6) AS median, round(quantile_cont(score, 0.75::DOUBLE), 6) AS q3, round(max(score), 6) AS high
        FROM scores GROUP BY 1, 2""",
)
def box_stats(spark, sf):
    return _rounded(R.box_stats(_scores(spark, sf), ["dataset", "sample_size"]), "dataset", "sample_size")


@register(
    "latency_stats",
    """SELECT event_type, round(avg(value / 1000), 6) AS mean_s, round(stddev_pop(value / 1000), 6) AS std_s,
              round(quantile_cont(value / 1000, 0.95::DOUBLE), 9) AS p95_s, round(sum(value / 1000), 4) AS total_s FROM events GROUP BY 1""",
)
def latency_stats(spark, sf):
    times = table(spark, sf, "events").select("event_type", (F.col("value") / 1000).alias("latency_s"))
    s = R.latency_stats(times, by=["event_type"])
    return s.select(
        "event_type", r6("mean_s").alias("mean_s"), r6("std_s").alias("std_s"), F.round("p95_s", 9).alias("p95_s"), F.round("total_s", 4).alias("total_s")
    )


@register(
    "seed_coverage",
    f"""WITH {_RUNS} SELECT dataset, sample_size, count(DISTINCT seed) AS seeds, count(DISTINCT seed) >= 5 AS has_5,
                            count(DISTINCT seed) >= 101 AS has_101 FROM runs GROUP BY 1, 2""",
)
def seed_coverage(spark, sf):
    return R.seed_coverage(runs(spark, sf), [5, 101])


@register(
    "missing_runs",
    f"""WITH {_SPLITS}, o AS (SELECT * FROM by_split),
        s AS (SELECT dataset, sample_size, method, count(DISTINCT seed) AS runs, list_sort(list(DISTINCT seed::VARCHAR)) AS l FROM o GROUP BY 1, 2, 3),
        m AS (SELECT *, max(runs) OVER (PARTITION BY dataset, sample_size) AS expected FROM s)
        SELECT dataset, sample_size, method, runs, expected, list_aggregate(l[1:30], 'string_agg', ';')
               || CASE WHEN len(l) > 30 THEN ';...(+' || (len(l) - 30) || ')' ELSE '' END AS seeds FROM m WHERE runs < expected""",
)
def missing_runs(spark, sf):
    m = R.missing_runs(runs_by_split(spark, sf))
    return m.withColumn("runs", big("runs")).withColumn("expected", big("expected"))


@register(
    "pending_runs",
    f"""WITH {_SPLITS}, done AS (SELECT dataset, sample_size, seed, count(DISTINCT method) AS n FROM by_split GROUP BY 1, 2, 3),
        grid AS (SELECT DISTINCT dataset, sample_size, l_suppkey AS seed FROM (SELECT DISTINCT dataset, sample_size FROM by_split), (SELECT DISTINCT l_suppkey FROM lineitem))
        SELECT dataset, sample_size, seed FROM grid LEFT JOIN done USING (dataset, sample_size, seed) WHERE coalesce(n, 0) < 3""",
)
def pending_runs(spark, sf):
    done = runs_by_split(spark, sf)
    # A few datasets and sizes, as settings of the grid.
    kinds = [tuple(r) for r in done.select("dataset", "sample_size").distinct().collect()]
    cells = F.array(*[F.struct(F.lit(d).alias("dataset"), F.lit(z).alias("sample_size")) for d, z in kinds])
    grid = run_rows(spark, sf).select("seed").distinct().select("seed", F.inline(cells))
    old_name = F.when(F.col("method") == "error_driven", "augmented").otherwise(F.col("method"))
    return R.pending_runs(grid, done.withColumn("method", old_name)).select("dataset", "sample_size", "seed")


@register(
    "improvement",
    f"""WITH {_RUN_ROWS}, c AS (SELECT dataset, sample_size, method, CASE WHEN method = 'vanilla' AND seed % 7 = 3 THEN '2' ELSE CAST(seed % 7 AS VARCHAR) END AS label,
                      avg(CAST(l_discount <= 0.05 AS INTEGER)) * 100 AS a FROM run_rows GROUP BY 1, 2, 3, 4),
        k AS (SELECT DISTINCT c.dataset, c.sample_size, m.method, c.label FROM c
              JOIN (SELECT DISTINCT dataset, sample_size, method FROM c) m ON c.dataset = m.dataset AND c.sample_size = m.sample_size
              WHERE c.method = m.method OR c.method = 'vanilla')
        SELECT k.dataset, k.sample_size, k.method, k.label, round(x.a - b.a, 6) AS delta FROM k
        LEFT JOIN c x USING (dataset, sample_size, method, label)
        LEFT JOIN c b ON b.dataset = k.dataset AND b.sample_size = k.sample_size AND b.label = k.label AND b.method = 'vanilla'""",
)
def improvement(spark, sf):
    # Vanilla runs know no class 3, so that a class lacks its baseline.
    label = F.when((F.col("method") == "vanilla") & (F.col("seed") % 7 == 3), "2").otherwise((F.col("seed") % 7).cast("string"))
    classes = (
        run_rows(spark, sf)
        .withColumn("label", label)
        .groupBy("dataset", "sample_size", "method", "label")
        .agg((F.avg((F.col("l_discount") <= 0.05).cast("int")) * 100).alias("accuracy"))
    )
    return R.per_class_delta(classes, ["dataset", "sample_size"]).withColumn("delta", r6("delta"))


# --- files and records ------------------------------------------------------------------


def _payloads(spark, sf):
    """One JSON text per dataset and size: records in changing containers and under changing names."""
    rows = runs(spark, sf)
    odd = F.col("sample_size") != 8
    record = F.when(
        odd,
        F.to_json(
            F.struct(
                "dataset", F.col("sample_size").alias("shot"), "seed", "split", F.upper("method").alias("method"),
                F.col("accuracy").alias("acc"), F.col("macro_f1").alias("macro-F1"),
            )
        ),
    ).otherwise(
        F.to_json(
            F.struct(
                F.col("dataset").alias("task"), F.concat(F.col("sample_size").cast("string"), F.lit("")).alias("sample_size"),
                F.col("seed").alias("seed"), "split", F.lit(" Random Aug ").alias("method"),
                F.col("accuracy").cast("string").alias("score"), F.lit("").alias("macro_f1"),
            )
        )
    )
    body = rows.withColumn("record", record).groupBy("dataset", "sample_size", "seed").agg(
        F.array_join(F.array_sort(F.collect_list("record")), ",").alias("body")
    )
    text = (
        F.when(F.col("sample_size") == 4, F.format_string('{"results": [%s]}', "body"))
        .when(F.col("sample_size") == 8, F.format_string('[{"note": 1, "runs": {"items": [%s]}}]', "body"))
        .otherwise(F.when(F.col("seed") % 5 == 0, F.format_string('{"results": [%s', "body")).otherwise(F.format_string("[[%s]]", "body")))
    )
    file = F.concat_ws("/", F.lit("results"), "dataset", F.concat("sample_size", F.lit("-shot")), F.concat(F.lit("seed-"), "seed"), F.lit("all.json"))
    return body.select(text.alias("value"), file.alias("result_file"))


_UNWRAPPED = f"""{_RUNS}, unwrapped AS (
    SELECT dataset, CAST(sample_size AS VARCHAR) AS sample_size, CAST(seed AS VARCHAR) AS seed, split,
           CASE WHEN sample_size = 8 THEN 'random_aug' ELSE method END AS method, accuracy,
           CASE WHEN sample_size = 8 THEN NULL ELSE macro_f1 END AS macro_f1
    FROM runs WHERE NOT (sample_size = 16 AND seed % 5 = 0))"""


@register("unwrap_records", f"WITH {_UNWRAPPED} SELECT * FROM unwrapped")
def unwrap_records(spark, sf):
    found = SR.json_runs(_payloads(spark, sf))
    return found.select("dataset", "sample_size", "seed", "split", "method", "accuracy", "macro_f1")


@register(
    "rejected_json",
    f"""WITH {_RUNS} SELECT DISTINCT 'results/' || dataset || '/16-shot/seed-' || seed || '/all.json' AS result_file
        FROM runs WHERE sample_size = 16 AND seed % 5 = 0""",
)
def rejected_json(spark, sf):
    return SR.rejected_json(_payloads(spark, sf)).select("result_file")


_LOG = """'Completed dataset=' || dataset || ' shot=' || sample_size || ' seed=' || seed || ': vanilla='"""


def _log_texts(spark, sf):
    """One log text per dataset and size, a line per seed that has all three methods."""
    m = {k: F.max(F.when(F.col("method") == k, F.col("accuracy"))) for k in L.METHODS}
    cells = runs_by_split(spark, sf).groupBy("dataset", "sample_size", "seed").agg(
        *[F.format_string("%.3f", v).alias(k) for k, v in m.items()], *[v.alias(f"{k}_raw") for k, v in m.items()]
    )
    line = F.format_string(
        "Completed dataset=%s shot=%d seed=%d: vanilla=%s, random=%s, error-driven=%s\n",
        "dataset", "sample_size", "seed", "vanilla", "random_aug", "error_driven",
    )
    whole = cells.filter("vanilla_raw is not null and random_aug_raw is not null and error_driven_raw is not null")
    return (
        whole.withColumn("line", line)
        .groupBy("dataset", "sample_size")
        .agg(F.array_join(F.array_sort(F.collect_list("line")), "").alias("value"))
        .select(
            F.concat(F.lit("start\n"), "value", F.when(F.col("sample_size") == 8, "CUDA out of memory\n").otherwise("")).alias("value"),
            F.concat_ws("/", F.lit("logs"), F.concat(F.col("dataset"), F.lit("_shot"), "sample_size", F.lit("_seed1.log"))).alias("result_file"),
        )
    )


_LOGGED = f"""{_SPLITS}, logged AS (SELECT dataset, sample_size, seed, max(accuracy) FILTER (method = 'vanilla') AS v,
    max(accuracy) FILTER (method = 'random_aug') AS r, max(accuracy) FILTER (method = 'error_driven') AS e
    FROM by_split GROUP BY 1, 2, 3 HAVING v IS NOT NULL AND r IS NOT NULL AND e IS NOT NULL)"""


@register(
    "parse_run_logs",
    f"""WITH {_LOGGED}, l AS (SELECT dataset, sample_size, seed, 'vanilla' AS method, v AS a FROM logged
        UNION ALL SELECT dataset, sample_size, seed, 'random_aug', r FROM logged UNION ALL SELECT dataset, sample_size, seed, 'error_driven', e FROM logged)
        SELECT dataset, sample_size::VARCHAR AS sample_size, seed::VARCHAR AS seed, method, count(*) AS n, round(max(a), 3) AS accuracy FROM l GROUP BY 1, 2, 3, 4""",
)
def parse_run_logs(spark, sf):
    rows = SR.log_runs(_log_texts(spark, sf))
    return rows.groupBy("dataset", "sample_size", "seed", "method").agg(
        F.count(F.lit(1)).alias("n"), F.max("accuracy").alias("accuracy")
    )


@register(
    "log_status",
    f"""WITH {_LOGGED} SELECT 'logs/' || dataset || '_shot' || sample_size || '_seed1.log' AS result_file, TRUE AS contains_completed,
               sample_size = 8 AS contains_error, 1 + count(*) + CAST(sample_size = 8 AS INTEGER) AS line_count,
               string_agg(dataset || ':' || sample_size || ':' || seed, ';' ORDER BY dataset || ':' || sample_size || ':' || seed) AS completed_runs
        FROM logged GROUP BY dataset, sample_size""",
)
def log_status(spark, sf):
    status = SR.log_status(_log_texts(spark, sf))
    return status.select(
        "result_file", "contains_completed", "contains_error", big("line_count").alias("line_count"),
        F.array_join(F.array_sort("completed_runs"), ";").alias("completed_runs"),
    )


@register(
    "parse_log_name",
    f"""WITH {_LOGGED} SELECT DISTINCT split_part(dataset, '-', 1) AS dataset, sample_size::VARCHAR AS shot, '1' AS seed FROM logged""",
)
def parse_log_name(spark, sf):
    return _log_texts(spark, sf).select(L.parse_log_name("result_file").alias("p")).select("p.dataset", "p.shot", "p.seed").distinct()


@register(
    "parse_path",
    f"""WITH {_RUNS} SELECT DISTINCT dataset, sample_size::VARCHAR AS shot, seed::VARCHAR AS seed, method FROM runs""",
)
def parse_path(spark, sf):
    file = F.concat_ws(
        "/", F.lit("results"), F.replace(F.col("dataset"), F.lit("_"), F.lit("-")), F.concat("sample_size", F.lit("-shot")),
        F.concat(F.lit("seed_"), "seed"), F.concat("method", F.lit(".json")),
    )
    rows = runs(spark, sf).select(file.alias("f")).distinct()
    return rows.select(L.parse_path("f").alias("p")).select("p.*")


@register(
    "clean_cells",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN user_id::DOUBLE ELSE value END AS as_float,
              CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' WHEN 2 THEN user_id::VARCHAR ELSE value::VARCHAR END AS as_int,
              CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN user_id::VARCHAR
                   ELSE regexp_replace(value::VARCHAR, '^(\\d+)\\.0$', '\\1') END AS clean FROM events""",
)
def clean_cells(spark, sf):
    k = F.col("event_id") % 5
    cell = F.when(k == 0, "").when(k == 1, "n/a").when(k == 2, F.col("user_id").cast("string")).otherwise(F.col("value").cast("string"))
    rows = table(spark, sf, "events").withColumn("cell", cell)
    return rows.select(
        "event_id", L.safe_float("cell").alias("as_float"), L.safe_int("cell").alias("as_int"), L.clean_scalar("cell").alias("clean")
    )


@register(
    "normalize_names",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'vanilla' WHEN 'view' THEN 'random_aug' WHEN 'error' THEN 'error_driven'
                                       WHEN 'signup' THEN 'error_driven' END AS method,
              CASE event_type WHEN 'click' THEN 'ag_news' WHEN 'view' THEN 'sst2' WHEN 'error' THEN 'trec' ELSE event_type END AS dataset FROM events""",
)
def normalize_names(spark, sf):
    kind = F.col("event_type")
    method = F.when(kind == "click", " Baseline").when(kind == "view", "Random Augmentation").when(kind == "error", "ERROR-driven")
    file = F.when(kind == "signup", "results/augmented.json").otherwise("results/other.json")
    dataset = F.when(kind == "click", "AG-News").when(kind == "view", "sst-2 ").when(kind == "error", "TREC-QC").otherwise(kind)
    return table(spark, sf, "events").select(
        "event_id", L.normalize_method(method, file).alias("method"), L.normalize_dataset(dataset).alias("dataset")
    )


@register(
    "format_score",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE printf('%.3f', value) END AS score FROM events""",
)
def format_score(spark, sf):
    value = F.when(F.col("event_id") % 4 != 0, F.col("value"))
    return table(spark, sf, "events").select("event_id", X.format_score(value).alias("score"))


@register(
    "unique_join",
    """WITH u AS (SELECT event_type, list_sort(list(DISTINCT user_id::VARCHAR)) AS l FROM events WHERE user_id % 3 <> 0 GROUP BY 1)
       SELECT event_type, list_aggregate(l[1:30], 'string_agg', ';') || CASE WHEN len(l) > 30 THEN ';...(+' || (len(l) - 30) || ')' ELSE '' END AS users FROM u""",
)
def unique_join(spark, sf):
    user = F.when(F.col("user_id") % 3 == 0, F.lit("")).otherwise(F.col("user_id").cast("string"))
    users = table(spark, sf, "events").select("event_type", user.alias("users"))
    return unique_lists(users, ["event_type"], ["users"]).select("event_type", "users")


@register(
    "stale_files",
    """WITH f AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'scripts/results/' WHEN 1 THEN 'a/tmp/' ELSE 'results/' END || page_id || '.json' AS path,
                         TIMESTAMP '2024-01-20 00:00:00' - to_days((page_id % 11)::INTEGER) AS mtime FROM pages)
       SELECT path, concat_ws('; ', CASE WHEN page_id % 3 = 0 THEN 'under scripts/results' END, CASE WHEN page_id % 3 = 1 THEN 'temporary path' END,
              CASE WHEN page_id % 11 > 7 THEN '>7 days older than newest scanned result' END) AS old_reason FROM f""",
)
def stale_files(spark, sf):
    folder = F.when(F.col("page_id") % 3 == 0, "scripts/results/").when(F.col("page_id") % 3 == 1, "a/tmp/").otherwise("results/")
    day = F.lit("2024-01-20 00:00:00").cast("timestamp")
    files = table(spark, sf, "pages").select(
        F.concat(folder, F.col("page_id").cast("string"), F.lit(".json")).alias("path"),
        (day - F.make_dt_interval((F.col("page_id") % 11).cast("int"))).alias("mtime"),
    )
    return R.stale_files(files).select("path", "old_reason")


@register(
    "run_inventory",
    f"""WITH {_RUNS} SELECT 'results/' || dataset || '/' || sample_size || '-shot/seed-' || seed || '/all.json' AS result_file, dataset,
               sample_size::VARCHAR AS sample_size, CASE WHEN sample_size = 8 THEN 'random_aug' ELSE method END AS method,
               count(*) AS n_rows, TRUE AS has_seed FROM runs WHERE NOT (sample_size = 16 AND seed % 5 = 0) GROUP BY 1, 2, 3, 4""",
)
def run_inventory(spark, sf):
    return R.run_inventory(SR.json_runs(_payloads(spark, sf)))


@register(
    "run_files",
    f"""WITH {_RUNS} SELECT 'results/' || dataset || '/' || sample_size || '-shot/seed-' || seed || '/all.json' AS result_file, count(*) AS n_rows,
               'acc,dataset,macro-F1,method,seed,shot,split' AS columns, dataset AS unique_dataset, sample_size::VARCHAR AS unique_shot,
               string_agg(DISTINCT upper(method), ',' ORDER BY upper(method)) AS unique_method, seed::VARCHAR AS unique_seed, TRUE AS has_seed_field
        FROM runs WHERE sample_size = 4 OR (sample_size = 16 AND seed % 5 <> 0) GROUP BY dataset, sample_size, seed""",
)
def run_files(spark, sf):
    def found(v):
        return F.try_variant_get(v, "$.dataset", "string").isNotNull()

    parsed = _payloads(spark, sf).select("result_file", F.try_parse_json("value").alias("payload"))
    flat = SR.unwrap_records(parsed.filter("payload is not null"), found, SR.AUDIT_CONTAINERS, False)
    files = SR.run_files(SR.audit_records(flat))
    lists = ["columns", "unique_dataset", "unique_shot", "unique_method", "unique_seed"]
    return files.select("result_file", "n_rows", *[F.array_join(F.array_sort(c), ",").alias(c) for c in lists], "has_seed_field")


@register(
    "read_runs",
    f"""WITH {_RUNS} SELECT dataset, sample_size::VARCHAR AS sample_size, seed::VARCHAR AS seed, split, method, round(accuracy, 6) AS accuracy,
               round(macro_f1, 6) AS macro_f1 FROM runs""",
)
def read_runs(spark, sf):
    """Runs written below the shared folder in all formats, records nested nine deep, and read back from there."""
    rows = runs(spark, sf)
    path = shared_path(spark, "runs")
    SR.write_runs(rows.filter("split = 'F'"), f"{path}/csv", R.RAW_FIELDS)
    other = rows.filter("split <> 'F'")
    SR.write_summary_json(other.filter("seed % 2 = 0"), f"{path}/json")
    record = F.to_json(F.struct(*[c for c in other.columns if c != "iteration"]))
    nested = other.filter("seed % 2 = 1").select(
        F.concat(F.lit('{"results": [' * 4 + "["), record, F.lit("]" + "]}" * 4)).alias("value")
    )
    broken = rows.limit(0).select(F.lit("").alias("value")).unionByName(
        spark.createDataFrame([('{"results": [',), ("not JSON",)], "value string")
    )
    nested.unionByName(broken).write.text(f"{path}/nested")
    lines = spark.read.text(f"{path}/nested")
    lines.write.option("lineSep", "\n").text(f"{path}/lines.jsonl")
    back = SR.read_runs(spark, path).unionByName(
        SR.json_runs(SR.read_texts(spark, f"{path}/lines.jsonl", "*.txt", whole=False))
    )
    return back.select(
        "dataset", "sample_size", "seed", "split", "method", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1")
    )


# A tree of run files: folders name dataset, size and a group of seeds; every tenth seed group has a broken file more.
_TREE = f"""{_RUNS},
    logged AS (SELECT dataset, sample_size, seed, split FROM runs WHERE seed % 4 = 3 GROUP BY 1, 2, 3, 4 HAVING count(*) = 3),
    placed AS (SELECT runs.*, 'results/' || replace(dataset, '_', '-') || '/' || sample_size || '-shot/seed-' || seed % 10 AS folder,
                      CASE WHEN seed % 4 = 0 THEN 'csv' WHEN seed % 4 = 1 THEN 'json' WHEN l.seed IS NOT NULL THEN 'log' ELSE 'jsonl' END AS kind
               FROM runs LEFT JOIN (SELECT dataset, sample_size, seed, split FROM logged) l USING (dataset, sample_size, seed, split))"""


def _write_tree(spark, sf):
    """Write all runs below the shared folder as CSV, nested JSON, JSON lines and logs, with broken files among them."""
    rows = runs(spark, sf)
    cell = ["dataset", "sample_size", "seed", "split"]
    full = rows.filter("seed % 4 = 3").groupBy(*cell).count().filter("count = 3").select(*cell, F.lit(True).alias("_full"))
    kind = F.when(F.col("seed") % 4 == 0, "csv").when(F.col("seed") % 4 == 1, "json").when(F.col("_full"), "log").otherwise("jsonl")
    folder = F.concat(
        F.lit("results/"), F.replace("dataset", F.lit("_"), F.lit("-")), F.lit("/"), F.col("sample_size").cast("string"),
        F.lit("-shot/seed-"), (F.col("seed") % 10).cast("string"),
    )
    placed = rows.join(full, cell, "left").select("*", kind.alias("kind"), folder.alias("folder"))
    names = [*cell, "method", "accuracy", "macro_f1"]
    record = F.to_json(F.struct(*names))

    def texts(name, lines, before="", between="\n", after="\n"):
        inside = F.array_join(F.array_sort(F.collect_list("line")), between)
        files = lines.groupBy("folder").agg(F.concat(F.lit(before), inside, F.lit(after)).alias("value"))
        return files.select(F.concat("folder", F.lit(name)).alias("name"), "value")

    of = lambda k: placed.filter(F.col("kind") == k)
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in names])
    logs = of("log").groupBy("folder", *cell).agg(
        *[F.max(F.when(F.col("method") == m, F.format_string("%.3f", "accuracy"))).alias(m) for m in L.METHODS]
    )
    told = F.format_string(
        "Completed dataset=%s shot=%d seed=%d: vanilla=%s, random=%s, error-driven=%s", "dataset", "sample_size", "seed", *L.METHODS
    )
    broken = placed.filter("seed % 10 = 9").select(F.concat("folder", F.lit("/vanilla.json")).alias("name"), F.lit('{"results": [').alias("value"))
    parts = [
        texts("/runs.csv", of("csv").select("folder", line.alias("line")), ",".join(names) + "\n"),
        texts("/runs.json", of("json").select("folder", record.alias("line")), '{"results": [' , ",", "]}"),
        texts("/runs.jsonl", of("jsonl").select("folder", F.concat(F.lit('{"runs": ['), record, F.lit("]}")).alias("line")), "{\n"),
        texts("/ag-news_shot4_seed1.log", logs.select("folder", told.alias("line")), "start\n", "\n", "\nRuntimeError\n"),
        broken.distinct(),
    ]
    path = shared_path(spark, "run-tree")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    SF.write_texts(out, path)
    return path


@register(
    "read_run_tree",
    f"""WITH {_TREE} SELECT dataset, sample_size::VARCHAR AS sample_size, seed::VARCHAR AS seed, CASE WHEN kind = 'log' THEN '' ELSE split END AS split,
               method, CASE WHEN kind = 'log' THEN round(accuracy, 3) ELSE round(accuracy, 6) END AS accuracy,
               CASE WHEN kind <> 'log' THEN round(macro_f1, 6) END AS macro_f1 FROM placed""",
)
def read_run_tree(spark, sf):
    """All runs, read back from files of every suffix."""
    back = SR.read_runs(spark, _write_tree(spark, sf))
    return back.select("dataset", "sample_size", "seed", "split", "method", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"))


@register(
    "rejected_inputs",
    f"""WITH {_TREE} SELECT 'no JSON line' AS reason, count(DISTINCT folder) AS n FROM placed WHERE kind = 'jsonl'
        UNION ALL SELECT 'no JSON', count(DISTINCT folder) FROM placed WHERE seed % 10 = 9""",
)
def rejected_inputs(spark, sf):
    """Texts that gave no run, by reason."""
    return SR.rejected_inputs(spark, _write_tree(spark, sf)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_JOINED = "list_aggregate({0}[1:30], 'string_agg', ';') || CASE WHEN len({0}) > 30 THEN ';...(+' || (len({0}) - 30) || ')' ELSE '' END"


@register(
    "audit_files",
    f"""WITH {_TREE}, files AS (
            SELECT folder || '/runs.' || kind AS path, kind, count(*) AS n, list_sort(list(DISTINCT seed::VARCHAR)) AS seeds,
                   list_sort(list(DISTINCT method)) AS methods, any_value(dataset) AS dataset, any_value(sample_size)::VARCHAR AS shot
            FROM placed WHERE kind IN ('csv', 'json') GROUP BY folder, kind)
        SELECT path, kind, CASE kind WHEN 'csv' THEN n + 1 ELSE 1 END AS line_count, n AS n_rows,
               CASE kind WHEN 'csv' THEN 'accuracy;dataset;macro_f1;method;sample_size;seed;split' ELSE 'accuracy;dataset;macro_f1;method;sample_size;seed;split' END AS columns,
               dataset AS unique_dataset, shot AS unique_shot, array_to_string(methods, ';') AS unique_method, {_JOINED.format('seeds')} AS unique_seed,
               TRUE AS has_seed_field, NULL::BIGINT AS n_completed, NULL::BOOLEAN AS contains_error, NULL::VARCHAR AS parsed_dataset, NULL::VARCHAR AS read_error FROM files
        UNION ALL SELECT DISTINCT folder || '/vanilla.json', 'json', 1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'no JSON' FROM placed WHERE seed % 10 = 9
        UNION ALL SELECT folder || '/ag-news_shot4_seed1.log', 'log', count(*) // 3 + 2, NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(*) // 3, TRUE, 'ag_news', NULL
        FROM placed WHERE kind = 'log' GROUP BY folder""",
)
def audit_files(spark, sf):
    """The audit of the tree; sizes and ages depend on the run and are left out."""
    found = SF.audit_files(spark, _write_tree(spark, sf))
    return found.select(
        "path", "kind", "line_count", "n_rows", "columns", "unique_dataset", "unique_shot", "unique_method", "unique_seed", "has_seed_field",
        "n_completed", "contains_error", "parsed_dataset", "read_error",
    )


@register(
    "inventory",
    f"""WITH {_TREE} SELECT folder || '/runs.' || kind AS path, dataset, sample_size::VARCHAR AS shot, method, count(*) AS n_rows, count(DISTINCT seed) AS n_seeds
        FROM placed WHERE kind IN ('csv', 'json') GROUP BY ALL
        UNION ALL SELECT folder || '/ag-news_shot4_seed1.log', dataset, sample_size::VARCHAR, method, count(*), count(DISTINCT seed) FROM placed WHERE kind = 'log' GROUP BY ALL""",
)
def inventory(spark, sf):
    """Runs per file, from records, paths and logs."""
    return SF.inventory(spark, _write_tree(spark, sf)).select("path", "dataset", "shot", "method", "n_rows", "n_seeds")
