"""Registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from handful.llm import (
    collocations,
    exact_dedup,
    line_dedup,
    mixing,
    neighbours,
    pieces,
    quality,
    simhash,
    suffixes,
    token_records,
    toxicity,
    warc,
    whitening,
)
from handful.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# DuckDB: A-Z lower-cased.
LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(run):
    QUERIES[run.__name__] = run
    return run


@query
def op3_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"), words=4, seed=42, distance=4)
    return found.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


@query
def op6_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = exact_dedup.exact_groups(table(spark, sf, "documents"))
    return found.select(
        F.col("key").alias("doc_id"),
        F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        "kept",
        F.col("digest").alias("text_sha256"),
    )


ORACLES["op6_exact_dedup"] = f"""
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
    FROM (SELECT doc_id, {LOWER_SQL.format("coalesce(text, '')")} AS body FROM documents)
    WINDOW same AS (PARTITION BY body)
"""


@query
def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = line_dedup.drop_shared_lines(table(spark, sf, "documents"), min_docs=10, min_chars=1)
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", "kept_sha256")


ORACLES["op9_line_dedup"] = f"""
    WITH lines AS (
        SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
    keyed AS (SELECT *, {LOWER_SQL.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")}
              AS line_key FROM lines),
    common AS (SELECT line_key FROM keyed WHERE length(line_key) >= 1
               GROUP BY line_key HAVING count(DISTINCT doc_id) >= 10),
    marked AS (SELECT keyed.*, common.line_key IS NOT NULL AS gone FROM keyed LEFT JOIN common USING (line_key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
"""


@query
def op7_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    found = mixing.mixture(table(spark, sf, "documents"), weights=(5, 2, 1), cap=3)
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query
def op4_warc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    segments = warc.write_archives(table(spark, sf, "pages"), min_bytes=100)
    return warc.read_records(segments).where("last").select(
        F.col("id").alias("page_id"),
        F.col("so_far").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


ORACLES["op4_warc_chunks"] = """
    SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest,
           CASE WHEN strlen(body) >= 100 AND page_id > min(page_id) OVER same THEN 'revisit' ELSE 'response' END
               AS record_type,
           CASE WHEN strlen(body) >= 100 AND page_id > min(page_id) OVER same THEN min(page_id) OVER same END
               AS refers_to
    FROM (SELECT page_id, coalesce(html, '') AS body FROM pages)
    WINDOW same AS (PARTITION BY body)
"""


@query
def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    found = toxicity.classify(table(spark, sf, "documents"), table(spark, sf, "labels"), threshold=0.5)
    return found.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted", "neighbours", "cosines")


@query
def op5_quality(spark: SparkSession, sf: str) -> DataFrame:
    found = quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"), threshold=0.3)
    return found.withColumnRenamed("id", "doc_id")


@query
def op8_nearest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    return neighbours.search(rows, rows.where("vec_id % 100 = 0"), k=10)


@query
def op10_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.encode(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


@query
def op2_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf, "documents"), length=100)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op11_token_records(spark: SparkSession, sf: str) -> DataFrame:
    shards = token_records.write_records(table(spark, sf, "documents"), tokenizer=token_records.TOKENIZER, end_id=1)
    found = token_records.read_records(shards)
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf, "embeddings"), components=16, scale=64, offset=1_000_000)
    return found.withColumnRenamed("id", "vec_id")


@query
def op12_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"), min_count=30, share=80, top=2000)


ORACLES["op12_collocations"] = f"""
    WITH texts AS (SELECT coalesce(lang, 'und') AS lang, {LOWER_SQL.format("coalesce(text, '')")} AS body FROM documents),
    pieces AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(body, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
               FROM texts),
    totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
    grams AS ({" UNION ALL ".join(
        f"SELECT lang, {k} AS k, unnest([array_to_string(w[i:i + {k - 1}], ' ') FOR i IN range(1, len(w) - {k} + 2)]) AS phrase "
        "FROM pieces" for k in range(1, 5)
    )}),
    counts AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
    inner_parts AS (SELECT lang, f, unnest(flatten([[array_to_string(w[i:i + size - 1], ' ') FOR i IN range(1, k - size + 2)]
                                                    FOR size IN range(2, k)])) AS phrase
                    FROM (SELECT lang, k, f, string_split(phrase, ' ') AS w FROM counts WHERE k > 2)),
    longest AS (SELECT lang, phrase, max(f) AS longer FROM inner_parts GROUP BY ALL),
    kept AS (SELECT c.lang, c.phrase, c.k, c.f AS a, string_split(c.phrase, ' ') AS w
             FROM counts c LEFT JOIN longest s USING (lang, phrase)
             WHERE c.k > 1 AND (s.longer IS NULL OR 100 * s.longer::HUGEINT < 80 * c.f::HUGEINT)),
    cuts AS (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:k], ' ') AS tail
             FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
    scored AS (SELECT cuts.lang, cuts.phrase, a, cut, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score
               FROM cuts JOIN counts x ON x.lang = cuts.lang AND x.phrase = head
               JOIN counts y ON y.lang = cuts.lang AND y.phrase = tail),
    weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
    SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
    FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
