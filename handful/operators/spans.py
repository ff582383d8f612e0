"""Aspect spans: extraction, prefix texts, training sets, prediction.

Tokens are a column ARRAY<STRUCT<i INT, text STRING, pos STRING, start INT, end INT>>
with char offsets (end exclusive); a span is STRUCT<start INT, stop INT> in token
positions (stop exclusive).

Every operator also takes packed tokens (``pack_tokens``, ``tag_tokens(packed=True)``): a BINARY of about a byte a token
with tags and offsets, but without the token texts. What is written or shuffled here is packed, and texts are
shuffled only where a model input is asked for.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from handful.functions.text import nth_occurrence
from handful.operators.columns import with_default_ordinal
from handful.operators.metrics import accuracy
from handful.session import cut_lineage

# Tags that make an aspect, and how many words around it the two models read.
ASPECT_TAGS = ["NOUN", "PROPN"]
ASPECT_CONTEXT, POLARITY_CONTEXT = 0, 3
CONTEXTS = (ASPECT_CONTEXT, POLARITY_CONTEXT)
# Texts are tagged in pieces of about so many bytes, as tokens take some fifty times the memory of their text.
PIECE_BYTES = 1 << 20

TOKEN = T.StructType(
    [
        T.StructField("i", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("pos", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
    ]
)


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def text_pieces(texts: pa.Array, most: int | None = None) -> Iterator[pa.Array]:
    """The texts in order, in slices of at most ``most`` bytes or one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, before = 0, 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, before + (most or PIECE_BYTES), "right")))
        yield texts.slice(at, stop - at)
        at, before = stop, int(ends[stop - 1])


def pack(tags: Sequence[str | None], starts: Sequence[int], ends: Sequence[int]) -> bytes:
    """The tokens of one text: its tag names, then gaps, lengths and tag numbers by byte planes, compressed."""
    names: dict[str | None, int] = {}
    numbers = [names.setdefault(tag, len(names)) for tag in tags]
    starts, ends = np.array(starts, np.int64), np.array(ends, np.int64)
    gaps = starts.copy()
    gaps[1:] -= ends[:-1]
    own = np.concatenate([gaps, ends - starts, np.array(numbers, np.int64)]).astype("<i4")
    head = json.dumps(list(names)).encode()
    size = np.array([len(numbers), len(head)], "<u4").tobytes()
    return zlib.compress(size + head + own.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(blob: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str | None]]:
    """(starts, ends, tag numbers, tag names) of packed tokens; null has none."""
    if blob is None:
        none = np.zeros(0, np.int64)
        return none, none, none, []
    body = zlib.decompress(blob)
    n, head = np.frombuffer(body, "<u4", 2).tolist()
    planes = np.frombuffer(body, np.uint8, 12 * n, 8 + head).reshape(4, 3 * n)
    gaps, sizes, numbers = np.ascontiguousarray(planes.T).view("<i4").ravel().reshape(3, n).astype(np.int64)
    ends = np.cumsum(gaps + sizes)
    return ends - sizes, ends, numbers, json.loads(body[8 : 8 + head])


def _packed_of(texts: pa.Array, run: Callable[[str], Sequence[tuple]]) -> pa.Array:
    """The packed tokens of each text."""
    out = []
    for value in texts:
        found = list(run(value.as_py() or ""))
        _, tags, starts, ends = zip(*found) if found else ((), (), (), ())
        out.append(pack(tags, starts, ends))
    return pa.array(out, pa.binary())


def _tokens_of(texts: pa.Array, run: Callable[[str], Sequence[tuple]]) -> pa.Array:
    """The tokens of each text."""
    edges, places, words, tags, starts, ends = [0], [], [], [], [], []
    for value in texts:
        count = 0
        for word, tag, start, end in run(value.as_py() or ""):
            words.append(word)
            tags.append(tag)
            starts.append(start)
            ends.append(end)
            places.append(count)
            count += 1
        edges.append(len(places))
    kinds = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
    columns = [pa.array(values, kind) for values, kind in zip((places, words, tags, starts, ends), kinds)]
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(columns, TOKEN.names))


def tag_tokens(
    df: DataFrame, tagger: Callable[[], Callable[[str], Sequence[tuple]]], text: str = "text", packed: bool = False
) -> DataFrame:
    """Add ``tokens`` with a user's tagger.

    ``tagger`` is a factory called once per worker; it returns a function from a text
    to (token text, tag, start, end) tuples.
    """
    made = _packed_of if packed else _tokens_of

    @F.arrow_udf(T.BinaryType() if packed else T.ArrayType(TOKEN))
    def tag(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = tagger()
        for texts in batches:
            for piece in text_pieces(texts):
                yield made(piece, run)

    # marked so that the planner keeps one call per row instead of copying it into filters
    return df.withColumn("tokens", tag.asNondeterministic()(F.col(text)))


def is_packed(docs: DataFrame, tokens: str = "tokens") -> bool:
    return isinstance(docs.schema[tokens].dataType, T.BinaryType)


def pack_tokens(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """The documents with packed tokens."""
    if is_packed(docs, tokens):
        return docs

    @F.arrow_udf(T.BinaryType())
    def packed(tags: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        rows = zip(tags, starts, ends)
        return pa.array([pack(*(x.as_py() for x in row)) if row[1].is_valid else None for row in rows], pa.binary())

    own = (F.col(f"{tokens}.{name}") for name in ("pos", "start", "end"))
    return docs.withColumn(tokens, packed.asNondeterministic()(*own))


def packed_words(text, tokens, place) -> Column:
    """(n, words) of packed tokens: their number, and the text of the token at a place counted modulo that."""

    @F.arrow_udf(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("words", T.StringType())]))
    def word(texts: pa.Array, blobs: pa.Array, places: pa.Array) -> pa.Array:
        sizes, words = [], []
        for own, blob, at in zip(texts, blobs, places):
            starts, ends, *_ = unpack(blob.as_py())
            sizes.append(len(starts))
            k = at.as_py() % len(starts) if at.is_valid and len(starts) else None
            words.append(None if k is None else own.as_py()[starts[k] : ends[k]])
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.array(words, pa.string())], ["n", "words"])

    return word.asNondeterministic()(_col(text), _col(tokens), _col(place))


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
# A place has its text only where the text is at hand.
PLACE = [T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("words", T.StringType())]


def _placed_type(name: str, contexts: Sequence[int], words: bool) -> T.StructType:
    place = T.StructType(PLACE if words else PLACE[:2])
    return T.StructType([T.StructField(name, SPAN), *(T.StructField(f"at_{c}", place) for c in contexts)])


def _text_or_null(text: bool) -> Column:
    return F.col("text") if text else F.lit(None).cast("string")


class _Placed:
    """Spans gathered text by text, and the places with some tokens around them, as Arrow arrays."""

    def __init__(self, name: str, contexts: Sequence[int], words: bool):
        self.name, self.contexts, self.fields = name, list(contexts), PLACE if words else PLACE[:2]
        self.there, self.spans, self.places = [], [], {c: ([], [], []) for c in self.contexts}

    def add(self, text: str, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, stop: np.ndarray) -> None:
        self.there += [True] * len(first)
        self.spans.append(np.column_stack([first, stop]))
        for c, (begins, lasts, words) in self.places.items():
            a = starts[np.maximum(first - c, 0)].tolist()
            b = ends[np.minimum(stop + c, len(starts)) - 1].tolist()
            begins += a
            lasts += b
            if len(self.fields) == 3:
                words += [text[x:y] for x, y in zip(a, b)]

    def skip(self) -> None:
        """A span that was not found."""
        self.there.append(False)
        self.spans.append(np.zeros((1, 2), np.int64))
        for columns in self.places.values():
            for column in columns:
                column.append(None)

    def array(self) -> pa.StructArray:
        spans = np.concatenate(self.spans) if self.spans else np.zeros((0, 2), np.int64)
        gone = pa.array(~np.array(self.there, bool))
        span = pa.StructArray.from_arrays([pa.array(spans[:, k], pa.int32()) for k in (0, 1)], SPAN.names, mask=gone)
        kinds = (pa.int32(), pa.int32(), pa.string())
        names = [f.name for f in self.fields]
        places = [
            pa.StructArray.from_arrays([pa.array(x, kind) for x, kind, _ in zip(self.places[c], kinds, names)], names, mask=gone)
            for c in self.contexts
        ]
        return pa.StructArray.from_arrays([span, *places], [self.name, *(f"at_{c}" for c in self.contexts)])


def _packed_aspects(tokens: str) -> Column:
    @F.arrow_udf(T.ArrayType(SPAN))
    def aspects(blobs: pa.Array) -> pa.Array:
        edges, parts = [0], []
        for blob in blobs:
            _, _, numbers, names = unpack(blob.as_py())
            flags = np.isin(numbers, [k for k, name in enumerate(names) if name in ASPECT_TAGS])
            bounds = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
            parts.append(bounds.reshape(-1, 2))
            edges.append(edges[-1] + len(bounds) // 2)
        spans = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
        flat = pa.StructArray.from_arrays([pa.array(spans[:, k], pa.int32()) for k in (0, 1)], SPAN.names)
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), flat)

    return aspects.asNondeterministic()(F.col(tokens))


def _place_all(contexts: Sequence[int], text: bool, tokens: str, spans: str) -> Column:
    """All spans of a text and their places with some tokens around them; a text is read once for all its spans."""

    @F.arrow_udf(T.ArrayType(_placed_type("span", contexts, text)))
    def placed(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, blobs, spans in batches:
            at = 0
            for piece in text_pieces(texts):
                edges, found = [0], _Placed("span", contexts, text)
                for k in range(at, at + len(piece)):
                    starts, ends, *_ = unpack(blobs[k].as_py())
                    own = spans[k].values
                    found.add(
                        texts[k].as_py() or "", starts, ends,
                        own.field("start").to_numpy(zero_copy_only=False), own.field("stop").to_numpy(zero_copy_only=False),
                    )
                    edges.append(edges[-1] + len(own))
                at += len(piece)
                yield pa.ListArray.from_arrays(pa.array(edges, pa.int32()), found.array())

    return placed.asNondeterministic()(_text_or_null(text), F.col(tokens), F.col(spans))


def _find(contexts: Sequence[int], text: bool, tokens: str, begin: str, end: str) -> Column:
    """The span whose first token begins and whose last token ends at the given chars, and its places; null if there is none."""

    @F.arrow_udf(_placed_type("gold", contexts, text))
    def found(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, blobs, begins, stops in batches:
            at = 0
            for piece in text_pieces(texts):
                out = _Placed("gold", contexts, text)
                for k in range(at, at + len(piece)):
                    begin, stop = begins[k].as_py(), stops[k].as_py()
                    starts, ends, *_ = unpack(blobs[k].as_py())
                    first = last = np.zeros(0, np.int64)
                    if begin is not None:
                        first, last = np.flatnonzero(starts == begin)[:1], np.flatnonzero(ends == stop)[:1]
                    if len(first) and len(last):
                        out.add(texts[k].as_py() or "", starts, ends, first, last + 1)
                    else:
                        out.skip()
                at += len(piece)
                yield out.array()

    return found.asNondeterministic()(_text_or_null(text), F.col(tokens), F.col(begin), F.col(end))


def runs_of_true(flags) -> Column:
    """Maximal runs of true in a boolean array, as an array of (start, stop).

    A run starts at a true without a true before it and stops after a true without one
    behind it, so both ends are found by one linear pass each.
    """
    flags = _col(flags)
    last = F.size(flags) - 1

    def at(i: Column) -> Column:
        return F.coalesce(F.get(flags, i), F.lit(False))

    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: at(i) & ~at(i - 1))
    stops = F.transform(F.filter(places, lambda i: at(i) & ~at(i + 1)), lambda i: i + 1)
    return F.transform(
        F.arrays_zip(starts.alias("start"), stops.alias("stop")),
        lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")),
    )


def runs_of_true_rows(df: DataFrame, by: Sequence[str], place: str, flag: str) -> DataFrame:
    """The same runs from a long table with a dense ``place`` per group: (by..., start, stop)."""
    by = list(by)
    order = Window.partitionBy(*by).orderBy(place)
    marked = df.filter(F.col(flag)).select(*by, place, (F.col(place) - F.row_number().over(order)).alias("_island"))
    return marked.groupBy(*by, "_island").agg(
        F.min(place).alias("start"), (F.max(place) + 1).alias("stop")
    ).drop("_island")


def extract_aspects(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Add ``aspects``: the runs of noun and proper-noun tokens."""
    if is_packed(docs, tokens):
        return docs.withColumn("aspects", _packed_aspects(tokens))
    flagged = docs.withColumn("_flags", F.transform(tokens, lambda t: t["pos"].isin(*ASPECT_TAGS)))
    return flagged.withColumn("aspects", runs_of_true("_flags")).drop("_flags")


def _chars(tokens, start: Column, stop: Column, context: int) -> Column:
    """Char offsets of a span widened by ``context`` tokens on both sides."""
    tokens = _col(tokens)
    first = F.greatest(start - context, F.lit(0))
    last = F.least(stop + context, F.size(tokens)) - 1
    return F.named_struct(F.lit("begin"), F.get(tokens, first)["start"], F.lit("end"), F.get(tokens, last)["end"])


def place_span(spans: DataFrame, contexts: Sequence[int] = CONTEXTS, tokens: str = "tokens", span: str = "span") -> DataFrame:
    """Add ``at_<context>``, the char offsets of the span with that many tokens around it."""
    begin, end = F.col(span)["start"], F.col(span)["stop"]
    return spans.withColumns({f"at_{c}": _chars(tokens, begin, end, c) for c in contexts})


def explode_aspects(
    docs: DataFrame, keep: Sequence[str], contexts: Sequence[int] = CONTEXTS, tokens: str = "tokens"
) -> DataFrame:
    """One row (keep..., span, at_<context>...) per extracted aspect.

    Offsets are looked up before the explode, so the token array is not copied into every
    row.  The outer form with a filter behind it, as an inner explode of a computed array
    lets the planner copy the whole computation into a filter below it.  Of packed tokens, places have their
    ``words`` too if ``text`` is kept.
    """
    if is_packed(docs, tokens):
        return _explode_placed(extract_aspects(docs, tokens), keep, contexts, tokens)
    placed = F.transform(
        "aspects",
        lambda s: F.named_struct(
            F.lit("span"), s, *[x for c in contexts for x in (F.lit(f"at_{c}"), _chars(tokens, s["start"], s["stop"], c))]
        ),
    )
    rows = extract_aspects(docs, tokens).select(*keep, F.explode_outer(placed).alias("_a"))
    return rows.filter(F.col("_a").isNotNull()).select(*keep, "_a.*")


def _explode_placed(docs: DataFrame, keep: Sequence[str], contexts: Sequence[int], tokens: str) -> DataFrame:
    """The same from ``aspects`` and packed tokens."""
    placed = _place_all(contexts, "text" in keep, tokens, "aspects")
    rows = docs.select(*keep, F.explode_outer(placed).alias("_a"))
    return rows.filter(F.col("_a").isNotNull()).select(*keep, "_a.*")


def span_text(text, at) -> Column:
    """Text between two char offsets."""
    at = _col(at)
    return F.substr(_col(text), at["begin"] + 1, at["end"] - at["begin"])


def prepend_span(spans: DataFrame, context: int, text: str = "text", out: str = "input") -> DataFrame:
    """Add the model input: the span with ``context`` tokens on both sides, ':' and the whole text."""
    return spans.withColumn(out, F.concat(_words(spans, context, text), F.lit(":"), F.col(text)))


def _words(spans: DataFrame, context: int, text: str = "text") -> Column:
    """Text of the span with ``context`` tokens on both sides: cut already, or else cut here, which walks the text."""
    at = f"at_{context}"
    return F.col(at)["words"] if "words" in spans.schema[at].dataType.names else span_text(text, at)


def distinct_documents(docs: DataFrame, key: str) -> DataFrame:
    """One row per text where texts are the key; documents with an id of their own stay as they are."""
    return docs.dropDuplicates([key]) if key == "text" else docs


def _asked(df: DataFrame, overlapping: bool, key: str) -> DataFrame:
    """Span rows with the chars ``_begin`` and ``_end`` of the occurrence asked for, and ``_key`` to meet the documents by."""
    begin = nth_occurrence("text", "span", F.col("ordinal"), overlapping)
    rows = with_default_ordinal(df).withColumn("_key", _join_key(key)).withColumn("_begin", begin)
    return rows.withColumn("_end", F.col("_begin") + F.length("span"))


def _join_key(key: str) -> Column:
    """Texts meet by their digests, so that no text is shuffled for its name alone."""
    return F.sha2(F.col(key).cast("binary"), 256) if key == "text" else F.col(key)


def _answering(docs: DataFrame, key: str, columns: Sequence[str], tokens: str) -> DataFrame:
    """(_key, columns..., _tokens): packed tokens of the documents, one row a text where texts are the key."""
    rows = pack_tokens(docs, tokens).select(_join_key(key).alias("_key"), *columns, F.col(tokens).alias("_tokens"))
    return rows.dropDuplicates(["_key"]) if key == "text" else rows


def gold_spans(
    df: DataFrame, docs: DataFrame, overlapping: bool, key: str = "text", tokens: str = "tokens", contexts: Sequence[int] = ()
) -> DataFrame:
    """Token span of the ordinal-th occurrence of each annotated span.

    Adds ``gold``, NULL where the ordinal is too high or the occurrence does not begin
    and end with tokens, and ``at_<context>`` of it.  Searching may overlap (training) or not (prediction); it is
    done before the join, so that rows meet packed tokens alone.
    """
    joined = _asked(df, overlapping, key).join(_answering(docs, key, [], tokens), "_key")
    found = joined.withColumn("_found", _find(contexts, bool(contexts), "_tokens", "_begin", "_end"))
    return found.select(*with_default_ordinal(df).columns, "_found.*")


def touching_none(spans, gold) -> Column:
    """The spans of an array that touch none of the gold spans; ends that meet count as touching."""
    meets = lambda s: F.exists(_col(gold), lambda g: (s["start"] <= g["stop"]) & (g["start"] <= s["stop"]))
    return F.filter(_col(spans), lambda s: ~meets(s))


def non_overlapping(candidates: DataFrame, gold: DataFrame | str, key: str = "text", span: str = "span") -> DataFrame:
    """Candidates (key, span) that touch no gold span of the same text; ends that meet count as touching.

    An anti join on the text with an interval condition.  Gold spans are made distinct
    first, so a text annotated many times stays as small as its own length allows.  Where the candidates
    have their gold spans beside them, in an array column ``gold``, ``span`` is an array too, and its free spans stay.
    """
    if isinstance(gold, str):
        return candidates.withColumn(span, touching_none(span, gold))
    g = gold.select(F.col(key).alias("_key"), F.col("gold.start").alias("_a"), F.col("gold.stop").alias("_b")).distinct()
    touching = (
        (F.col(key) == F.col("_key")) & (F.col(f"{span}.start") <= F.col("_b")) & (F.col("_a") <= F.col(f"{span}.stop"))
    )
    return candidates.join(g, touching, "left_anti")


def span_training_sets(
    df: DataFrame, docs: DataFrame, key: str = "text", tokens: str = "tokens", written: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(aspect rows, polarity rows): input text and label for the two models.

    Aspect rows are the gold spans (true) and the extracted spans that touch none (false);
    polarity rows are the gold spans with their labels.  Documents that are a ``written`` table of packed tokens
    are read as they are, others are written first.
    """
    docs = docs if written else cut_lineage(pack_tokens(docs, tokens).select(*{key, "text"}, tokens), "annotated")
    # Gold spans and candidates read the same three columns of the documents, so that one shuffle of them serves both.
    own = _answering(docs, key, ["text"], tokens)
    asked = _asked(df, True, key)
    asked = asked.select(*(c for c in asked.columns if c != "text"))
    found = asked.join(own, "_key").withColumn("_found", _find(CONTEXTS, True, "_tokens", "_begin", "_end"))
    columns = [c for c in df.columns if c not in ("span", "text")]
    placed = found.select("_key", "text", *(c for c in columns if c != "text"), "_found.*")
    golds = placed.groupBy("_key").agg(F.collect_set("gold").alias("_golds"))
    names = own.join(golds, "_key")
    names = names if key == "text" else names.withColumnRenamed("_key", key)
    free = non_overlapping(extract_aspects(names, "_tokens"), "_golds", key, "aspects")
    false = _explode_placed(free, list(dict.fromkeys([key, "text"])), [ASPECT_CONTEXT], "_tokens")
    true = placed.filter("gold is not null").withColumnRenamed("gold", "span")
    near, kept = f"at_{ASPECT_CONTEXT}", list(dict.fromkeys([key, "text"]))
    rows = true.select(*kept, "span", near, F.lit(True).alias("label")).unionByName(
        false.select(*kept, "span", near, F.lit(False).alias("label"))
    )
    aspect = prepend_span(rows, ASPECT_CONTEXT)
    polarity = prepend_span(true, POLARITY_CONTEXT)
    return aspect.select(key, "span", "input", "label"), polarity.select(key, "span", "input", "label")


def filter_aspects(spans: DataFrame, pred: str = "pred_label") -> DataFrame:
    return spans.filter(F.col(pred) == "aspect")


Model = Callable[[DataFrame], DataFrame]


def predict_spans(docs: DataFrame, aspect_model: Model, polarity_model: Model, key: str = "row_id") -> DataFrame:
    """Per text the list of {span, polarity}, empty if it has none: (key, spans).

    A model adds ``pred_label`` to rows with ``input``.  The span texts of a document are cut in one reading
    of it, before they become rows.  Candidates and both models run without a shuffle; only the short
    spans are gathered per text.
    """
    docs = cut_lineage(pack_tokens(docs), "tagged")
    candidates = explode_aspects(docs, [key, "text"])
    kept = filter_aspects(aspect_model(prepend_span(candidates, ASPECT_CONTEXT))).drop("pred_label", "input")
    judged = polarity_model(prepend_span(kept, POLARITY_CONTEXT))
    words = _words(judged, ASPECT_CONTEXT)
    found = judged.select(
        key, F.struct(F.col("span.start").alias("at"), words.alias("span"), F.col("pred_label").alias("polarity")).alias("s")
    )
    lists = found.groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("_s"))
    plain = F.transform("_s", lambda s: F.struct(s["span"].alias("span"), s["polarity"].alias("polarity")))
    empty = F.array().cast("array<struct<span:string,polarity:string>>")
    return docs.select(key).join(lists, key, "left").select(key, F.coalesce(plain, empty).alias("spans"))


def predict_gold_polarity(
    df: DataFrame, docs: DataFrame, polarity_model: Model, row_id: str = "row_id", key: str = "text"
) -> DataFrame:
    """Add ``pred_polarity`` to annotated spans, NULL where a span is not found in the tokens."""
    rows = with_default_ordinal(df)
    placed = gold_spans(rows, docs, overlapping=False, key=key, contexts=[POLARITY_CONTEXT]).filter("gold is not null")
    inputs = prepend_span(placed, POLARITY_CONTEXT)
    judged = polarity_model(inputs).select(row_id, F.col("pred_label").alias("pred_polarity"))
    return rows.join(judged, row_id, "left")


def span_evaluate(aspect_preds: DataFrame, polarity_preds: DataFrame) -> DataFrame:
    """Accuracy of both models: (model, accuracy)."""
    return (
        accuracy(aspect_preds)
        .select(F.lit("aspect").alias("model"), "accuracy")
        .unionByName(accuracy(polarity_preds).select(F.lit("polarity").alias("model"), "accuracy"))
    )
