"""Repeated passages, byte for byte, by a distributed merge sort of sampled suffixes.

A byte goes if a string of ``length`` bytes covers it that also starts earlier: in a document with a smaller
id, or earlier in the same document. Only the suffixes at anchors are sorted. The anchor of a window of
``length`` bytes is the place of the smallest hash among its strings of HEAD bytes (the leftmost on ties), so
equal windows have their anchors at the same offset, and each window belongs to one anchor.

1. Texts are written as runs of a few megabytes, bucketed by run; later steps read runs where they lie.
2. Every run sends the hashes and counts of its anchors' heads; two bits per head come back: does another run have
   it, too, and are there more than ``hot`` of it? Heads found once take part no further, so unique
   text is never exchanged.
3. Every run sorts its remaining suffixes, each with the bytes that its windows reach to the left. Equal ones are
   collapsed to the first, which settles the others. The sorted run is front-coded (length of the
   prefix shared with the suffix before, then the rest) and cut at splitters of the heads.
4. One task per range combines its runs with a loser tree that compares suffixes only past the prefix
   both are known to share with the last one out. Suffixes with the same head stand next to each other; the
   windows of each are looked up among the earlier ones, and compared byte for byte.
5. Suffixes with a hot head, say inside a line of a third of all documents, would fill one range. Their windows go
   by a 128-bit digest instead, the first of each in a run only, so equal ones meet once per run
   and different ones spread over all tasks.
6. The windows found go back to the runs, which cut the bytes they cover.

Defined results: a null text is empty; documents shorter than ``length`` keep all bytes. Rows without id come
after all others. Rows that repeat an id are one document: a string at the same id and start is not
earlier. An empty table gives no rows; extra columns take no part.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from handful.llm.common import as_batch, byte_values
from handful.session import cut_lineage, shared_path

HEAD = 32
RUN_BYTES = 4 << 20
SLICE = 1 << 16
PIECE = 1 << 16
SPLITTER_SAMPLE = 50_000
HOT = 4096
LAST_ID = np.iinfo(np.int64).max
LOW32 = np.uint64(0xFFFFFFFF)
_RNG = np.random.default_rng(20240229)
BYTE_HASH = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15


def head_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the HEAD bytes from each place that has as many."""
    own, size = BYTE_HASH[data], 1
    while size < HEAD:
        factor = np.uint64(pow(BASE, size, 1 << 64))
        own = own[:-size] * factor + own[size:]
        size *= 2
    own = own ^ (own >> np.uint64(31))
    own = own * np.uint64(0xD6E8FEB86659FD93)
    return own ^ (own >> np.uint64(32))


def spread(hashes: np.ndarray) -> np.ndarray:
    """Hashes of anchors, which are small ones, spread evenly again; different ones stay different."""
    hashes = hashes * np.uint64(0xBF58476D1CE4E5B9)
    hashes = hashes ^ (hashes >> np.uint64(32))
    return hashes * np.uint64(0x94D049BB133111EB)


def anchors_of_windows(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor place of each window, hash of the head at each place)."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    reach = length - HEAD + 1
    anchors, hashes = [], []
    total = len(data) - length + 1
    for at in range(0, total, PIECE):
        n = min(PIECE, total - at)
        own = head_hashes(data[at : at + n + length - 1])
        hashes.append(own[:n] if at + n < total else own)
        low = (own & ~LOW32) | np.arange(len(own), dtype=np.uint64)
        size = 1
        while 2 * size <= reach:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < reach:
            low = np.minimum(low[: len(low) - (reach - size)], low[reach - size :])
        anchors.append((low[:n] & LOW32).astype(np.int64) + at)
    return np.concatenate(anchors), np.concatenate(hashes)


class Run:
    """Texts of one run, its anchors, and the windows [first, last] that belong to each."""

    def __init__(self, texts: list[bytes], ids: list, length: int):
        self.length = length
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.ids = np.array([LAST_ID if i is None else i for i in ids], np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        window, hashes = anchors_of_windows(self.data, length)
        stop = np.repeat(self.begins + self.sizes, self.sizes)[: len(window)]
        places = np.flatnonzero(np.arange(len(window)) + length <= stop)
        window = window[places]
        cuts = np.flatnonzero(np.diff(window)) + 1
        heads = np.r_[0, cuts] if len(window) else cuts
        self.place = window[heads]
        self.first = places[heads]
        self.last = places[np.r_[cuts - 1, len(window) - 1]] if len(window) else self.first
        self.hash = spread(hashes[self.place])
        self.owner = np.searchsorted(self.begins + self.sizes, self.place, "right")

    def suffixes(self, chosen: np.ndarray) -> np.ndarray:
        """Rows of bytes that sort as the suffixes at some anchors.

        Each is the bytes from the anchor to the end of its last window, their number, the bytes
        from the anchor back to its first window, and their number; unused places are 0.
        """
        back = self.length - HEAD
        right = self.last[chosen] + self.length - self.place[chosen]
        left = self.place[chosen] - self.first[chosen]
        out = np.zeros((len(chosen), self.length + back + 2), np.uint8)
        data = np.concatenate([np.zeros(back, np.uint8), self.data, np.zeros(self.length, np.uint8)])
        at = (self.place[chosen][:, None] + back).astype(np.int32)
        ahead, behind = np.arange(self.length, dtype=np.int32), np.arange(1, back + 1, dtype=np.int32)
        out[:, : self.length] = np.where(ahead < right[:, None], data[at + ahead], 0)
        out[:, self.length] = right
        out[:, self.length + 1 : -1] = np.where(behind <= left[:, None], data[at - behind], 0)
        out[:, -1] = left
        return out


def shared_sizes(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before, from the first on."""
    apart = rows[1:] != rows[:-1]
    sizes = np.where(apart.any(1), apart.argmax(1), rows.shape[1])
    return np.r_[0, sizes].astype(np.uint8) if len(rows) else np.zeros(0, np.uint8)


def pack(rows: np.ndarray, ids: np.ndarray, starts: np.ndarray, owners: np.ndarray) -> bytes:
    """A front-coded block: counts, shared sizes, ids, starts and owners, then the rests of all rows."""
    shared = shared_sizes(rows)
    rest = rows[np.arange(rows.shape[1]) >= shared[:, None]]
    parts = [np.array([len(rows)], "<i4"), shared, ids.astype("<i8"), starts.astype("<i4"), owners.astype("<i4"), rest]
    return zstandard.compress(b"".join(p.tobytes() for p in parts), 3)


def unpack(block: bytes, width: int):
    """(shared sizes, ids, starts, owners, rows as bytes) of a front-coded block."""
    block = zstandard.decompress(block)
    n = int(np.frombuffer(block, "<i4", 1)[0])
    shared = np.frombuffer(block, np.uint8, n, 4)
    ids = np.frombuffer(block, "<i8", n, 4 + n)
    starts = np.frombuffer(block, "<i4", n, 4 + 9 * n)
    owners = np.frombuffer(block, "<i4", n, 4 + 13 * n)
    rest, at, before, rows = block[4 + 17 * n :], 0, b"", []
    for known in shared.tolist():
        size = width - known
        before = before[:known] + rest[at : at + size]
        rows.append(before)
        at += size
    return shared.tolist(), ids, starts, owners, rows


def first_difference(a: bytes, b: bytes, at: int) -> int:
    """The first place from ``at`` where two rows of equal size differ, or their size."""
    apart = int.from_bytes(a[at:], "big") ^ int.from_bytes(b[at:], "big")
    return len(a) - (apart.bit_length() + 7) // 8


def merge(runs: list[tuple[list[int], list[bytes]]]):
    """(run, number in the run, bytes shared with the row before) of all rows in order.

    A loser tree over sorted runs. Every row in it carries the size of the prefix it shares with the last
    row out: of two, the one that shares more is smaller, and only on equal sizes are bytes compared, from there on.
    """
    leaves = 1
    while leaves < max(len(runs), 1):
        leaves *= 2
    shared: list[int] = [0] * leaves
    rows: list[bytes | None] = [r[1][0] if r[1] else None for r in runs] + [None] * (leaves - len(runs))
    number = [0] * leaves
    loser = [0] * leaves

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser then shares with the winner what it carries."""
        x, y = rows[a], rows[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = shared[a], shared[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        at = first_difference(x, y, p)
        if at == len(x):
            winner, other = (a, b) if a < b else (b, a)
        else:
            winner, other = (a, b) if x[at] < y[at] else (b, a)
        shared[other] = at
        return winner, other

    winners = list(range(leaves))
    node = leaves
    while node > 1:
        node //= 2
        following = []
        for k in range(node):
            w, lost = play(winners[2 * k], winners[2 * k + 1])
            loser[node + k] = lost
            following.append(w)
        winners = following
    top = winners[0]
    while rows[top] is not None:
        yield top, number[top], shared[top]
        sizes, own = runs[top]
        number[top] = nth = number[top] + 1
        if nth < len(own):
            x, p = own[nth], sizes[nth]
        else:
            x, p = None, 0
        rows[top], shared[top] = x, p
        at = (leaves + top) // 2
        while at:
            other = loser[at]
            y = rows[other]
            if y is not None:
                q = shared[other]
                swap = x is None or q > p
                if q == p and x is not None:
                    same = first_difference(x, y, p)
                    swap = other < top if same == len(x) else y[same] < x[same]
                    shared[top if swap else other] = same
                if swap:
                    top, loser[at] = other, top
                    x, p = y, shared[other]
            at //= 2


def compared_windows(text, group, ids, starts, counts, length, right):
    """As ``repeated_windows``, where two different windows share a hash: by their bytes, rows in order of places."""
    first: dict[tuple[int, int, bytes], int] = {}
    found = []
    for r in range(len(text)):
        for offset in range(length - int(right[r]), length - int(right[r]) + int(counts[r])):
            begin = length - HEAD - offset
            k = first.setdefault((int(group[r]), offset, text[r, begin : begin + length].tobytes()), r)
            if (ids[k], starts[k]) != (ids[r], starts[r]):
                found.append((r, offset))
    both = np.array(found, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def repeated_windows(rows: np.ndarray, group: np.ndarray, ids: np.ndarray, starts: np.ndarray, length: int):
    """(row, offset) of the windows that an earlier row of the group has at the same offset.

    ``starts`` are the anchors' places in their documents; the window at offset d starts d bytes before.
    """
    back = length - HEAD
    # In the order of places, so that the first of equal windows is the earliest.
    sorted_by = np.lexsort((starts, ids))
    rows, group, ids, starts = rows[sorted_by], group[sorted_by], ids[sorted_by], starts[sorted_by]
    right, left = rows[:, length].astype(np.int64), rows[:, -1].astype(np.int64)
    text = np.concatenate([rows[:, -2:length:-1], rows[:, :length]], 1)
    # Hash of a window from hashes of the row's beginnings: h(i + length) - h(i) * BASE^length.
    upto = np.zeros((text.shape[1] + 1, len(rows)), np.uint64)
    for k, column in enumerate(np.ascontiguousarray(text.T)):
        upto[k + 1] = upto[k] * np.uint64(BASE) + BYTE_HASH[column]
    counts = np.maximum(left - (length - right) + 1, 0)
    row = np.repeat(np.arange(len(rows)), counts)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts - (length - right), counts)
    begin = back - offset
    key = upto[begin + length, row] - upto[begin, row] * np.uint64(pow(BASE, length, 1 << 64))
    key ^= (group[row] * 128 + offset).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    again = np.flatnonzero(~new)
    first = order[np.flatnonzero(new)[np.cumsum(new)[again] - 1]]
    row, offset, leader = row[order[again]], offset[order[again]], row[first]
    later = (ids[row] != ids[leader]) | (starts[row] != starts[leader])
    row, offset, leader = row[later], offset[later], leader[later]
    # Byte for byte: no difference between the row and the leader inside the window.
    pairs, of = np.unique(row * len(rows) + leader, return_inverse=True)
    apart = np.zeros((len(pairs), text.shape[1] + 1), np.uint8)
    np.cumsum(text[pairs // len(rows)] != text[pairs % len(rows)], axis=1, out=apart[:, 1:])
    same = apart[of, back - offset + length] == apart[of, back - offset]
    if not same.all():
        row, offset = compared_windows(text, group, ids, starts, counts, length, right)
    return sorted_by[row], offset


WINDOW = np.dtype([("high", "<u8"), ("low", "<u8"), ("id", "<i8"), ("start", "<i4"), ("owner", "<i4")])


def digests(run: Run, chosen: np.ndarray) -> np.ndarray:
    """All windows of some anchors, by digest."""
    counts = run.last[chosen] - run.first[chosen] + 1
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = np.repeat(run.first[chosen], counts) + nth
    data = run.data.tobytes()
    made = b"".join(hashlib.blake2b(data[b : b + run.length], digest_size=16).digest() for b in begin.tolist())
    out = np.zeros(len(begin), WINDOW)
    both = np.frombuffer(made, "<u8").reshape(-1, 2)
    out["high"], out["low"] = both[:, 0], both[:, 1]
    out["owner"] = np.repeat(run.owner[chosen], counts)
    out["id"], out["start"] = run.ids[out["owner"]], begin - run.begins[out["owner"]]
    return out


def later_windows(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows in order of digest and place, which of them an earlier place has, too)."""
    found = found[np.lexsort((found["start"], found["id"], found["low"], found["high"]))]
    if not len(found):
        return found, np.zeros(0, bool)
    new = np.r_[True, (found["high"][1:] != found["high"][:-1]) | (found["low"][1:] != found["low"][:-1])]
    leader = found[np.flatnonzero(new)][np.cumsum(new) - 1]
    return found, (leader["id"] != found["id"]) | (leader["start"] != found["start"])


def spans(owner: np.ndarray, first: np.ndarray, last: np.ndarray) -> bytes:
    return np.stack([owner, first, last], 1).astype("<i4").tobytes()


def to_spans(owner: np.ndarray, window: np.ndarray) -> bytes:
    """Windows as spans of neighbouring window starts of the same document."""
    if not len(owner):
        return b""
    order = np.lexsort((window, owner))
    owner, window = owner[order], window[order]
    new = np.r_[True, (np.diff(owner) != 0) | (np.diff(window) > 1)]
    heads = np.flatnonzero(new)
    return spans(owner[heads], window[heads], window[np.r_[heads[1:] - 1, len(owner) - 1]])


def write_runs(docs: DataFrame, key: str, text: str, buckets: int) -> DataFrame:
    """(run, nth, id, text) as a table in the shared folder, bucketed by run."""
    spark = docs.sparkSession
    shape = pa.schema([("run", pa.int64()), ("nth", pa.int32()), ("id", pa.int64()), ("text", pa.binary())])

    def assign(batches):
        run, nth, held = None, 0, 0
        for batch in batches:
            runs, order = [], []
            texts = byte_values(batch.column(1))
            for body in texts:
                if run is None or held and held + len(body) > RUN_BYTES:
                    run, nth, held = uuid.uuid4().int >> 65, 0, 0
                runs.append(run)
                order.append(nth)
                nth, held = nth + 1, held + len(body)
            yield as_batch(shape, run=runs, nth=order, id=batch.column(0), text=texts)

    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    name = f"runs_{uuid.uuid4().hex}"
    (
        rows.mapInArrow(assign, "run bigint, nth int, id bigint, text binary")
        .write.bucketBy(buckets, "run")
        .sortBy("run")
        .option("path", shared_path(spark, "suffix-runs"))
        .option("compression", "zstd")
        .saveAsTable(name)
    )
    table = spark.table(name)
    # The name is needed no longer; the files in the shared folder stay.
    spark.sql(f"DROP TABLE {name}")
    return table


def run_of(docs: pa.Table, length: int) -> Run:
    docs = docs.sort_by("nth")
    return Run(byte_values(docs["text"].combine_chunks()), docs["id"].to_pylist(), length)


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, hot: int = HOT
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept (bytes), kept_sha256."""
    if not HEAD < length <= 127 + HEAD:
        raise ValueError(f"length is from {HEAD + 1} to {127 + HEAD}")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = write_runs(docs, key, text, parts)
    width = 2 * length - HEAD + 2

    sent = pa.schema(
        [
            ("bucket", pa.int32()),
            ("run", pa.int64()),
            ("heads", pa.binary()),
            ("counts", pa.binary()),
            ("sample", pa.list_(pa.binary())),
        ]
    )

    def bucket_bounds(found: np.ndarray) -> np.ndarray:
        bucket = ((found >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        return np.searchsorted(bucket, np.arange(parts + 1))

    def heads(name: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = run_of(table, length)
        found, times = np.unique(own.hash, return_counts=True)
        times = np.minimum(times, 0xFFFF).astype("<u2")
        bounds = bucket_bounds(found)
        full = np.flatnonzero(np.diff(bounds))
        step = max(1, len(own.place) // 32)
        drawn = [own.data[p : p + HEAD].tobytes() for p in own.place[::step].tolist()]
        return pa.Table.from_batches(
            [
                as_batch(
                    sent,
                    bucket=full,
                    run=np.full(len(full), name[0].as_py()),
                    heads=[found[bounds[b] : bounds[b + 1]].astype("<u8").tobytes() for b in full.tolist()],
                    counts=[times[bounds[b] : bounds[b + 1]].tobytes() for b in full.tolist()],
                    sample=[drawn if k == 0 else [] for k in range(len(full))],
                )
            ]
        )

    told = pa.schema([("run", pa.int64()), ("bucket", pa.int32()), ("bits", pa.binary()), ("hot", pa.binary())])

    def compare(name: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(b, "<u8") for b in byte_values(table["heads"].combine_chunks())]
        counts = np.frombuffer(b"".join(byte_values(table["counts"].combine_chunks())), "<u2")
        _, back, runs_with = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        twice = (runs_with > 1)[back]
        full = twice & (np.bincount(back, counts) > hot)[back]
        cuts = np.cumsum([0, *map(len, lists)]).tolist()
        packed = [[np.packbits(x[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])] for x in (twice, full)]
        return pa.Table.from_batches(
            [as_batch(told, run=table["run"].combine_chunks(), bucket=[name[0].as_py()] * len(lists), bits=packed[0], hot=packed[1])]
        )

    announced = cut_lineage(
        runs.groupBy("run").applyInArrow(heads, "bucket int, run bigint, heads binary, counts binary, sample array<binary>"),
        "suffix-heads",
    )
    repeated = announced.select("bucket", "run", "heads", "counts").groupBy("bucket").applyInArrow(
        compare, "run bigint, bucket int, bits binary, hot binary"
    )
    sample = announced.where(F.size("sample") > 0).select(F.explode("sample").alias("head"))
    drawn = [bytes(r["head"]) for r in sample.orderBy(F.xxhash64("head")).limit(SPLITTER_SAMPLE).collect()]
    drawn = sorted(set(drawn))
    splitters = np.array(drawn, f"S{HEAD}")[np.arange(1, parts) * len(drawn) // parts] if drawn else np.zeros(0, "S1")
    splitters = np.unique(splitters)

    sorted_run = pa.schema([("part", pa.int32()), ("run", pa.int64()), ("block", pa.binary())])

    def sort(name: tuple[pa.Scalar, ...], table: pa.Table, flags: pa.Table) -> pa.Table:
        if not table.num_rows:
            return sorted_run.empty_table()
        own = run_of(table, length)
        run = name[0].as_py()
        settled_part = 2 * parts + run % parts
        found, back, times = np.unique(own.hash, return_inverse=True, return_counts=True)
        bounds = bucket_bounds(found)
        marked, full = times > 1, np.zeros(len(found), bool)
        for bucket, bits, more in zip(
            flags["bucket"].to_pylist(), *(byte_values(flags[c].combine_chunks()) for c in ("bits", "hot"))
        ):
            a, b = bounds[bucket], bounds[bucket + 1]
            marked[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
            full[a:b] = np.unpackbits(np.frombuffer(more, np.uint8), count=b - a).astype(bool)
        wanted = np.flatnonzero(marked[back])
        # In the order of ids and places, so that the first of equal suffixes is the earliest.
        starts = own.place - own.begins[own.owner]
        wanted = wanted[np.lexsort((starts[wanted], own.ids[own.owner[wanted]]))]
        out, crowded = [], []
        for at in range(0, len(wanted), SLICE):
            chosen = wanted[at : at + SLICE]
            rows = own.suffixes(chosen)
            order = np.argsort(rows.view(f"S{width}").reshape(-1), kind="stable")
            rows, chosen = rows[order], chosen[order]
            new = np.r_[True, (rows[1:] != rows[:-1]).any(1)]
            leader = chosen[np.flatnonzero(new)][np.cumsum(new) - 1]
            owner, place = own.owner[chosen], own.place[chosen]
            ids, start = own.ids[owner], starts[chosen]
            later = ~new & ((ids != own.ids[own.owner[leader]]) | (start != starts[leader]))
            settled = chosen[later]
            begin = own.begins[own.owner[settled]]
            if len(settled):
                windows = spans(own.owner[settled], own.first[settled] - begin, own.last[settled] - begin)
                out.append((settled_part, run, windows))
            # A suffix equal to the leader in id and start as well goes on with it.
            crowded.append(chosen[~later & full[back[chosen]]])
            stays = ~later & ~full[back[chosen]]
            rows, ids, start, owner = rows[stays], ids[stays], start[stays], owner[stays]
            part = np.searchsorted(splitters, np.ascontiguousarray(rows[:, :HEAD]).view(f"S{HEAD}").reshape(-1), "right")
            cuts = np.searchsorted(part, np.arange(len(splitters) + 2))
            for p in np.unique(part).tolist():
                a, b = cuts[p], cuts[p + 1]
                out.append((p, run, pack(rows[a:b], ids[a:b], start[a:b], owner[a:b])))
        if crowded and len(chosen := np.concatenate(crowded)):
            many, later = later_windows(digests(own, chosen))
            if later.any():
                out.append((settled_part, run, to_spans(many["owner"][later], many["start"][later])))
            many = many[~later]
            bucket = ((many["high"] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            cuts = np.searchsorted(bucket, np.arange(parts + 1))
            out += [(parts + b, run, many[cuts[b] : cuts[b + 1]].tobytes()) for b in np.unique(bucket).astype(int).tolist()]
        if not out:
            return sorted_run.empty_table()
        part, names, blocks = zip(*out)
        return pa.Table.from_batches([as_batch(sorted_run, part=part, run=names, block=blocks)])

    sorted_runs = (
        runs.groupBy("run")
        .cogroup(repeated.groupBy("run"))
        .applyInArrow(sort, "part int, run bigint, block binary")
    )
    windows = pa.schema([("run", pa.int64()), ("spans", pa.binary())])

    def combine(name: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        names = table["run"].to_pylist()
        blocks = [unpack(b, width) for b in byte_values(table["block"].combine_chunks())]
        base = np.cumsum([0, *(len(b[0]) for b in blocks)]).tolist()
        ids, starts, owners = (np.concatenate([b[k] for b in blocks]) for k in (1, 2, 3))
        all_rows = [row for b in blocks for row in b[4]]
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in blocks]

        def settle(batch: list[int], sizes: list[int]) -> None:
            """Windows of some whole groups of suffixes with the same head."""
            own = np.array(batch)
            rows = np.frombuffer(b"".join([all_rows[k] for k in batch]), np.uint8).reshape(-1, width)
            group = np.repeat(np.arange(len(sizes)), sizes)
            row, offset = repeated_windows(rows, group, ids[own].astype(np.int64), starts[own].astype(np.int64), length)
            own = own[row]
            run = np.searchsorted(base, own, "right") - 1
            order = np.argsort(run, kind="stable")
            own, run, start = own[order], run[order], (starts[own] - offset)[order]
            cuts = np.r_[0, np.flatnonzero(np.diff(run)) + 1, len(run)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b > a:
                    found[run[a]].append((owners[own[a:b]], start[a:b]))

        batch: list[int] = []
        sizes: list[int] = []
        group: list[int] = []
        for run, nth, shared in merge([(b[0], b[4]) for b in blocks]):
            if shared < HEAD:
                if len(group) > 1:
                    batch += group
                    sizes.append(len(group))
                    if len(batch) >= 8192:
                        settle(batch, sizes)
                        batch, sizes = [], []
                group = []
            group.append(base[run] + nth)
        if len(group) > 1:
            batch += group
            sizes.append(len(group))
        if batch:
            settle(batch, sizes)
        out = [(n, to_spans(*(np.concatenate(x) for x in zip(*f)))) for n, f in zip(names, found) if f]
        if not out:
            return windows.empty_table()
        return pa.Table.from_batches([as_batch(windows, run=[o[0] for o in out], spans=[o[1] for o in out])])

    def look_up(name: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        names = table["run"].to_numpy()
        lists = [np.frombuffer(b, WINDOW) for b in byte_values(table["block"].combine_chunks())]
        run = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        found = np.concatenate(lists)
        order = np.lexsort((found["start"], found["id"], found["low"], found["high"]))
        run = run[order]
        found, later = later_windows(found[order])
        out = []
        for r in np.unique(run[later]).tolist():
            mine = later & (run == r)
            out.append((names[r], to_spans(found["owner"][mine], found["start"][mine])))
        if not out:
            return windows.empty_table()
        return pa.Table.from_batches([as_batch(windows, run=[o[0] for o in out], spans=[o[1] for o in out])])

    def meet(name: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Ranges of suffixes, then buckets of windows with a hot head, then what the runs settled themselves."""
        part = name[0].as_py()
        if part < 2 * parts:
            return (combine if part < parts else look_up)(name, table)
        return pa.Table.from_arrays([table["run"], table["block"]], schema=windows)

    # One exchange carries all three kinds, so that runs are sorted once and not written in between.
    merged = sorted_runs.groupBy("part").applyInArrow(meet, "run bigint, spans binary")
    results = pa.schema(
        [
            ("id", pa.int64()),
            ("n_bytes", pa.int64()),
            ("n_removed", pa.int64()),
            ("n_spans", pa.int64()),
            ("kept", pa.binary()),
            ("kept_sha256", pa.string()),
        ]
    )

    def cut(name: tuple[pa.Scalar, ...], table: pa.Table, found: pa.Table) -> pa.Table:
        table = table.sort_by("nth")
        gone = np.frombuffer(b"".join(byte_values(found["spans"].combine_chunks())), "<i4").reshape(-1, 3)
        gone = gone[np.argsort(gone[:, 0], kind="stable")]
        bounds = np.searchsorted(gone[:, 0], np.arange(table.num_rows + 1))
        out = []
        for k, (doc_id, body) in enumerate(zip(table["id"].to_pylist(), byte_values(table["text"].combine_chunks()))):
            own = gone[bounds[k] : bounds[k + 1]]
            removed = pieces = 0
            if len(own):
                edge = np.zeros(len(body) + 1, np.int32)
                np.add.at(edge, own[:, 1], 1)
                np.add.at(edge, own[:, 2] + length, -1)
                covered = np.cumsum(edge)[:-1] > 0
                removed = int(covered.sum())
                pieces = int((np.diff(np.r_[0, covered.astype(np.int8)]) == 1).sum())
                kept = np.frombuffer(body, np.uint8)[~covered].tobytes()
            else:
                kept = body
            out.append((doc_id, len(body), removed, pieces, kept, hashlib.sha256(kept).hexdigest()))
        columns = zip(*out) if out else ((),) * 6
        return pa.Table.from_batches([as_batch(results, **dict(zip(results.names, columns)))])

    return (
        runs.groupBy("run")
        .cogroup(merged.groupBy("run"))
        .applyInArrow(
            cut, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string"
        )
    )
