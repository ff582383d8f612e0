"""SentencePiece encoding and decoding with a public byte-pair model, by suffix-array matching.

Each task splits its texts into segments that no piece can cross (a run of spaces with the word that
follows; line feeds apart). The distinct new segments of a batch are concatenated and
indexed by a suffix array; every piece of the vocabulary is binary-searched for its range of
occurrences; the ranges become edges, sorted by where they end, and are relaxed from left to right. An
edge extends the encoding of the prefix before it if its piece and that prefix's last piece stay apart
when encoded together; merges are local, so for every prefix exactly one edge does, and the edges
followed back from a segment's end are its byte-pair encoding. Which pairs of pieces stay apart is found by
merging each pair once. Encodings of segments are kept in a cache of bounded size.

Characters without a piece become byte pieces. The model is read on the driver from a path
and sent to the executors; it is bounded (some 32,000 pieces).

Defined results: a null or empty text has no pieces. Decoding turns the piece space back into spaces, so a
text that holds the character U+2581 itself comes back with spaces there and ``round_trip`` is false; it is
true for all others. Long texts are encoded whole; a segment of more than ``LONG`` bytes without a space is merged by a heap, in
time and memory in proportion to it. Rows that repeat an id stay rows;
an empty table gives no rows; extra columns take no part.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from handful.llm.common import rows_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
SEGMENT = re.compile(rb" *[^ \n]+|\n+| +")
# Segments a worker keeps, some 50 MB; workers live on after their task.
CACHED, CACHED_BYTES = 200_000, 16 << 20
BATCH_BYTES = 512 << 10
# New segments are matched in parts of so many bytes, as the tables of a part take some hundred times its bytes.
NEW_BYTES = 128 << 10
# Rows of a batch that are Python objects at a time.
BATCH_ROWS = 512
SLOTS = 20
# Pairs a worker knows at most, some 4 MB; beyond, it starts anew.
PAIRS = 400_000
# Segments of more bytes are merged by a heap.
LONG = 512
END = 0xFF


def windows(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number, first byte highest; past the end is END."""
    wide = np.concatenate([data, np.full(8, END, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | wide[k : k + len(data)]
    return out


def suffix_array(data: np.ndarray, eight: np.ndarray) -> np.ndarray:
    """Places of the data in the order of their next sixteen bytes, from the ranks of eight and eight more."""
    order = np.argsort(eight, kind="stable")
    key = eight[order]
    rank = np.empty(len(data), np.uint64)
    rank[order] = np.cumsum(np.r_[False, key[1:] != key[:-1]]).astype(np.uint64)
    after = np.full(len(data), len(data), np.uint64)
    after[: max(len(data) - 8, 0)] = rank[8:]
    return np.argsort((rank << np.uint64(32)) | after, kind="stable")


class Pieces:
    """Vocabulary, matcher and cache; one per worker."""

    def __init__(self, model: bytes):
        own = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = own.get_piece_size()
        names = [own.id_to_piece(i) for i in range(size)]
        plain = [
            i
            for i in range(size)
            if not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i) or own.is_unused(i))
        ]
        self.rank = {names[i]: (-own.get_score(i), i) for i in plain}
        self.longest = max(map(len, self.rank), default=0)
        self.names = names
        self.unknown = size
        self.byte_ids = np.array([own.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        known = {n for n in self.rank if len(n) == 1}
        if any(c not in known for n in self.rank for c in n):
            raise ValueError("a piece holds a character that is no piece itself")
        if any(SPACE in n.lstrip(SPACE) or "\n" in n for n in self.rank):
            raise ValueError("a piece crosses a space or a line end")
        self.codes = [n.encode() for n in self.rank]
        self.code_ids = np.array([i for _, i in self.rank.values()], np.int64)
        self.code_sizes = np.array([len(c) for c in self.codes])
        words = max(2, -(-int(self.code_sizes.max()) // 8))
        low = np.zeros((len(self.codes), words * 8), np.uint8)
        high = np.full((len(self.codes), words * 8), END, np.uint8)
        for k, code in enumerate(self.codes):
            low[k, : len(code)] = high[k, : len(code)] = np.frombuffer(code, np.uint8)
        self.low = low.view(">u8").astype(np.uint64)
        self.high = high.view(">u8").astype(np.uint64)
        texts = [b""] * (size + 1)
        for name, (_, i) in self.rank.items():
            texts[i] = name.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids.tolist()):
            texts[i] = bytes([b])
        self.text_sizes = np.array([len(t) for t in texts])
        self.text_starts = np.cumsum(self.text_sizes) - self.text_sizes
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        self.alone = np.full(size + 1, -1, np.int8)
        self.alone[self.unknown] = 1
        # Known pairs in order, and a table of slots that finds most of them at once.
        self.pairs, self.apart = np.array([-1]), np.array([False])
        self.slot_pair, self.slot_apart = np.full(1 << SLOTS, -1), np.zeros(1 << SLOTS, bool)
        self.forget()

    def forget(self) -> None:
        """Empty the cache of segments."""
        self.number: dict[bytes, int] = {}
        self.held = 0
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def merge(self, text: str) -> list[int]:
        """Byte-pair encoding of a few known characters: best piece first, leftmost on ties."""
        parts = list(text)
        while True:
            found = [(self.rank[a + b][0], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank]
            if not found:
                return [self.rank[p][1] for p in parts]
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def merge_long(self, text: str) -> list[int]:
        """The same of a long text, also with characters that have no piece, by a heap of neighbours."""
        parts, n = list(text), len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, longest = self.rank, self.longest
        heap = []

        def join(k: int) -> None:
            if after[k] < n:
                both = parts[k] + parts[after[k]]
                if len(both) <= longest and both in rank:
                    heapq.heappush(heap, (rank[both][0], k, both))

        for k in range(n):
            join(k)
        while heap:
            _, k, both = heapq.heappop(heap)
            right = after[k]
            if right >= n or parts[k] + parts[right] != both:
                continue
            parts[k], parts[right] = both, ""
            after[k] = after[right]
            if after[k] < n:
                before[after[k]] = k
            join(k)
            if before[k] >= 0:
                join(before[k])
        out: list[int] = []
        for part in parts:
            if part in rank:
                out.append(rank[part][1])
            elif part:
                out += self.byte_ids[list(part.encode())].tolist()
        return out

    def stands_alone(self, ids: np.ndarray) -> np.ndarray:
        for i in np.unique(ids[self.alone[ids] < 0]).tolist():
            self.alone[i] = self.merge(self.names[i]) == [i]
        return self.alone[ids] == 1

    def stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of pieces is encoded as these two pieces."""
        out = self.stands_alone(left) & self.stands_alone(right)
        check = np.flatnonzero(out & (left != self.unknown) & (right != self.unknown))
        keys = left[check] * (self.unknown + 1) + right[check]
        slot = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)
        lost = np.flatnonzero(self.slot_pair[slot] != keys)
        answers = self.slot_apart[slot]
        if len(lost):
            # Pairs not in their slot: look them up among all known, merge the new ones, and put them there.
            wanted, back = np.unique(keys[lost], return_inverse=True)
            at = np.searchsorted(self.pairs, wanted)
            new = wanted[self.pairs[np.minimum(at, len(self.pairs) - 1)] != wanted]
            found = []
            for key in new.tolist():
                a, b = divmod(key, self.unknown + 1)
                found.append(self.merge(self.names[a] + self.names[b]) == [a, b])
            if len(self.pairs) > PAIRS:
                self.pairs, self.apart = wanted, np.full(len(wanted), False)
                # All pairs asked for now are known again at once.
                self.apart[:] = [
                    self.merge(self.names[a] + self.names[b]) == [a, b] for a, b in (divmod(w, self.unknown + 1) for w in wanted.tolist())
                ]
                new, found = new[:0], []
            place = np.searchsorted(self.pairs, new)
            self.pairs, self.apart = np.insert(self.pairs, place, new), np.insert(self.apart, place, found)
            right_ones = self.apart[np.searchsorted(self.pairs, wanted)][back]
            answers[lost] = right_ones
            self.slot_pair[slot[lost]], self.slot_apart[slot[lost]] = keys[lost], right_ones
        out[check] = answers
        return out

    def occurrences(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, piece) of every occurrence of every piece."""
        eight = windows(data)
        order = suffix_array(data, eight)
        key = eight[order]
        first = np.searchsorted(key, self.low[:, 0], "left")
        last = np.searchsorted(key, self.high[:, 0], "right")
        rows = np.flatnonzero((self.code_sizes > 8) & (first < last))

        def bound(target: np.ndarray, beyond: bool) -> np.ndarray:
            """Binary search of the second eight bytes inside the ranges of the first."""
            lo, hi = first[rows].copy(), last[rows].copy()
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                here = eight[np.minimum(order[np.minimum(mid, len(order) - 1)] + 8, len(data) - 1)]
                low = (here <= target if beyond else here < target) & open_
                lo = np.where(low, mid + 1, lo)
                hi = np.where(open_ & ~low, mid, hi)
            return lo

        first[rows], last[rows] = bound(self.low[rows, 1], False), bound(self.high[rows, 1], True)
        counts = np.maximum(last - first, 0)
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = order[np.repeat(first, counts) + within]
        code = np.repeat(np.arange(len(counts)), counts)
        # The order knows sixteen bytes; what longer pieces have beyond is compared.
        long = np.flatnonzero(self.code_sizes[code] > 16)
        if len(long):
            text = data.tobytes()
            wrong = [k for k in long.tolist() if not text.startswith(self.codes[code[k]], int(starts[k]))]
            starts, code = np.delete(starts, wrong), np.delete(code, wrong)
        return starts, self.code_sizes[code], self.code_ids[code]

    def encode_new(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments in a row, number of ids of each), long ones by themselves."""
        long = [k for k, s in enumerate(segments) if len(s) > LONG]
        if not long:
            made = [self.encode_segments(segments[a:b]) for a, b in parts_of(segments, NEW_BYTES)]
            return np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])
        short = [s for s in segments if len(s) <= LONG]
        ids, counts = self.encode_new(short) if short else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        own = iter(np.split(ids, np.cumsum(counts)[:-1]) if short else [])
        merged = {k: np.array(self.merge_long(segments[k].decode().replace(" ", SPACE)), np.int32) for k in long}
        each = [merged[k] if k in merged else next(own) for k in range(len(segments))]
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)

    def encode_segments(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments in a row, number of ids of each)."""
        space = SPACE.encode()
        data = np.frombuffer(b"".join(s.replace(b" ", space) + b"\xff" for s in segments), np.uint8)
        ends = np.flatnonzero(data == END)
        begins = np.r_[0, ends[:-1] + 1]
        start, size, piece = self.occurrences(data)
        # Characters no piece starts at with its own length have no piece: an unknown edge.
        heads = np.flatnonzero(((data & 0xC0) != 0x80) & (data != END))
        lead = data[heads]
        width = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
        single = np.zeros(len(data), bool)
        wide = np.zeros(len(data), np.int64)
        wide[heads] = width
        single[start[size == wide[start]]] = True
        lost = ~single[heads]
        start = np.concatenate([start, heads[lost]])
        size = np.concatenate([size, width[lost]])
        piece = np.concatenate([piece, np.full(lost.sum(), self.unknown)])
        stop = start + size
        level = stop - begins[np.searchsorted(begins, start, "right") - 1]
        order = np.argsort(level, kind="stable")
        start, stop, piece, level = start[order], stop[order], piece[order], level[order]
        before = np.full(len(data) + 1, -1, np.int64)
        came = np.zeros(len(data) + 1, np.int64)
        opens = np.zeros(len(data) + 1, bool)
        opens[begins] = True
        cuts = np.r_[0, np.flatnonzero(np.diff(level)) + 1, len(level)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            s, t = start[a:b], piece[a:b]
            good = np.zeros(b - a, bool)
            head = opens[s]
            good[head] = self.stands_alone(t[head])
            inner = np.flatnonzero(~head & (before[s] >= 0))
            good[inner] = self.stay_apart(before[s[inner]], t[inner])
            before[stop[a:b][good]] = t[good]
            came[stop[a:b][good]] = s[good]
        # Follow the edges back from all ends at once.
        at, owner, found = ends.copy(), np.arange(len(ends)), []
        while len(at):
            found.append((owner, at))
            at = came[at]
            left = at > begins[owner]
            at, owner = at[left], owner[left]
        owner = np.concatenate([f[0] for f in found])
        places = np.concatenate([f[1] for f in found])
        order = np.lexsort((places, owner))
        owner, places = owner[order], places[order]
        ids = before[places]
        if (ids < 0).any():
            raise RuntimeError("a segment has no encoding")
        strange = ids == self.unknown
        if strange.any():
            sizes = np.where(strange, places - came[places], 1)
            spread = np.repeat(np.arange(len(ids)), sizes)
            nth = np.arange(len(spread)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            spelled = self.byte_ids[data[came[places][spread] + nth]]
            ids = np.where(strange[spread], spelled, ids[spread])
            owner = owner[spread]
        return ids.astype(np.int32), np.bincount(owner, minlength=len(segments))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        mark = SPACE.encode()
        cut = [SEGMENT.findall(b" " + t.replace(mark, b" ")) if t else [] for t in texts]
        if len(self.number) > CACHED or self.held > CACHED_BYTES:
            self.forget()
        flat = list(chain.from_iterable(cut))
        told = np.fromiter(map(self.number.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(told < 0)
        if len(missing):
            fresh = sorted({flat[k] for k in missing.tolist()})
            ids, sizes = self.encode_new(fresh)
            self.held += sum(map(len, fresh))
            self.number.update(zip(fresh, range(len(self.number), len(self.number) + len(fresh))))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.ids = np.concatenate([self.ids, ids])
            told[missing] = [self.number[flat[k]] for k in missing.tolist()]
        sizes = self.sizes[told]
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        upto = np.r_[0, np.cumsum(sizes)]
        bounds = np.cumsum([0, *map(len, cut)])
        return self.ids[np.repeat(self.starts[told], sizes) + within], np.diff(upto[bounds])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts of id runs of the given lengths."""
        sizes = self.text_sizes[ids]
        within = np.arange(sizes.sum(), dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        whole = self.text[np.repeat(self.text_starts[ids], sizes) + within].tobytes()
        marks = np.r_[0, np.cumsum(sizes)][np.cumsum(np.r_[0, counts])].tolist()
        # The first space of a text is the one that encoding put before it.
        return [whole[a:b].removeprefix(b" ") for a, b in zip(marks, marks[1:])]


_OWN: dict[str, Pieces] = {}


def worker_pieces(model: bytes) -> Pieces:
    """This worker's matcher for a model, kept from task to task."""
    name = hashlib.sha256(model).hexdigest()
    if name not in _OWN:
        _OWN.clear()
        _OWN[name] = Pieces(model)
    return _OWN[name]


def parts_of(texts: list[bytes], limit: int):
    """Slices of the list that hold about ``limit`` bytes."""
    a = held = 0
    for b, text in enumerate(texts):
        held += len(text)
        if held >= limit:
            yield a, b + 1
            a, held = b + 1, 0
    if a < len(texts):
        yield a, len(texts)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model_path: str = MODEL) -> DataFrame:
    """(id, n_tokens, token_ids, decoded_sha256, round_trip) of every row."""
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    shape = pa.schema(
        [
            ("id", pa.int64()),
            ("n_tokens", pa.int64()),
            ("token_ids", pa.list_(pa.int32())),
            ("decoded_sha256", pa.string()),
            ("round_trip", pa.bool_()),
        ]
    )

    def run(batches):
        own = worker_pieces(model.value)
        for batch in batches:
            some = (batch.slice(at, BATCH_ROWS) for at in range(0, batch.num_rows, BATCH_ROWS))
            for ids, texts in (zip(*rows_of(rows)) for rows in some):
                for a, b in parts_of(list(texts), BATCH_BYTES):
                    tokens, counts = own.encode(list(texts[a:b]))
                    back = own.decode(tokens, counts)
                    offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[a:b], pa.int64()),
                            pa.array(counts.astype(np.int64)),
                            pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens)),
                            pa.array([hashlib.sha256(t).hexdigest() for t in back], pa.string()),
                            pa.array([x == y for x, y in zip(back, texts[a:b])], pa.bool_()),
                        ],
                        schema=shape,
                    )

    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id bigint, n_tokens bigint, token_ids array<int>, decoded_sha256 string, round_trip boolean")


def decode(tokens: DataFrame, key: str = "id", ids: str = "token_ids", model_path: str = MODEL) -> DataFrame:
    """(id, text) from rows of piece ids; null ids give the empty text, bytes that are no UTF-8 are replaced."""
    with open(model_path, "rb") as file:
        model = tokens.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        own = worker_pieces(model.value)
        for batch in batches:
            rows = [np.array(r or [], np.int64) for r in batch.column(1).to_pylist()]
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            texts = own.decode(flat, np.array([len(r) for r in rows], np.int64))
            yield pa.RecordBatch.from_pydict(
                {"id": batch.column(0), "text": pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())}
            )

    return tokens.select(F.col(key).cast("bigint").alias("id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(
        run, "id bigint, text string"
    )
