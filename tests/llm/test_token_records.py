"""Token records against the library, an exact round trip, and broken files."""

from __future__ import annotations

import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from handful.llm import token_records as T
from tests.llm import cases

# Check values of CRC-32C.
CRCS = {b"": 0, b"123456789": 0xE3069283, bytes(32): 0x8A9136AA, b"\xff" * 32: 0x62A8AB43}


def unmasked(value: int) -> int:
    turned = (value - T.MASK_DELTA) & 0xFFFFFFFF
    return ((turned >> 17) | (turned << 15)) & 0xFFFFFFFF


def slow_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = (crc >> 1) ^ (T.POLYNOMIAL if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums_of_many_pieces():
    pieces = list(CRCS)
    assert [unmasked(int(v)) for v in T.masked_crcs(pieces)] == list(CRCS.values())
    rng = random.Random(3)
    pieces = [rng.randbytes(n) for n in (1, 2, 63, 64, 65, 127, 128, 129, 1000, 5000)]
    assert [unmasked(int(v)) for v in T.masked_crcs(pieces)] == [slow_crc(p) for p in pieces]


def expected(rows):
    own = Tokenizer.from_file(T.TOKENIZER)
    ids = lambda text: own.encode(text or "", add_special_tokens=False).ids + [1]
    return [(r[0], ids(r[1])) for r in rows]


def odd_rows():
    rng = random.Random(5)
    odd = ["Don't STOP’s   x y é é ́z ΑΣ Σ <|endoftext|>a<|endoftext|> b", "x" * 3000, "日本語 テキスト\x85z", "\x1c\x1d a\x1fb"]
    letters = "abc'´.,;1٣é́ \t\n Σσß 😀"
    odd += ["".join(rng.choice(letters) for _ in range(200)) for _ in range(60)]
    return cases.documents() + [(1000 + k, t, "en", "s", 1) for k, t in enumerate(odd)]


def test_ids_and_starts_equal_the_library(spark):
    rows = odd_rows()
    shards = T.write_records(cases.table(spark, rows, extra=True), shard_bytes=20_000)
    got = [(r["id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in T.read_records(shards, piece_bytes=9000).collect()]
    got.sort(key=lambda r: r[1])
    want = sorted(((r, tuple(ids)) for r, ids in expected(rows)), key=lambda x: (x[0] is None, x[0] or 0))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == np.cumsum([0] + [g[2] for g in got])[:-1].tolist()
    assert all(g[2] == len(g[3]) // 4 for g in got)
    ids_of = lambda b: tuple(np.frombuffer(b, "<u4").tolist())
    assert sorted((str(g[0]), ids_of(g[3])) for g in got) == sorted((str(w[0]), w[1]) for w in want)
    assert shards.count() > 1


def test_long_texts_are_cut_at_white_space_only(monkeypatch):
    monkeypatch.setattr(T, "SLICE", 50)
    monkeypatch.setattr(T, "CACHED", 40)
    with open(T.TOKENIZER, "rb") as file:
        mine = T.Encoder(file.read())
    assert mine.apart and mine.width == 2
    for _, text, *_ in odd_rows():
        want = mine.own.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(mine.encode([(text or "").encode()])[0], "<u2").tolist() == want
    assert len(mine.known) <= 60 and max(map(len, mine.known)) <= T.KEPT_BYTES


@pytest.mark.parametrize("kept", [3, 40, 10_000])
def test_texts_together_have_the_ids_of_each(monkeypatch, kept):
    monkeypatch.setattr(T, "CACHED", kept)
    with open(T.TOKENIZER, "rb") as file:
        mine = T.Encoder(file.read())
    assert mine.between is not None
    texts = [(r[1] or "").encode() for r in odd_rows()] + [b"a \x01 b\x01c", b"\x01", b"! \x02 !!"]
    want = [mine.own.encode(t.decode(), add_special_tokens=False).ids for t in texts]
    for some in (1, 7, len(texts)):
        got = [x for at in range(0, len(texts), some) for x in mine.encode(texts[at : at + some])]
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == want


def test_rules_that_look_at_white_space_take_whole_texts():
    with open("/opt/tokenizers/byte_bpe_50k.json", "rb") as file:
        blob = file.read()
    assert not T.words_apart(json.loads(blob))
    other = T.Encoder(blob)
    text = "Two  words and\n\na line"
    assert np.frombuffer(other.encode([text.encode()])[0], "<u2").tolist() == other.own.encode(text, add_special_tokens=False).ids


def test_shuffled_reads_give_every_record_once_in_an_even_order(spark):
    rows = [(i, f"text number {i} " * (i % 7), "en", "s", 1) for i in range(400)]
    shards = T.write_records(cases.table(spark, rows), shard_bytes=5000).persist()
    plain = {r["id"]: (r["start"], bytes(r["ids"])) for r in T.read_records(shards).collect()}
    one, same, other = ([(r["id"], r["start"], bytes(r["ids"])) for r in T.shuffled(shards, s, 3000).collect()] for s in (1, 1, 2))
    assert one == same and one != other
    assert {i: (s, b) for i, s, b in one} == plain and len(one) == 400
    places = [i for i, *_ in one]
    assert abs(np.corrcoef(range(400), places)[0, 1]) < 0.15
    shards.unpersist()


def test_broken_records_are_found(spark):
    shards = T.write_records(cases.table(spark)).persist()
    row = shards.first()
    files, name = T.opened(row["path"])
    with open(f"{name}.records", "r+b") as file:
        whole = file.read()
        length, crc = struct.unpack("<QI", whole[:12])
        assert unmasked(crc) == slow_crc(whole[:8])
        assert unmasked(struct.unpack("<I", whole[12 + length : 16 + length])[0]) == slow_crc(whole[12 : 12 + length])
        file.seek(20)
        file.write(bytes([whole[20] ^ 1]))
    with pytest.raises(Exception, match="checksum"):
        T.read_records(shards).collect()
    shards.unpersist()


def test_tables_of_no_rows_and_of_one_row_repeated(spark):
    empty = T.write_records(cases.table(spark, []))
    assert empty.collect() == [] and T.read_records(empty).collect() == [] and T.shuffled(empty, 1).collect() == []
    rows = [(None, "same text", None, None, None)] * 50 + [(3, None, None, None, None)]
    found = T.read_records(T.write_records(cases.table(spark, rows))).orderBy("start").collect()
    assert [r["id"] for r in found] == [3] + [None] * 50
    assert found[0]["n_tokens"] == 1 and len({bytes(r["ids"]) for r in found[1:]}) == 1


def test_query_has_the_contracts_columns(spark):
    from handful.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in QUERIES["op11_token_records"](spark, sf).collect()}
    own, at = Tokenizer.from_file(T.TOKENIZER), 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy(F.col("doc_id").asc_nulls_last()).collect():
        ids = own.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        row = got[r["doc_id"]]
        assert (row["start"], row["n_tokens"]) == (at, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
