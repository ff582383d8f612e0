"""Long segments and bounded tables of the piece matcher, against the library."""

from __future__ import annotations

import random
import time

import numpy as np
import sentencepiece

from handful.llm import pieces as P


def matcher():
    with open(P.MODEL, "rb") as file:
        return P.Pieces(file.read()), sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


def test_long_segments_equal_the_library():
    own, library = matcher()
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789+/é日🙂"
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (P.LONG - 1, P.LONG + 40, 5000)]
    texts += ["x" * 3000, "ab" * 1500, " " * 700, "\n" * 900, "short " + "y" * 600 + " words"]
    ids, counts = own.encode([t.encode() for t in texts])
    for text, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert got.tolist() == library.encode(text)


def test_letters_without_a_space_take_time_in_proportion():
    own, _ = matcher()
    rng = random.Random(2)
    start = time.perf_counter()
    own.encode(["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)).encode()])
    assert time.perf_counter() - start < 30


def test_tables_stay_bounded(monkeypatch):
    monkeypatch.setattr(P, "PAIRS", 2000)
    monkeypatch.setattr(P, "CACHED_BYTES", 20_000)
    own, library = matcher()
    rng = random.Random(3)
    for _ in range(30):
        text = "".join(rng.choice("abcdefg hij") for _ in range(3000))
        ids, _ = own.encode([text.encode()])
        assert ids.tolist() == library.encode(text)
        assert len(own.pairs) <= 6000 and own.held <= 30_000


def test_new_segments_are_matched_in_small_parts(monkeypatch):
    monkeypatch.setattr(P, "NEW_BYTES", 500)
    own, library = matcher()
    sizes, plain = [], own.encode_segments
    monkeypatch.setattr(own, "encode_segments", lambda segments: sizes.append(sum(map(len, segments))) or plain(segments))
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 12))) for _ in range(900)) + " " + "y" * 700
    ids, _ = own.encode([text.encode()])
    assert ids.tolist() == library.encode(text)
    assert len(sizes) > 5 and max(sizes) < 520
