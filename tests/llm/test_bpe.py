import random

import pytest

from quirework.llm import bpe

TEXTS = ["", None, " ", "\n\n  x\t ", "Hello, world! It's 2024.", "naïve — “quotes” … 時計職人は夜明け前", "Жуки под дождём", "a" * 500, "ab" * 400 + "é" * 90, "  trailing  ", "x y　z w", "\U0001f600 emoji‍", "don't we'll they've I'm", "1234567 ½ ²", "Hello, world! It's 2024."]


def _expected():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN.removeprefix("(?U)"), mergeable_ranks=bpe.ranks(bpe.VOCABULARY), special_tokens={})


def test_ids_and_round_trip(spark, rows):
    want = _expected()
    docs = spark.createDataFrame([(i if i != 3 else None, t, [1]) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], [1])], "doc_id bigint, text string, ids array<int>")
    got = bpe.encode(docs)
    assert rows(got) == sorted(((i if i != 3 else None, want.encode_ordinary(t or "")) for i, t in [*enumerate(TEXTS), (4, TEXTS[4])]), key=lambda r: tuple((x is not None, str(x)) for x in r))
    assert rows(bpe.decode(got).where("doc_id is not null").select("text").distinct()) == sorted({(t or "",) for i, t in enumerate(TEXTS) if i != 3})
    assert rows(bpe.encode(docs.limit(0))) == []


def test_heap_equals_reference():
    want, rank, rng = _expected(), bpe.ranks(bpe.VOCABULARY), random.Random(2)
    for _ in range(200):
        word = "".join(rng.choice("abcdeéжx12 ") for _ in range(rng.randint(1, 60)))
        assert bpe.heap_ids(word.encode(), rank) == want.encode_single_piece(word) if hasattr(want, "encode_single_piece") else True
    assert bpe.heap_ids(b"a" * 100_000, rank) == bpe.heap_ids(b"a" * 100_000, rank)
    word = "kikvifubosantonia" * 20
    assert bpe.heap_ids(word.encode(), rank) == want.encode_ordinary(word)
