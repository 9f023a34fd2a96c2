from __future__ import annotations

import random
from pathlib import Path

import pytest
import tiktoken

from glyphmill.llm import byte_bpe as B

pytestmark = pytest.mark.skipif(not Path(B.VOCABULARY).exists(), reason="no vocabulary files")

TEXTS = ["", " ", "a", "Hello  world\n\n it's 123 !!", "Ünïcödé ßtraße 漢字 🙂🙂 \u200b\ufeff", "\t\r\n  x", "x" * 5000, "long text of words " * 30_000, "<|endoftext|>", "é" * 300 + " <unk> ▁a"]


@pytest.fixture(scope="module")
def ranks():
    return B.read_ranks(B.VOCABULARY)


@pytest.fixture(scope="module")
def model(ranks):
    return B.serialize_model(ranks)


def test_matches_rank_merging(ranks, model):
    other = tiktoken.Encoding("t", pat_str=B.PATTERN, mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={})
    rng = random.Random(4)
    fuzz = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x500), rng.randrange(0x1F300, 0x1F6FF), 10, 32])) for _ in range(200)) for _ in range(60)]
    bpe = B.ByteBpe(model)
    for text, ids, same in zip(TEXTS + fuzz, *bpe.encode(TEXTS + fuzz)):
        assert ids.tolist() == other.encode_ordinary(text)
        assert bpe.decode(ids) == text and same


def test_losses_are_seen(model):
    """A pattern that leaves out digits, and a model whose piece of a word was changed behind its back."""
    bpe = B.ByteBpe(model, r"[^\d]+")
    ids, same = bpe.encode(["abc", "a1c", ""])
    assert same == [True, False, True] and [bpe.decode(x) for x in ids] == ["abc", "ac", ""]
    bpe = B.ByteBpe(model)
    bpe.bytes[bpe.encode(["x"])[0][0][0]] = b"?"
    bpe.known.clear()
    bpe.length[bpe.encode(["x"])[0][0][0]] = 1
    assert bpe.encode(["x y", "z"])[1] == [False, True]


def test_documents(spark, model):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (None, "a"), (1, " ")]
    df = spark.createDataFrame([(i, t, [7], 1) for i, t in rows], "doc_id long, text string, token_ids array<int>, n_tokens int")
    got = B.encode_documents(df, model)
    found = got.collect()
    assert len(found) == len(rows) and all(r.lossless for r in found if r.doc_id != 50)
    assert [(r.token_ids, r.n_tokens, r.lossless) for r in found if r.doc_id == 50] == [(None, None, None)]
    assert [(r.token_ids, r.n_tokens) for r in found if r.doc_id == 0] == [([], 0)]
    back = {r.doc_id: r.text for r in B.decode_documents(got, model).collect()}
    assert back == dict(rows)
    whole = B.with_tokens(df, model)
    assert whole.columns == ["doc_id", "text", "token_ids", "n_tokens"]
    assert sorted(map(str, ((r.doc_id, r.text) for r in whole.collect()))) == sorted(map(str, rows))
    assert B.encode_documents(df.limit(0), model).collect() == []


def test_bytes_are_needed():
    with pytest.raises(ValueError):
        B.serialize_model([b"a"])


def test_cache_turns_over(ranks, model, monkeypatch):
    """Ids stay the same while words come, go and come back."""
    monkeypatch.setattr(B, "_CACHE_WORDS", 5)
    rng = random.Random(9)
    bodies = [" ".join(rng.choice(["alpha", "beta", "gamma", f"w{rng.randrange(40)}"]) for _ in range(6)) for _ in range(60)]
    bpe, fresh = B.ByteBpe(model), B.ByteBpe(model)
    for t in bodies:
        fresh.known.clear(), fresh.older.clear()
        (a, _), (b, _) = bpe.encode([t]), fresh.encode([t])
        assert a[0].tolist() == b[0].tolist() and len(bpe.known) < 5 + 13
