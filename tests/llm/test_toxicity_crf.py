from __future__ import annotations

import itertools
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from glyphmill.llm import toxicity_crf as T

SF = Path("/root/testdata/sf0.01")


def brute(u, transition, start):
    total = np.zeros(len(u))
    z = 0.0
    for ys in itertools.product((0, 1), repeat=len(u)):
        s = start * ys[0] + sum(x * y for x, y in zip(u, ys)) + sum(transition[a][b] for a, b in zip(ys, ys[1:]))
        z += np.exp(s)
        total += np.exp(s) * np.array(ys)
    return total / z


def test_marginals_sum_over_all_paths():
    rng = np.random.default_rng(0)
    lengths = [1, 2, 5, 9, 1, 7, 3]
    u = rng.normal(0, 2, sum(lengths))
    first = np.zeros(len(u), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    transition = rng.normal(0, 1, (2, 2))
    got, _, _ = T.marginals(u, first, transition, -0.7)
    want = np.concatenate([brute(x, transition, -0.7) for x in np.split(u, np.cumsum(lengths)[:-1])])
    assert np.allclose(got, want)


def sample(n, seed):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(n):
        w = rng.choices(words, k=60)
        if i % 5 == 0:
            w[rng.randrange(60)] = rng.choice(["vile", "nasty"]) + rng.choice(["", "!", "."])
        texts.append(" ".join(w))
        labels.append(int(i % 5 == 0))
    return texts, labels


def test_spans_and_held_out_accuracy():
    model = T.fit(*sample(600, 1))
    texts, labels = sample(300, 2)
    found = T.tag(model, pa.array(texts), 0.5)
    assert sum((s >= 0.5) == bool(y) for (s, _, _), y in zip(found, labels)) >= 297
    for text, (score, _, spans) in zip(texts, found):
        assert all(text[s["start"] : s["end"]].strip(".!") in ("vile", "nasty") for s in spans) and bool(spans) <= (score >= 0.5)
    long = "fine " * 50_000 + "nasty " + "fine " * 10
    (score, mass, spans), *_ = T.tag(model, pa.array([long, None, ""]), 0.5)
    assert score > 0.5 and [long[s["start"] : s["end"]] for s in spans] == ["nasty"]


def test_rows(spark):
    model = T.fit(*sample(600, 1))
    df = spark.createDataFrame([(1, "a vile b", "s"), (2, None, "s"), (3, " ", "s"), (None, "word1", "s"), (1, "a vile b", "s")], "doc_id long, text string, spans string")
    got = sorted((r.doc_id or 0, len(r.spans), r.score > 0.5) for r in T.score_documents(df, model).collect())
    assert got == [(0, 0, False), (1, 1, True), (1, 1, True), (2, 0, False), (3, 0, False)]
    assert [r.doc_id for r in T.score_documents(df, model).where("toxic").collect()] == [1, 1]
    assert T.score_documents(df.limit(0), model).collect() == []
    none = T.fit([], [])
    assert [r.spans for r in T.score_documents(df, none).collect()] == [[]] * 5


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_labels_of_tables(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = T.fit_from_labels(docs, labels.where("doc_id % 2 = 0"))
    rows = T.score_documents(docs, model).withColumnRenamed("toxic", "flag").join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    toxic = [r for r in rows if r.toxic == 1]
    assert sum(r.flag for r in toxic) >= 0.6 * len(toxic)
    assert sum(r.flag for r in rows if r.toxic == 0) <= 0.02 * len(rows)


def test_words_count_at_full_length():
    a, b = "x" * 50 + "a" + "y" * 9, "x" * 50 + "b" + "y" * 9
    h = T.hash_words([a, b, "abc", "abcd", "abcde", "", "x" * 1_000_000, "x" * 999_999 + "z"])
    assert h[0, 0] != h[1, 0] and (h[0, 1:] == h[1, 1:]).all()
    assert h[6, 0] != h[7, 0] and h[6, 5] != h[7, 5] and (h[6, 1:5] == h[7, 1:5]).all()
    assert h[2, 1] == 0 and h[3, 1] == 0 and h[4, 1] != 0 and not h[5].any()
    glued = [("harmless" * 8) + tail for tail in ("nice", "ugly")]
    texts = [f"w{i} {glued[i % 2]} w{i + 1}" for i in range(400)]
    model = T.fit(texts, [i % 2 for i in range(400)])
    assert [bool(s) for _, _, s in T.tag(model, pa.array(texts[:20]), 0.5)] == [bool(i % 2) for i in range(20)]


def plain(model, text):
    """Score and spans of a text, word by word: forward and backward sums over states in logarithms."""
    tokens = [(m.start(), m.end(), m[0].lower().strip(T._EDGE)) for m in re.finditer(r"\S+", text or "")]
    if not tokens:
        return 0.0, []
    at = T._buckets(T.hash_words([w for _, _, w in tokens]))
    u = [float(model.own[a].sum(dtype=np.float64)) for a in at]
    for k in range(len(u) - 1):
        u[k + 1] += float(model.left[at[k, 0]])
        u[k] += float(model.right[at[k + 1, 0]])
    t, u = model.transition, np.clip(u, -30, 30)
    ahead = [np.array([0.0, model.start + u[0]])]
    for x in u[1:]:
        ahead.append(np.logaddexp(ahead[-1][0] + t[0], ahead[-1][1] + t[1]) + [0, x])
    back = [np.zeros(2)]
    for x in u[:0:-1]:
        nxt = back[0] + [0, x]
        back.insert(0, np.logaddexp(t[:, 0] + nxt[0], t[:, 1] + nxt[1]))
    p = [float(np.exp(a[1] + b[1] - np.logaddexp(*(a + b)))) for a, b in zip(ahead, back)]
    spans, last = [], -2
    for k, (a, b, _) in enumerate(tokens):
        if p[k] >= 0.5:
            if last == k - 1:
                spans[-1][1] = b
            else:
                spans.append([a, b])
            last = k
    return 1 - float(np.prod([1 - min(x, 1 - 1e-9) for x in p if x >= T.LEAST_EVIDENCE])), spans


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_query_against_plain_sums(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = T.fit_from_labels(docs, labels)
    some = docs.where("doc_id % 6 = 0")
    text = {r.doc_id: r.text for r in some.collect()}
    for r in T.score_documents(some, model).collect():
        score, spans = plain(model, text[r.doc_id])
        assert abs(r.score - score) < 1e-6 and [[s.start, s.end] for s in r.spans] == spans
        assert r.toxic == (score >= 0.9 and bool(spans))
