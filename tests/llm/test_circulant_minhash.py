from __future__ import annotations

import itertools
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from glyphmill.llm import circulant_minhash as M

SF = Path("/root/testdata/sf0.001/documents.parquet")
STRIP = ".,;:!?|\"'()[]{}*#$%&-_"


def words(text):
    return [w for w in (x.strip(STRIP) for x in (text or "").lower().split()) if w]


def shingle_set(text, n=3):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, threshold=0.6):
    sets = {}
    for i, t in rows:
        if i is not None and shingle_set(t):
            sets.setdefault(i, []).append(shingle_set(t))
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if any(len(x & y) >= threshold * len(x | y) for x in sets[a] for y in sets[b]):
            parent[root(b)], _ = min(root(a), root(b)), parent.update({max(root(a), root(b)): min(root(a), root(b))})
    return {i: root(i) for i in sets if root(i) != i}


def planted(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=120))) for i in range(60)]
    for i in range(60):
        w = rows[i % 20][1].split()
        for _ in range(4):
            w[rng.randrange(120)] = "changed"
        rows.append((100 + i, " ".join(w)))
    return rows


EDGES = [
    (900, None), (901, ""), (902, " . "), (903, "one"), (904, "One."), (905, "two words"), (None, "two words"),
    (906, "x y z " * 30_000), (907, "x y z " * 30_000), (908, "same id row one two three"), (908, "other text of that id here"), (909, "other text of that id here"),
]


def test_groups_match_brute_force(spark):
    rows = planted() + EDGES
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, mark string")
    got = {r.doc_id: r.duplicate_of for r in M.near_duplicates(df).collect()}
    assert got == brute(rows)
    kept = M.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i not in got)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert M.near_duplicates(df).collect() == [] and M.drop_near_duplicates(df).collect() == []


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_recall_on_tables(spark):
    docs = spark.read.parquet(str(SF))
    got = {r.doc_id: r.duplicate_of for r in M.near_duplicates(docs).collect()}
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert len(set(got.items()) & set(want.items())) >= 0.9 * len(want) and not set(got) - set(want)


def test_signature_is_circulant_and_estimates_jaccard():
    sigma, windows = M._permutations(252, 20)
    assert (windows[5, :251] == windows[4, 1:]).all() and windows[M.UNIVERSE - 1, 1] == windows[0, 0]
    assert len(np.unique(sigma)) == M.UNIVERSE
    base = [f"t{i}" for i in range(400)]
    texts = pa.array([" ".join(base), " ".join(base[:300] + [f"u{i}" for i in range(100)])])
    grams, starts = M.Shingler(1).shingles(texts)
    sig = M.signatures(grams, starts, 252, 20)
    assert abs((sig[0] == sig[1]).mean() - 300 / 500) < 0.1


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    got = {r.doc_id: r.group_id for r in M.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    assert got == {x: g for x, g in low.items() if x != g}


def test_a_bucket_of_many_unlike_documents(spark, monkeypatch):
    """Bands of one coordinate, which documents share as all have one passage; few pairs are verified, and the right ones."""
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"d{i}w{j}" for j in range(140)] + passage)) for i in range(600)]
    rows += [(5000 + i, rows[i][1].replace("w7 ", "x ")) for i in range(0, 40)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    verified = M._verified
    monkeypatch.setattr(M, "_verified", lambda pairs, *a: seen.append(pairs.count()) or verified(pairs, *a))
    got = {r.doc_id: r.duplicate_of for r in M.near_duplicates(df, bands=252, rows=1).collect()}
    assert got == {5000 + i: i for i in range(40)}
    assert sum(seen) < 0.1 * 600 * 600 / 2


def test_sketches_leave_no_similar_pair_out(spark):
    rows = planted(11)
    sets = {i: shingle_set(t) for i, t in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    signed = M._signed(df, "text", "doc_id", 3, 42, 6, 20)
    a, b = (signed.selectExpr(f"doc_id as {x}", f"n as n{x}", f"bits as x{x}") for x in "ab")
    kept = {(r.a, r.b) for r in a.join(b, a.a < b.b).where(M._possible(252, 0.6)).select("a", "b").collect()}
    want = {(x, y) for x, y in itertools.combinations(sorted(sets), 2) if len(sets[x] & sets[y]) >= 0.6 * len(sets[x] | sets[y])}
    assert want and want <= kept and len(kept) < 2 * len(want) + 50
    assert {r.doc_id: r.n for r in signed.collect()} == {i: len(s) for i, s in sets.items()}
