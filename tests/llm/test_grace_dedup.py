from __future__ import annotations

import random

import pyarrow as pa
import pytest

from glyphmill.llm import grace_dedup as G


def brute(rows):
    by = {}
    for i, t in rows:
        if i is not None and t is not None:
            by.setdefault(t, []).append(i)
    return sorted((i, min(v)) for v in by.values() for i in sorted(v)[1:])


ROWS = [(1, "a"), (2, "a"), (2, "a"), (5, ""), (4, ""), (6, None), (7, None), (None, "a"), (9, "x" * 200_000), (8, "x" * 200_000), (3, "b")]


def test_duplicates(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id long, text string, duplicate_of int")
    assert sorted(map(tuple, G.exact_duplicates(df).collect())) == brute(ROWS)
    assert G.exact_duplicates(df.limit(0)).collect() == []


def test_drop_keeps_columns(spark):
    df = spark.createDataFrame([(i, t, str(i)) for i, t in ROWS], "doc_id long, text string, c0 string")
    out = G.drop_exact_duplicates(df)
    assert out.schema == df.schema
    got = sorted(((r.doc_id, (r.text or "")[:1], r.c0) for r in out.collect()), key=str)
    assert got == sorted([(1, "a", "1"), (4, "", "4"), (6, "", "6"), (7, "", "7"), (8, "x", "8"), (3, "b", "3")], key=str)


def batches_of(rows, keep, size=100):
    for part in (rows[i : i + size] for i in range(0, len(rows), size)):
        columns = [pa.array([i for i, _ in part]), pa.array([t for _, t in part])]
        yield pa.record_batch(columns if keep else [*columns, pa.array([[]] * len(part), pa.list_(pa.int64()))], names=["k", "text", "ids"][: len(columns) + (not keep)])


@pytest.mark.parametrize("keep", [True, False])
def test_recursion_over_spill_files(tmp_path, keep):
    rng = random.Random(5)
    rows = [(i, f"text {rng.randrange(300)} " * rng.choice([1, 40])) for i in range(3000)] + [(9000 + i, "hot " * 50) for i in range(800)]
    rng.shuffle(rows)
    for budget in (1 << 14, 1 << 30):
        out = [r for b in G.GraceDedup(f"file://{tmp_path}/s", 1, budget, keep).run(batches_of(rows, keep)) for r in zip(*(c.to_pylist() for c in b.columns))]
        if keep:
            least = {}
            for i, t in rows:
                least[t] = min(i, least.get(t, i))
            assert sorted(out) == sorted((i, t) for t, i in least.items())
        else:
            assert sorted(out) == brute(rows)
    assert not any(tmp_path.iterdir())


@pytest.mark.parametrize("keep", [True, False])
def test_partitions_send_each_text_once_a_window(keep):
    rows = [(7, "a"), (3, "b"), (5, "a"), (3, "b"), (9, "c"), (5, "a")]
    grace = G.GraceDedup("file:///unused", 1, 1 << 20, keep)
    for window, texts in ((1 << 20, ["a", "b", "c"]), (0, sorted(t for _, t in rows))):
        sent = list(grace.combine([b.select(["k", "text"]) for b in batches_of(rows, keep, 1)], window))
        assert sorted(t for b in sent for t in b.column(1).to_pylist()) == texts
        out = [r for b in grace.run(sent) for r in zip(*(c.to_pylist() for c in b.columns))]
        assert sorted(out) == ([(3, "b"), (5, "a"), (9, "c")] if keep else brute(rows))


def test_a_hundred_thousand_copies(spark):
    """One text in most rows, over small buckets: what is shuffled doesn't grow with its copies."""
    df = spark.range(100_000).selectExpr("id as doc_id", "if(id % 50 = 7, concat('own ', id), repeat('boiler plate ', 20)) as text", "'x' as ids")
    got = G.exact_duplicates(df, bucket_bytes=1 << 12)
    assert got.count() == 98_000 - 1 and got.where("duplicate_of <> 0").count() == 0
    assert G.drop_exact_duplicates(df, bucket_bytes=1 << 12).selectExpr("min(doc_id)", "count(ids)").first() == (0, 2001)


def test_table_compares_contents():
    table = G.ContentTable(2)
    assert [table.insert(7, c) for c in (b"a", b"b", b"a")] == [(0, True), (1, True), (0, False)]
    for n in range(100):
        table.insert(n, b"%d" % n)
    assert table.insert(7, b"b") == (1, False)
