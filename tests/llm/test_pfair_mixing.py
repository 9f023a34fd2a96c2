from __future__ import annotations

import random
from collections import Counter
from fractions import Fraction

from glyphmill.llm import pfair_mixing as P


def test_period_stays_within_a_block():
    rng = random.Random(2)
    for _ in range(30):
        share = {f"s{i}": rng.randint(1, 40) for i in range(rng.randint(1, 8))}
        q, slots = sum(share.values()), P.period(share)
        order = sorted((x, s) for s, xs in slots.items() for x in xs)
        assert [x for x, _ in order] == list(range(q))
        seen = Counter()
        for t, (_, s) in enumerate(order, 1):
            seen[s] += 1
            assert all(abs(seen[k] - t * n / q) < 1 for k, n in share.items())


def test_shares():
    assert P.shares({"a": 1, "b": 1, "c": 2, "d": 0}, 8) == {"a": 2, "b": 2, "c": 4}
    assert P.shares({"a": 1e9, "b": 1}, 10)["b"] == 1


def test_schedule_and_mix(spark):
    rows = [(i, f"text {i}", s) for i, s in enumerate(["hot"] * 300 + ["a"] * 70 + ["b"] * 33 + [None] * 20)]
    rows += [(5, "text 5", "hot"), (None, None, "a"), (None, "", "")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, slot int, key int")
    targets = {"hot": 0.5, "a": 0.3, "b": 0.2}
    got = sorted(P.schedule(df, targets, block_docs=4).collect(), key=lambda r: (r.slot, r.place))
    assert len(got) == len(rows) and len({(r.slot, r.place) for r in got}) == len(rows)
    blocks = {}
    for r in got:
        blocks.setdefault(r.slot, set()).add((r.source, r.block, r.phase))
    assert sorted(blocks) == list(range(len(blocks))) and all(len(x) == 1 for x in blocks.values())
    seen, first = Counter(), [next(iter(blocks[s])) for s in range(len(blocks))]
    for t, (source, _, phase) in enumerate(first, 1):
        if phase:
            break
        seen[source] += 1
        assert all(abs(seen[s] - w * t) < 1 for s, w in targets.items())
    assert {r.source for r in got if r.phase == max(r.phase for r in got)} <= {None, ""}
    mixed = P.mix(df, targets, block_docs=4)
    assert mixed.columns == df.columns
    out = mixed.collect()
    assert Counter((r.doc_id, r.text, r.source) for r in out) == Counter(rows)
    assert [r.source for r in out] == [r.source for r in got]
    assert P.schedule(df.limit(0)).collect() == [] and P.mix(df.limit(0)).collect() == []


def test_default_weights_follow_roots(spark):
    df = spark.createDataFrame([(i, "x" if i < 800 else "y") for i in range(1000)], "doc_id long, source string")
    got = P.schedule(df, block_docs=1).where("phase = 0 and slot < 90").groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in got} == {"x": 60, "y": 30}


def naive(sizes, share, block_docs):
    """Slot after slot, of the blocks that are released the one due first; (slot, source, block) of the whole schedule."""
    left = {s: -(-n // block_docs) for s, n in sizes.items()}
    done = dict.fromkeys(left, 0)
    out, slot = [], 0
    while any(left.values()):
        active = {s: share[s] for s in left if left[s]}
        q, start, begun = sum(active.values()), slot, dict(done)
        while all(left[s] for s in active):
            t = slot - start
            due = []
            for s, n in active.items():
                k = done[s] - begun[s]
                if Fraction(k * q, n) // 1 <= t:
                    due.append((-(-(k + 1) * q // n), s))
            _, s = min(due)
            out.append((slot, s, done[s]))
            done[s] += 1
            left[s] -= 1
            slot += 1
    return out


def test_schedule_is_that_of_going_from_slot_to_slot(spark):
    rng = random.Random(6)
    for sizes in ({"a": 97, "b": 40, "c": 5, "d": 1}, {"x": 200}, {s: rng.randrange(1, 60) for s in "pqrst"}):
        names = [s for s, n in sizes.items() for _ in range(n)]
        df = spark.createDataFrame(list(enumerate(names)), "doc_id long, source string")
        got = {(r.slot, r.source, r.block) for r in P.schedule(df, block_docs=3, resolution=100).collect()}
        share = P.shares({f"s{s}": n**0.5 for s, n in sizes.items()}, 100)
        assert got == {(slot, s[1:], k) for slot, s, k in naive({f"s{s}": n for s, n in sizes.items()}, share, 3)}


def test_very_long_texts_are_moved_whole(spark):
    rows = [(i, f"{i} " * (200_000 if i % 10 == 0 else 1), "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = P.mix(df, block_docs=2).collect()
    assert sorted((r.doc_id, len(r.text)) for r in out) == [(i, len(t)) for i, t, _ in rows]
    assert [r.doc_id for r in out] == [r.doc_id for r in P.schedule(df, block_docs=2).orderBy("slot", "place").collect()]
