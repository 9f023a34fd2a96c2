"""Mixing sources to target weights by Pfair scheduling of blocks of documents."""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import pick

#: More rows of schedule than these are joined by a shuffle instead of a broadcast.
_BROADCAST_ROWS = 1_000_000
#: Documents that share a bucket in which they are ranked; the number of buckets grows with the corpus.
_BUCKET_DOCS = 16_384


def shares(weights: Mapping[str, float], resolution: int) -> dict[str, int]:
    """Weights as whole numbers of about ``resolution`` in sum, by largest remainders; none that is positive gets less than 1."""
    total = sum(w for w in weights.values() if w > 0)
    exact = {s: w / total * resolution for s, w in weights.items() if w > 0}
    whole = {s: max(1, int(x)) for s, x in exact.items()}
    short = resolution - sum(whole.values())
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: max(0, short)]:
        whole[s] += 1
    return whole


def period(share: Mapping[str, int]) -> dict[str, list[int]]:
    """The slots of each source in one period of sum(share) slots.

    Block k of a source with share n of Q is released at floor(k Q / n) and due at ceil((k + 1) Q / n); each slot goes
    to the released block that is due first. As the shares add up to Q, no deadline is missed, and after t slots a source
    has had more than t n / Q - 1 and fewer than t n / Q + 1 blocks. The next period begins as the first did.
    """
    q = sum(share.values())
    release = sorted((k * q // n, -((k + 1) * q // -n), s) for s, n in share.items() for k in range(n))
    slots: dict[str, list[int]] = {s: [] for s in share}
    ready: list[tuple[int, str]] = []
    at = 0
    for slot in range(q):
        while at < len(release) and release[at][0] <= slot:
            heapq.heappush(ready, release[at][1:])
            at += 1
        due, s = heapq.heappop(ready)
        assert slot < due
        slots[s].append(slot)
    return slots


def phases(blocks: Mapping[str, int], share: Mapping[str, int]) -> tuple[list[tuple], list[tuple]]:
    """The whole schedule: rows (source, phase, first block, end block, first slot, share, period) and (phase, source, k, slot).

    A phase ends when one of its sources has no block left; the others go on with the same shares of a shorter period.
    Sources without a share come after all others, in proportion to their size.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    spans, table, start, phase = [], [], 0, 0
    while left:
        active = {s: share[s] for s in left if share.get(s, 0) > 0}
        if not active:
            active = shares({s: float(left[s]) for s in left}, max(len(left), min(1000, sum(left.values()))))
        slots = period(active)
        q = sum(active.values())
        end = min((left[s] - 1) // n * q + slots[s][(left[s] - 1) % n] + 1 for s, n in active.items())
        for s, n in active.items():
            used = end // q * n + sum(x < end % q for x in slots[s])
            if used:
                spans.append((s, phase, done[s], done[s] + used, start, n, q))
                table += [(phase, s, k, x) for k, x in enumerate(slots[s])]
            done[s] += used
            left[s] -= used
            if not left[s]:
                del left[s]
        start += end
        phase += 1
    return spans, table


def _some(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= _BROADCAST_ROWS else df


def _placed(rows: DataFrame, key: str, order: list[str], targets: Mapping[str, float] | None, alpha: float, block_docs: int, resolution: int) -> tuple[DataFrame, int]:
    """``rows`` with ``phase``, ``slot`` and ``place``, and the number of slots. ``key`` is a non-null column of sources, ``order`` what ranks them, of which the first is a hash."""
    spark = rows.sparkSession
    n = rows.count()
    buckets = max(1, -(-n // _BUCKET_DOCS))
    rows = rows.withColumn("bucket", F.expr(f"pmod({order[0]}, {buckets})"))
    # Ranks without a partition of a whole source: within buckets, plus what the buckets before hold.
    per = rows.groupBy(key, "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy(key).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = per.select(key, "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    sizes = {r[0]: r[1] for r in per.groupBy(key).agg(F.sum("n")).collect()}  # a row for each source of the mixture
    weights = {f"s{s}": w for s, w in targets.items()} if targets is not None else {s: c**alpha for s, c in sizes.items()}
    whole = shares({s: w for s, w in weights.items() if s in sizes}, max(resolution, len(sizes))) if sizes else {}
    spans, table = phases({s: -(-c // block_docs) for s, c in sizes.items()}, whole)
    span = spark.createDataFrame(spans, f"{key} string, phase long, lo long, hi long, start long, share long, q long")
    tick = spark.createDataFrame(table, f"phase long, {key} string, k long, tick long")
    rank = F.row_number().over(W.partitionBy(key, "bucket").orderBy(*order)) - 1
    ranked = rows.withColumn("r", rank).join(offsets, [key, "bucket"]).withColumn("r", F.col("r") + F.col("offset"))
    ranked = ranked.withColumn("block", F.expr(f"r div {block_docs}")).withColumn("place", F.expr(f"r % {block_docs}"))
    spanned = ranked.join(_some(span, len(spans)), key).where("block >= lo and block < hi")
    spanned = spanned.withColumn("k", F.expr("(block - lo) % share"))
    out = spanned.join(_some(tick, len(table)), ["phase", key, "k"])
    out = out.withColumn("slot", F.expr("start + (block - lo) div share * q + tick"))
    return out.drop("bucket", "r", "offset", "lo", "hi", "start", "share", "q", "k", "tick"), sum(-(-c // block_docs) for c in sizes.values())


def _key(source: str) -> F.Column:
    return F.when(F.col(source).isNull(), F.lit("null")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))


def schedule(
    docs: DataFrame,
    targets: Mapping[str, float] | None = None,
    alpha: float = 0.5,
    block_docs: int = 16,
    resolution: int = 1000,
    source: str = "source",
    doc_id: str = "doc_id",
) -> DataFrame:
    """A row (doc_id, source, phase, block, slot, place) for every row: its block of its source, the slot of that block and its place in it.

    ``targets`` has the weight of each source; without it, a source of n documents weighs n ** ``alpha``. Weights are
    rounded to shares of ``resolution``. Sources are cut into blocks of ``block_docs`` documents, in an order that a hash
    of the id gives. Every document comes once: when a source is used up a phase ends, and the next one keeps the
    proportions of the others. After any number of slots of a phase, no source is a whole block away from its
    share. Sources without a weight come last, in proportion to their size.

    The number of sources is that of the mixture and small; the documents of one are ranked in buckets, whose number
    grows with the corpus, so that a large source isn't one partition. A null source is a source of its own. Null ids
    are placed like others; rows that share an id have places next to each other, in no given order. Texts and other columns, of any name,
    are not read, so their length doesn't matter; an empty table gives no rows. The driver holds a row for each source, and for each
    phase the slots of a period: sources are few beside documents.
    """
    rows = pick(docs, doc_id=doc_id, source=source)
    rows = rows.withColumn("key", _key("source")).withColumn("h", F.xxhash64("doc_id"))
    out, _ = _placed(rows, "key", ["h", "doc_id"], targets, alpha, block_docs, resolution)
    return out.select("doc_id", "source", "phase", "block", "slot", "place")


def mix(
    docs: DataFrame,
    targets: Mapping[str, float] | None = None,
    alpha: float = 0.5,
    block_docs: int = 16,
    resolution: int = 1000,
    source: str = "source",
    doc_id: str = "doc_id",
    text: str = "text",
    places: tuple[str, str] | None = None,
) -> DataFrame:
    """``docs`` in the order that ``schedule`` gives; every row and column is kept, very long texts, nulls and columns of clashing names too. Rows that share an id are ordered by text.

    Partition after partition holds a range of slots, so files written from it have the order of training by their names.
    Spark reads files in another order, by size: what is to be had in order after that needs ``places``, the names under
    which slot and place are added; they replace columns of those names.
    """
    names = docs.columns
    packed = docs.toDF(*[f"c{i}" for i in range(len(names))])
    i, s, t = (f"c{names.index(x)}" for x in (doc_id, source, text))
    rows = packed.withColumn("key", _key(s)).withColumn("h", F.xxhash64(i))
    placed, slots = _placed(rows, "key", ["h", i, t], targets, alpha, block_docs, resolution)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    to = F.expr(f"cast(slot * {parts} div {max(1, slots)} as int)")
    ordered = placed.repartitionById(parts, to).sortWithinPartitions("slot", "place")
    kept = [k for k, name in enumerate(names) if name not in (places or ())]
    out = ordered.select(*[f"c{k}" for k in kept], *(("slot", "place") if places else ()))
    return out.toDF(*[names[k] for k in kept], *(places or ()))
