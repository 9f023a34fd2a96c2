"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, id_and_text, slices, small

#: Coordinates are shifts of one permutation of this many places.
UNIVERSE = 1 << 22
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@lru_cache(1)
def _permutations(coordinates: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """sigma, and the windows of pi: row x holds pi at x, x+1, ... around the circle, the coordinates of x in turn."""
    rng = np.random.Generator(np.random.PCG64(seed))
    sigma = rng.permutation(np.arange(UNIVERSE, dtype=np.uint32))
    pi = rng.permutation(np.arange(UNIVERSE, dtype=np.uint32))
    circle = np.concatenate([pi, pi[: coordinates - 1]])
    return sigma, np.lib.stride_tricks.sliding_window_view(circle, coordinates)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Hashes of the word n-grams of texts. Words are lower-cased and lose the punctuation at their ends."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def _hash(self, word: str) -> int:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[word] = found = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return found

    def shingles(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all shingles, and where those of each text begin (one more entry than texts). A text of fewer words is one shingle; one without words has none."""
        split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        offsets = split.offsets.to_numpy().astype(np.int64)
        flat = split.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        coded = flat.dictionary_encode()
        names = pc.utf8_trim(pc.utf8_lower(coded.dictionary), characters=".,;:!?|\"'()[]{}*#$%&-_").to_pylist()
        table = np.array([self._hash(w) if w else 0 for w in names], np.uint64)
        words = table[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint64)
        there = words != 0
        if not there.all():
            offsets = np.concatenate([[0], np.cumsum(there)])[offsets]
            words = words[there]
        count = np.diff(offsets)
        n = self.words
        padded = np.concatenate([words, np.zeros(n - 1, np.uint64)])
        grams = np.zeros(len(words), np.uint64)
        for k in range(n):
            grams = _mix(grams + padded[k : k + len(words)] * np.uint64(2 * k + 1))
        # A shingle belongs to the text in which it starts, if it ends there as well.
        owner = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(words)) - offsets[:-1][owner]
        full = place + n <= count[owner]
        for i in np.flatnonzero((count > 0) & (count < n)):
            at = offsets[i]
            grams[at] = _mix(np.bitwise_xor.reduce(_mix(words[at : offsets[i + 1]] + np.arange(count[i], dtype=np.uint64))).reshape(1))[0]
            full[at] = True
        kept = np.concatenate([[0], np.cumsum(full)])
        return grams[full], kept[offsets]


def signatures(grams: np.ndarray, starts: np.ndarray, coordinates: int, seed: int) -> np.ndarray:
    """A row of ``coordinates`` minima for each text; a text without shingles gets the largest value."""
    sigma, windows = _permutations(coordinates, seed)
    place = sigma[(grams >> np.uint64(64 - 22)).astype(np.int64)]
    out = np.full((len(starts) - 1, coordinates), UNIVERSE, np.uint32)
    for i in range(len(starts) - 1):
        for a in range(starts[i], starts[i + 1], 2048):
            np.minimum(out[i], windows[place[a : min(a + 2048, starts[i + 1])]].min(axis=0), out=out[i])
    return out


def _signed(
    docs: DataFrame, text: str, doc_id: str, words: int, bands: int, rows: int, seed: int
) -> DataFrame:
    """doc_id, a fingerprint of the set of shingles, its size, the last bit of each coordinate, the hash of each band."""
    coordinates = bands * rows
    words_of_bits = -(-coordinates // 64)
    salt = np.arange(1, bands + 1, dtype=np.uint64) * _M2

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in slices(batches, 1, 2 << 20):
            grams, starts = shingler.shingles(batch.column(1))
            some = np.flatnonzero(np.diff(starts) > 0)
            ids = batch.column(0).take(pa.array(some))
            sig = signatures(grams, starts, coordinates, seed)[some].reshape(len(some), bands, rows).astype(np.uint64)
            h = np.broadcast_to(salt, (len(some), bands)).copy()
            for r in range(rows):
                h = _mix(h + sig[:, :, r])
            marks, sizes = [], []
            for i in some:
                own = np.unique(grams[starts[i] : starts[i + 1]])
                marks.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(len(own))
            bits = np.zeros((len(some), words_of_bits * 64), bool)
            bits[:, :coordinates] = sig.reshape(len(some), coordinates) & np.uint64(1)
            bits = np.packbits(bits, axis=1).view(np.int64).reshape(-1)
            yield pa.record_batch(
                [
                    ids,
                    pa.array(marks, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * words_of_bits), pa.array(bits)),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(len(some) + 1, dtype=np.int32) * bands), pa.array(h.reshape(-1).view(np.int64))
                    ),
                ],
                names=["doc_id", "mark", "n", "bits", "bands"],
            )

    rows_ = id_and_text(docs, doc_id, text)
    return rows_.where("doc_id is not null and text is not null").mapInArrow(
        sign, "doc_id long, mark binary, n long, bits array<long>, bands array<long>"
    )


def _shingle_sets(docs: DataFrame, text: str, doc_id: str, ids: DataFrame, words: int) -> DataFrame:
    """The distinct shingles of the documents in ``ids``."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in slices(batches, 1, 2 << 20):
            grams, starts = shingler.shingles(batch.column(1))
            own = [np.unique(grams[starts[i] : starts[i + 1]]) for i in range(batch.num_rows)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
            flat = np.concatenate(own) if own else np.zeros(0, np.uint64)
            yield pa.record_batch(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))],
                names=["doc_id", "shingles"],
            )

    rows = id_and_text(docs, doc_id, text)
    rows = rows.where("doc_id is not null and text is not null").join(small(ids), "doc_id", "left_semi")
    return rows.mapInArrow(collect, "doc_id long, shingles array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, text: str, doc_id: str, words: int, threshold: float) -> DataFrame:
    """Those of the (a, b) whose exact Jaccard similarity reaches the threshold."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = cut(_shingle_sets(docs, text, doc_id, ids, words))
    both = (
        pairs.join(sets.toDF("a", "x"), "a")
        .join(sets.toDF("b", "y"), "b")
        .withColumn("common", F.size(F.array_intersect("x", "y")))
        .select("a", "b", (F.col("common") / (F.size("x") + F.size("y") - F.col("common"))).alias("jaccard"))
    )
    return both.where(F.col("jaccard") >= threshold).select("a", "b").distinct()


def _possible(coordinates: int, threshold: float) -> F.Column:
    """Whether documents (na, xa) and (nb, xb), sizes of sets and bits of coordinates, may be as similar as ``threshold``.

    A set that is smaller than that share of another can't be. Two coordinates differ in their last bit with half the probability that they
    differ, and a pair that is as similar as ``threshold`` has more unlike bits than six standard deviations allow once in 10^9.
    """
    p = (1 - threshold) / 2
    most = coordinates * p + 6 * (coordinates * p * (1 - p)) ** 0.5
    unlike = sum((F.bit_count(F.col("xa")[k].bitwiseXOR(F.col("xb")[k])) for k in range(-(-coordinates // 64))), F.lit(0))
    return (F.least("na", "nb") >= F.greatest("na", "nb") * threshold) & (unlike <= most)


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, group_id): the least id that edges (a, b) lead to, for every id in an edge.

    Large-star and small-star rounds in turn; each is cut by a checkpoint, and their number is logarithmic.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = e.union(e.select("v", "u")).toDF("u", "v")
        hub = both.groupBy("u").agg(F.min("v").alias("m"))
        hub = hub.select("u", F.least("u", "m").alias("m"))
        large = both.join(hub, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small_ = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        e = cut(small_.where("u <> v").distinct())
        after = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if after == before:
            return e.select(F.col("u").alias("doc_id"), F.col("v").alias("group_id"))
        before = after


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    words: int = 3,
    bands: int = 42,
    rows: int = 6,
    threshold: float = 0.6,
    seed: int = 20,
) -> DataFrame:
    """A row (doc_id, duplicate_of) for each document that isn't the least of its group of near duplicates.

    Groups are the connected components of the pairs that share a band and have at least ``threshold`` of their
    ``words``-word shingles in common (exact Jaccard of the sets). sigma sends a shingle to one of 2^22 places, and
    the ``bands`` x ``rows`` coordinates are the circular shifts of one permutation pi at that place.

    Nothing is capped. Documents with equal sets of shingles are joined first, and one stands for all. In each bucket,
    all are verified against its least document; then every pair of a bucket that these edges leave unconnected is
    verified as well, so the groups are those that verifying all pairs would give. Before that, pairs go that can't be similar
    enough by the sizes of their sets or, but for one in 10^9, by the last bits of their coordinates; so a bucket of many unlike
    documents costs a comparison of a few numbers for each pair, and no texts.

    Rows with a null id or text, and texts without a word, are in no group. A text of fewer words than
    ``words`` is one shingle. Rows that share an id are one document, near another if any of its rows is.
    Other columns are not read; an empty table gives no rows.
    """
    docs = id_and_text(docs, doc_id, text)
    text, doc_id = "text", "doc_id"
    signed = cut(_signed(docs, text, doc_id, words, bands, rows, seed))
    equal = signed.groupBy("mark").agg(F.min("doc_id").alias("rep"))
    alike = signed.select("mark", "doc_id").join(equal, "mark").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    one = signed.join(equal.select("mark", F.col("rep").alias("doc_id")), ["mark", "doc_id"], "left_semi")
    keyed = one.select("doc_id", F.explode("bands").alias("h"))
    bucketed = keyed.selectExpr("doc_id", "h", "min(doc_id) over (partition by h) as hub", "max(doc_id) over (partition by h) as top")
    bucketed = cut(bucketed.where("hub <> top").select("doc_id", "h", "hub").distinct())
    possible = _possible(bands * rows, threshold)
    sketch = lambda x: one.selectExpr(f"doc_id as {x}", f"n as n{x}", f"bits as x{x}")
    stars = bucketed.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    stars = stars.join(sketch("a"), "a").join(sketch("b"), "b").where(possible).select("a", "b").distinct()
    first = cut(_verified(cut(stars), docs, text, doc_id, words, threshold))
    label = components(first)
    member = bucketed.join(label, "doc_id", "left").select("h", "doc_id", "hub", F.coalesce("group_id", "doc_id").alias("g"))
    several = member.groupBy("h").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("h")
    open_ = member.join(several, "h", "left_semi")
    side = lambda x: open_.select("h", "hub", F.col("doc_id").alias(x), F.col("g").alias(f"g{x}")).join(sketch(x), x)
    # All pairs of a bucket that are still apart; they are compared by their sketches where they meet, and few go on.
    rest = side("a").join(side("b").drop("hub"), "h").where("a < b and ga <> gb and a <> hub").where(possible).select("a", "b").distinct()
    second = _verified(cut(rest), docs, text, doc_id, words, threshold)
    found = components(first.union(second).union(alike))
    return found.select("doc_id", F.col("group_id").alias("duplicate_of"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **parameters: object) -> DataFrame:
    """``docs`` without the rows whose id ``near_duplicates`` lists: one document of each group stays.

    All columns go through unchanged. Rows in no group stay, those with a null id or text among them.
    """
    gone = small(cut(near_duplicates(docs, text, doc_id, **parameters).select(F.col("doc_id").alias("__gone"))))
    names = docs.columns
    packed = docs.toDF(*[f"c{i}" for i in range(len(names))])
    kept = packed.join(gone, F.col(f"c{names.index(doc_id)}").cast("long") == F.col("__gone"), "left_anti")
    return kept.toDF(*names)
