"""Toxic spans by a linear-chain conditional random field with two states."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text, pick, slices

SCHEMA = "doc_id long, toxic boolean, score double, toxic_tokens double, spans array<struct<start:long,end:long,marginal:double>>"
_BITS = 18
_EDGE = ".,;:!?|\"'()[]{}*#$%&-_"
_PREFIXES = (4, 5, 6, 7)
_SEED = np.uint64(0xC2B2AE3D27D4EB4F)
_TOKEN = re.compile(r"\S+")
#: By default, marginals under this are no evidence; many small ones of a long text would add up.
LEAST_EVIDENCE = 0.3
#: By default, a word is taken for toxic if toxic documents have it at so many times the rate of clean ones, with so much of a document added to the clean ones that have it.
LEAST_RATIO, SMOOTHING = 40.0, 0.2


def hash_words(words: list[str]) -> np.ndarray:
    """Hashes of the features of each word: the whole word, its first 4, 5, 6 and 7 characters, its last 4. 0 where it has none, as prefixes of the whole word.

    Words count at their full length; those of fewer than four characters have all of them as their last.
    """
    n = len(words)
    out = np.zeros((n, 6), np.uint64)
    if not n:
        return out
    length = np.fromiter(map(len, words), np.int64, n)
    out[:, 0] = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "replace")) for w in words), np.uint64, n) | np.uint64(1)
    most = max(_PREFIXES)
    codes = np.array([w[:most] for w in words], f"U{most}").view(np.uint32).reshape(n, -1)
    h = np.full(n, _SEED, np.uint64)
    for j in range(most):
        h = _mixed(h ^ codes[:, j])
        if j + 1 in _PREFIXES:
            k = _PREFIXES.index(j + 1) + 1
            out[:, k] = np.where(length > j + 1, h * np.uint64(2 * k + 1) | np.uint64(1), 0)
    codes = np.array([w[-4:] for w in words], "U4").view(np.uint32).reshape(n, -1)
    end = np.full(n, ~_SEED, np.uint64)
    for j in range(4):
        end = np.where(j < length, _mixed(end ^ codes[:, j]), end)
    out[:, 5] = end | np.uint64(1)
    out[length == 0] = 0
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _buckets(hashes: np.ndarray) -> np.ndarray:
    """Places of weights; that behind the last is always 0."""
    return np.where(hashes != 0, (_mixed(hashes) >> np.uint64(64 - _BITS)).astype(np.int64), 1 << _BITS)


def tokenize(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Unlike words, lower-cased and without signs at their ends; the word of each token; where the tokens of each text begin. Tokens are what white space separates."""
    split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    offsets = split.offsets.to_numpy().astype(np.int64)
    flat = split.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0)
    if len(flat) and not pc.all(full).as_py():
        offsets = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[offsets]
        flat = flat.filter(full)
    coded = flat.dictionary_encode()
    words = pc.utf8_trim(pc.utf8_lower(coded.dictionary), characters=_EDGE).to_pylist()
    return words, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets


def marginals(u: np.ndarray, first: np.ndarray, transition: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(y=1) of each token by forward-backward, and the ratios of the messages alpha and beta.

    ``u`` is the log-odds of each token, ``first`` marks tokens that begin a text, ``transition`` holds the weights of pairs
    of states and ``start`` the log-odds before the first token. With two states a message is one ratio, and a step is
    a fractional linear map; the texts form one chain that is reset where a text begins. Blocks of the chain are composed
    side by side, then joined, so a long text takes no more steps than many short ones.
    """
    n = len(u)
    if not n:
        return np.zeros(0), np.zeros(0), np.zeros(0)
    side = int(np.ceil(np.sqrt(n)))
    rows = -(-n // side)
    e = np.ones(rows * side)
    e[:n] = np.exp(np.clip(u, -30, 30))
    reset = np.zeros(rows * side, bool)
    reset[:n] = first
    reset[n:] = True
    (t00, t01), (t10, t11) = np.exp(transition)
    begin = float(np.exp(start))
    # Forward: r -> e (t01 + t11 r) / (t00 + t10 r), or e * begin at a reset. Backward from t to t - 1: b -> (t10 + t11 e b) / (t00 + t01 e b), or 1.
    e2, reset2 = np.ascontiguousarray(e.reshape(rows, side).T), np.ascontiguousarray(reset.reshape(rows, side).T)

    def scan(maps: Iterator[tuple], initial: float, forward: bool) -> np.ndarray:
        """maps: (a, b, c, d) of r -> (a + b r) / (c + d r) for each column in the order of reading."""
        steps = list(maps)
        p, q, s, w = np.zeros(rows), np.ones(rows), np.ones(rows), np.zeros(rows)  # the identity
        for a, b, c, d in steps:
            p, q, s, w = a * s + b * p, a * w + b * q, c * s + d * p, c * w + d * q
            scale = 1.0 / (p + q + s + w)
            p, q, s, w = p * scale, q * scale, s * scale, w * scale
        into, r = np.empty(rows), initial
        for j in range(rows) if forward else range(rows - 1, -1, -1):
            into[j] = r
            r = (p[j] + q[j] * r) / (s[j] + w[j] * r)
        out, r = np.empty((side, rows)), into
        for k, (a, b, c, d) in enumerate(steps):
            r = (a + b * r) / (c + d * r)
            out[k if forward else side - 1 - k] = r
        return out

    def ahead() -> Iterator[tuple]:
        for k in range(side):
            x, z = e2[k], reset2[k]
            yield np.where(z, x * begin, x * t01), np.where(z, 0.0, x * t11), np.where(z, 1.0, t00), np.where(z, 0.0, t10)

    def back() -> Iterator[tuple]:
        for k in range(side - 1, -1, -1):
            x, z = e2[k], reset2[k]
            yield np.where(z, 1.0, t10), np.where(z, 0.0, t11 * x), np.where(z, 1.0, t00), np.where(z, 0.0, t01 * x)

    alpha = scan(ahead(), 1.0, True).T.reshape(-1)[:n]
    before = scan(back(), 1.0, False).T.reshape(-1)  # at t: the message that reaches t - 1
    beta = np.append(before[1 : n], 1.0)
    odds = alpha * beta
    return odds / (1.0 + odds), alpha, beta


@dataclass
class Model:
    """Weights of hashed features of the word itself and of its neighbours, of pairs of states and of the start."""

    own: np.ndarray
    left: np.ndarray
    right: np.ndarray
    transition: np.ndarray
    start: float

    def potentials(self, words: list[str], index: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = _buckets(hash_words(words))
        first = np.zeros(len(index), bool)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        own = self.own[at].sum(axis=1, dtype=np.float64)
        return _log_odds(own, self.left[at[:, 0]], self.right[at[:, 0]], index, first), first


def _log_odds(own: np.ndarray, left: np.ndarray, right: np.ndarray, index: np.ndarray, first: np.ndarray) -> np.ndarray:
    u = own[index]
    inner = ~first[1:]
    u[1:] += np.where(inner, left[index[:-1]], 0.0)
    u[:-1] += np.where(inner, right[index[1:]], 0.0)
    return u


def label_tokens(
    hashes: np.ndarray, index: np.ndarray, offsets: np.ndarray, toxic: np.ndarray, least_ratio: float = LEAST_RATIO, smoothing: float = SMOOTHING
) -> np.ndarray:
    """Labels of tokens from labels of documents: 1 in a toxic document for words with a feature that toxic documents alone share.

    That is a feature in at least 3 toxic documents and 1 in 150 of them, whose share of the toxic documents is ``least_ratio`` times
    that of the clean ones, of which ``smoothing`` more are taken to have it.
    """

    def seen(i: int) -> np.ndarray:
        own = np.unique(hashes[np.unique(index[offsets[i] : offsets[i + 1]])])
        return own[own != 0]

    n = [max(1, int((toxic == 0).sum())), max(1, int((toxic == 1).sum()))]
    least = max(3, n[1] // 150)
    found = [seen(i) for i in np.flatnonzero(toxic == 1)]
    names, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, int))
    names, counts = names[counts >= least], counts[counts >= least]
    clean = np.zeros(len(names))
    for i in np.flatnonzero(toxic == 0) if len(names) else ():
        own = seen(i)
        at = np.minimum(np.searchsorted(names, own), len(names) - 1)
        clean[at[names[at] == own]] += 1
    marks = names[counts / n[1] >= least_ratio * ((clean + smoothing) / n[0])]
    marked = np.isin(hashes, marks).any(axis=1)
    return (marked[index] & np.repeat(toxic.astype(bool), np.diff(offsets))).astype(np.float32)


def _parts(first: np.ndarray, size: int = 400_000) -> list[slice]:
    """Runs of whole texts of about ``size`` tokens, which are all that is worked on at a time."""
    begin = np.flatnonzero(first)
    cuts = [0]
    for at in begin:
        if at - cuts[-1] >= size:
            cuts.append(int(at))
    return [slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(first)]) if b > a]


def fit(
    texts: list[str],
    toxic: list[int],
    epochs: int = 40,
    rate: float = 0.5,
    decay: float = 1e-4,
    least_ratio: float = LEAST_RATIO,
    smoothing: float = SMOOTHING,
) -> Model:
    """Maximum likelihood by Adagrad; each epoch goes over the whole sample, part by part."""
    words, index, offsets = tokenize(pa.array(texts, pa.string()))
    hashes = hash_words(words)
    y = label_tokens(hashes, index, offsets, np.array(toxic), least_ratio, smoothing)
    first = np.zeros(len(index), bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    size = (1 << _BITS) + 1
    at = _buckets(hashes).astype(np.int32)
    near = at[:, 0]
    weights = {k: np.zeros(size) for k in ("own", "left", "right")}
    transition, start = np.array([[0.0, -3.0], [0.0, 0.0]]), -3.0
    square = {k: np.full(size, 1e-3) for k in weights} | {"t": np.full((2, 2), 1e-3), "s": 1e-3}
    n, count = max(1, len(index)), len(words)
    parts = _parts(first)
    for _ in range(epochs if len(index) else 0):
        own = weights["own"][at].sum(axis=1)
        left, right = weights["left"][near], weights["right"][near]
        by_word = {k: np.zeros(count) for k in weights}
        pairs, begins = np.zeros((2, 2)), 0.0
        t = np.exp(transition)
        for part in parts:
            i, f, yy = index[part], first[part], y[part]
            u = _log_odds(own, left, right, i, f)
            p, alpha, beta = marginals(u, f, transition, start)
            gap, inner = yy - p, np.flatnonzero(~f[1:])
            by_word["own"] += np.bincount(i, gap, count)
            by_word["left"] += np.bincount(i[inner], gap[inner + 1], count)
            by_word["right"] += np.bincount(i[inner + 1], gap[inner], count)
            x, b = np.exp(np.clip(u, -30, 30))[inner + 1], beta[inner + 1]
            a0 = 1 / (1 + alpha[inner])
            pair = np.array([[a0 * t[0, 0], a0 * t[0, 1] * x * b], [(1 - a0) * t[1, 0], (1 - a0) * t[1, 1] * x * b]])
            y0, y1 = yy[inner].astype(float), yy[inner + 1].astype(float)
            real = np.array([[(1 - y0) @ (1 - y1), (1 - y0) @ y1], [y0 @ (1 - y1), y0 @ y1]])
            pairs += real - (pair / pair.sum(axis=(0, 1))).sum(axis=2)
            begins += float(gap[f].sum())
        grad = {"own": np.bincount(at.reshape(-1), np.repeat(by_word["own"], at.shape[1]), size)}
        grad |= {k: np.bincount(near, by_word[k], size) for k in ("left", "right")}
        for k, g in grad.items():
            g = g / n * 1000 - decay * weights[k]
            square[k] += g * g
            weights[k] += rate * g / np.sqrt(square[k])
            weights[k][-1] = 0
        g = pairs / n * 1000
        square["t"] += g * g
        transition = transition + rate * g / np.sqrt(square["t"])
        gs = begins / n * 1000
        square["s"] += gs * gs
        start += rate * gs / np.sqrt(square["s"])
    return Model(*(weights[k].astype(np.float32) for k in ("own", "left", "right")), transition, start)


def fit_from_labels(
    docs: DataFrame,
    labels: DataFrame,
    sample_toxic: int = 800,
    sample_clean: int = 3200,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "toxic",
    least_ratio: float = LEAST_RATIO,
    smoothing: float = SMOOTHING,
) -> Model:
    """A model from at most ``sample_toxic`` and ``sample_clean`` labelled documents, those with the least hashes of their ids; their number doesn't grow with the corpus."""
    marked = pick(labels, doc_id=doc_id, toxic=label).select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
    marked = marked.where("doc_id is not null")
    some = [
        marked.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        for k, n in ((1, sample_toxic), (0, sample_clean))
    ]
    chosen = F.broadcast(some[0].union(some[1]))  # bounded by the two parameters
    rows = id_and_text(docs, doc_id, text)
    table = rows.where("text is not null").join(chosen, "doc_id").select("doc_id", "text", "toxic").toArrow()
    table = table.sort_by("doc_id")
    return fit(table["text"].to_pylist(), table["toxic"].to_pylist(), least_ratio=least_ratio, smoothing=smoothing)


def tag(model: Model, texts: pa.Array, threshold: float, least_evidence: float = LEAST_EVIDENCE) -> list[tuple[float, float, list[dict]]]:
    """For each text the probability that any token of those with evidence is toxic, the expected number of toxic tokens, and the spans of tokens whose marginal reaches the threshold."""
    words, index, offsets = tokenize(texts)
    u, first = model.potentials(words, index, offsets)
    p, _, _ = marginals(u, first, model.transition, model.start)
    total = np.concatenate([[0.0], np.cumsum(p)])
    out = []
    for i in range(len(texts)):
        a, b = offsets[i], offsets[i + 1]
        if a == b:
            out.append((0.0, 0.0, []))
            continue
        own = p[a:b]
        spans: list[dict] = []
        if own.max() >= threshold:
            last = -2
            for k, m in enumerate(_TOKEN.finditer(texts[i].as_py())):
                if k >= len(own):
                    break
                if own[k] >= threshold:
                    if last == k - 1:
                        spans[-1]["end"] = m.end()
                        spans[-1]["marginal"] = max(spans[-1]["marginal"], float(own[k]))
                    else:
                        spans.append({"start": m.start(), "end": m.end(), "marginal": float(own[k])})
                    last = k
        seen = own[own >= least_evidence]
        out.append((float(1 - np.exp(np.log1p(-np.minimum(seen, 1 - 1e-9)).sum())), float(total[b] - total[a]), spans))
    return out


def score_documents(
    docs: DataFrame,
    model: Model,
    threshold: float = 0.5,
    least_score: float = 0.9,
    text: str = "text",
    doc_id: str = "doc_id",
    least_evidence: float = LEAST_EVIDENCE,
) -> DataFrame:
    """A row (doc_id, toxic, score, toxic_tokens, spans) for every row of ``docs``.

    ``score`` is the probability that any token is toxic, of those whose marginals reach ``least_evidence``; ``toxic_tokens`` is the sum of all
    marginals, ``spans`` are the runs of tokens whose marginals reach ``threshold``, as character offsets from 0 with exclusive ends.
    A document is ``toxic`` if its score reaches ``least_score`` and it has a span: one doubtful word isn't enough. Whole texts are tagged. Null, empty and blank texts score 0 and have no spans; repeated rows repeat;
    a null id stays null. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))
        for batch in slices(batches, 1, 2 << 20):
            score, mass, spans = zip(*tag(model, batch.column(1), threshold, least_evidence))
            toxic = [s >= least_score and bool(x) for s, x in zip(score, spans)]
            yield pa.record_batch(
                [batch.column(0), pa.array(toxic, pa.bool_()), pa.array(score, pa.float64()), pa.array(mass, pa.float64()), pa.array(spans, kind)],
                names=["doc_id", "toxic", "score", "toxic_tokens", "spans"],
            )

    rows = id_and_text(docs, doc_id, text)
    return rows.mapInArrow(run, SCHEMA)
