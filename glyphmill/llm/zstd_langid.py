"""Language identification by compression with per-language zstandard dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text, pick, slices, texts

SCHEMA = "doc_id long, lang_id string, best_bytes long, second_bytes long, margin double, rejected boolean"
#: ASCII bytes that aren't letters become spaces: digits and signs say nothing about the language.
_FOLD = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
#: Bytes of the pieces in which every text is compressed; a shorter text is one piece.
PIECE_BYTES = 32768


def fold(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_FOLD)


def fit_dictionaries(
    docs: DataFrame,
    text: str = "text",
    label: str = "lang",
    sample_docs: int = 400,
    dict_bytes: int = 65536,
) -> dict[str, bytes]:
    """Raw-content dictionaries: for each language, text of at most ``sample_docs`` different labelled documents, cut at ``dict_bytes``.

    The sample is bounded by these two parameters whatever the size of the corpus: the documents with
    the least hashes of a language are taken, of each as much as a dictionary can hold.
    Rows without text or label are left out.
    """
    rows = (
        pick(docs, l=label, t=text)
        .select("l", F.substring("t", 1, dict_bytes).alias("t"))
        .where("l is not null and length(t) > 0")
        .select("l", "t", F.xxhash64("t").alias("h"))
    )
    # A threshold on the hash leaves enough texts of the rarest language; without it, every text would be sorted.
    # It selects texts with all their copies, so hashes are counted and not rows.
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count_distinct("h").alias("n")).collect()}
    keep = None
    for lang, n in sorted(counts.items()):
        share = min(1.0, 3.0 * sample_docs / n)
        bound = int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1
        one = (F.col("l") == lang) & (F.col("h") <= F.lit(bound))
        keep = one if keep is None else keep | one
    if keep is None:
        return {}
    picked = (
        rows.where(keep)
        .distinct()
        .selectExpr("l", "t", "h", "row_number() over (partition by l order by h, t) as k")
        .where(F.col("k") <= sample_docs)
        .orderBy("l", "k")
        .select("l", "t")
    )
    out: dict[str, bytearray] = {}
    for lang, body in picked.toLocalIterator():
        own = out.setdefault(lang, bytearray())
        if len(own) < dict_bytes:
            own += fold(body) + b"\n"
    return {k: bytes(v[:dict_bytes]) for k, v in out.items()}


class Coder:
    """Compressed sizes of a text under each dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int, piece_bytes: int = PIECE_BYTES):
        self.names, self.piece_bytes = sorted(dictionaries), piece_bytes
        self.coders = []
        for name in self.names:
            parameters = zstandard.ZstdCompressionParameters.from_level(
                level,
                format=zstandard.FORMAT_ZSTD1_MAGICLESS,
                write_content_size=False,
                write_dict_id=False,
                write_checksum=False,
            )
            content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=parameters)
            self.coders.append(zstandard.ZstdCompressor(compression_params=parameters, dict_data=content).compress)

    def sizes(self, text: str) -> list[int]:
        data, n = fold(text), self.piece_bytes
        parts = [data[i : i + n] for i in range(0, len(data), n)]
        return [sum(len(c(p)) for p in parts) for c in self.coders]

    def decide(self, text: str | None, least_margin: float) -> tuple[str | None, int | None, int | None, float, bool]:
        if not text or not text.strip() or not self.names:
            return None, None, None, 0.0, True
        found = sorted(zip(self.sizes(text), self.names))
        best, name = found[0]
        second = found[1][0] if len(found) > 1 else None
        margin = 1.0 if second is None else (second - best) / max(1, best)
        return name, best, second, margin, margin < least_margin


def identify_language(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    level: int = 6,
    least_margin: float = 0.005,
    text: str = "text",
    doc_id: str = "doc_id",
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """The language whose dictionary makes the text smallest, and whether that is to be rejected.

    The whole text is lower-cased, ASCII characters other than letters become spaces, and it is cut into
    pieces of ``piece_bytes``, the last of which may be shorter, so that a long text can't serve as its own dictionary. Each
    piece is compressed by itself, and sizes are added up; a text of one piece is no special case.
    ``margin`` is (second - best) / best; ``rejected`` means that it is under ``least_margin``, as with ties.
    Null, empty and blank texts have no language and are rejected. Rows repeat as they repeat in ``docs``; a
    null ``doc_id`` stays null; other columns are not read. With one dictionary, nothing but blanks is rejected.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(dictionaries, level, piece_bytes)
        for batch in slices(batches, 1):
            rows = [coder.decide(t, least_margin) for t in texts(batch.column(1))]
            name, best, second, margin, rejected = zip(*rows)
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(name, pa.string()),
                    pa.array(best, pa.int64()),
                    pa.array(second, pa.int64()),
                    pa.array(margin, pa.float64()),
                    pa.array(rejected, pa.bool_()),
                ],
                names=["doc_id", "lang_id", "best_bytes", "second_bytes", "margin", "rejected"],
            )

    return id_and_text(docs, doc_id, text).mapInArrow(score, SCHEMA)


def keep_identified(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    level: int = 6,
    least_margin: float = 0.005,
    text: str = "text",
    label: str = "lang",
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """``docs`` without the rows that are rejected, ``label`` set to the language found; other columns unchanged.

    Whole rows go through, so repeated rows, null ids and columns of any name are kept as they are.
    """
    names = docs.columns
    at, mark = names.index(text), names.index(label) if label in names else -1
    schema = docs.schema
    packed = docs.toDF(*[f"c{i}" for i in range(len(names))])
    inner = packed.schema

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(dictionaries, level, piece_bytes)
        for batch in slices(batches, at):
            rows = [coder.decide(t, least_margin) for t in texts(batch.column(at))]
            keep = pa.array([not r[4] for r in rows], pa.bool_())
            columns = list(batch.columns)
            if mark >= 0:
                columns[mark] = pa.array([r[0] for r in rows], columns[mark].type)
            yield pa.record_batch(columns, schema=batch.schema).filter(keep)

    out = packed.mapInArrow(sift, inner)
    return out.toDF(*[f.name for f in schema])
