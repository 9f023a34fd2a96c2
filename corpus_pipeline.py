"""Documents to training tokens, in stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import byte_bpe, circulant_minhash, grace_dedup, pfair_mixing, shared, zstd_langid

#: Columns of the slot of a document in the schedule of the mixture and of its place in the slot.
PLACES = ("mix_slot", "mix_place")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: the documents it rejects go; ``lang`` becomes the language found."""
    return zstd_langid.keep_identified(docs, zstd_langid.fit_dictionaries(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: one document of each text stays, that of the least id."""
    return grace_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each group stays, that of the least id."""
    return circulant_minhash.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources: all documents, in the order of a Pfair schedule with square-root weights."""
    return pfair_mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: token ids beside the columns of the documents; each text is had back from its ids, or it raises.

    Files are not read in the order they were written in, so the schedule, which ids and texts alone decide, is made once
    more: rows come in its order and have their slot and place in ``PLACES``.
    """
    model = byte_bpe.serialize_model(byte_bpe.read_ranks(byte_bpe.VOCABULARY))
    return byte_bpe.with_tokens(pfair_mixing.mix(docs, places=PLACES), model)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("source_mixture", mixture),
    ("byte_bpe", tokens),
]

#: Compression, MinHash and BPE can't be put in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; what each returns is written as Parquet and read as the next one's input, then deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = shared.fresh_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            shared.remove(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``placed`` sorted by slot and place, without these two columns."""
    return placed(spark, sf_dir).orderBy(*PLACES).drop(*PLACES)
