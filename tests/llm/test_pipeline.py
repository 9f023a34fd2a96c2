from __future__ import annotations

from pathlib import Path

import pytest

import corpus_pipeline as P

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


def test_stages_against_brute_force(spark):
    import tiktoken
    from test_circulant_minhash import brute
    from test_zstd_langid import brute as language

    from glyphmill.llm import byte_bpe as B
    from glyphmill.llm import zstd_langid as Z

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = Z.fit_dictionaries(docs)
    rows = {r.doc_id: r for r in docs.collect()}
    found = {i: language(r.text, model) for i, r in rows.items()}
    stay = {i for i, (_, rejected) in found.items() if not rejected}
    first = {}
    for i in sorted(stay):
        first.setdefault(rows[i].text, i)
    stay = set(first.values())
    stay -= set(brute([(i, rows[i].text) for i in stay]))
    out = P.run(spark, str(SF))
    assert set(docs.columns) | {"token_ids", "n_tokens"} == set(out.columns)
    got = out.collect()
    assert len(got) == len({r.doc_id for r in got})
    assert {r.doc_id for r in got} == stay
    assert all(r.text == rows[r.doc_id].text and r.lang == found[r.doc_id][0] for r in got)
    other = tiktoken.Encoding("t", pat_str=B.PATTERN, mergeable_ranks={t: i for i, t in enumerate(B.read_ranks(B.VOCABULARY))}, special_tokens={})
    assert all(list(r.token_ids) == other.encode_ordinary(r.text) and len(r.token_ids) == r.n_tokens for r in got)


def test_every_stage_takes_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, str(SF))
        assert docs.collect() == []


def test_every_stage_takes_nulls_ties_and_clashing_names(spark):
    """Rows without a text can't be identified and go; others of one text are one document."""
    from pyspark.sql import functions as F

    text = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 500").orderBy("doc_id").first().text
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, None, None, None), (None, text + " more words here", "en", "b", 1), (4, None, "en", "a", 1), (5, "", "en", "a", 1), (6, text * 40, "en", "a", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("c0", "k", "slot", "key", "bucket", "h", "__gone", "mark", "duplicate_of", "TEXT_"):
        docs = docs.withColumn(name, F.lit("x"))
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(SF))
        assert out.columns[: len(docs.columns)] == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert sorted((r.doc_id or 0 for r in docs.collect())) == [0, 1] and docs.where("n_tokens > 0").count() == 2


def test_rows_come_in_the_order_of_the_schedule(spark):
    """Blocks of 16 documents; until a source has but one left, each is within a block of its share."""
    from collections import Counter

    from glyphmill.llm import pfair_mixing as M

    sources = [r.source for r in P.run(spark, str(SF.parent / "sf0.01")).select("source").collect()]
    sizes = Counter(sources)
    share = M.shares({s: n**0.5 for s, n in sizes.items()}, 1000)
    assert len(sizes) > 1
    seen = Counter()
    for t in range(1, len(sources) // 16):
        (source,) = set(sources[16 * t - 16 : 16 * t])
        seen[source] += 1
        assert all(abs(seen[s] - t * n / sum(share.values())) < 1 for s, n in share.items())
        if any(16 * (seen[s] + 1) >= n for s, n in sizes.items()):
            break
    assert t > 10


def test_places_outlast_files_read_by_size(spark, tmp_path):
    """A hot source of long documents; files of uneven sizes, given in reverse order."""
    rows = [(i, f"text {i} " * (900 if i < 300 else 1), "hot" if i < 300 else "ab"[i % 2]) for i in range(420)]
    docs = spark.createDataFrame(rows + [(5, "another", "a"), (None, "none", None)], "doc_id long, text string, source string")
    P.tokens(spark, docs.orderBy("source", "text"), "").write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = P.pfair_mixing.mix(docs).select("text").collect()
    assert [r.text for r in got.orderBy(*P.PLACES).collect()] == [r.text for r in want]
    files = got.select("text", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index")
    assert [r.text for r in files.collect()] == [r.text for r in want] and files.select("file_name").distinct().count() > 1
    assert got.select(*P.PLACES).distinct().count() == len(want)
