from __future__ import annotations

from pathlib import Path

import pytest
import zstandard

from glyphmill.llm import zstd_langid as Z

SF = Path("/root/testdata/sf0.01/documents.parquet")


def test_defined_results(spark):
    train = spark.createDataFrame(
        [("the cat and the dog went to the house of the king", "en"), ("der hund und die katze gingen in das haus des königs", "de")],
        "text string, lang string",
    )
    model = Z.fit_dictionaries(train)
    assert sorted(model) == ["de", "en"]
    rows = [(1, "the house and the dog went to the cat", "x"), (2, None, "x"), (3, "", "x"), (4, " \n", None), (None, "die katze gingen in das haus", "x"), (1, "the house and the dog went to the cat", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rejected string").selectExpr("*", "'zz' as lang")
    got = Z.identify_language(df, model).collect()
    assert sorted((r.doc_id or 0, r.lang_id or "", r.rejected) for r in got) == [(0, "de", False), (1, "en", False), (1, "en", False), (2, "", True), (3, "", True), (4, "", True)]
    kept = Z.keep_identified(df, model)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.lang) for r in kept.collect()) == [(0, "de"), (1, "en"), (1, "en")]
    assert Z.identify_language(df.limit(0), model).collect() == []
    assert Z.fit_dictionaries(train.limit(0)) == {}


def test_ties_are_rejected():
    coder = Z.Coder({"a": b"same words here", "b": b"same words here"}, 6)
    assert coder.decide("same words", 0.005) == ("a", coder.sizes("same words")[0], coder.sizes("same words")[1], 0.0, True)


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(str(SF)).where("length(text) > 60")
    model = Z.fit_dictionaries(docs.where("doc_id % 2 = 0"), sample_docs=100)
    got = Z.identify_language(docs.where("doc_id % 2 = 1"), model).join(docs, "doc_id").collect()
    assert sum(r.lang_id == r.lang for r in got) > 0.98 * len(got)
    assert sum(r.rejected for r in got) < 0.02 * len(got)


def test_long_text_is_read_whole():
    coder = Z.Coder({"a": b"alpha beta gamma delta " * 50, "b": b"uno dos tres cuatro " * 50}, 6)
    text = "alpha beta " * 4 + "uno dos tres cuatro " * 20_000
    assert coder.decide(text, 0.005)[0] == "b"


def test_copies_do_not_fill_the_sample(spark):
    """A language of many copies of few texts has as many different ones in its dictionary as one without copies."""
    from glyphmill.llm import zstd_langid as Z

    texts = ["".join(chr(97 + int(d)) for d in str(n * 7919 + 10**6)) for n in range(40)]
    rows = [(t, "a") for t in texts for _ in range(100)] + [(t, "b") for t in texts]
    found = Z.fit_dictionaries(spark.createDataFrame(rows, "text string, lang string"), sample_docs=20)
    assert found["a"] == found["b"] and len(set(found["a"].split())) == 20


def brute(text, dictionaries, piece=32768, least=0.005):
    """Each piece compressed by itself under each dictionary, with a new compressor every time."""
    if not text or not text.strip():
        return None, True
    data = "".join(c if c.isalpha() or ord(c) > 127 else " " for c in text.lower()).encode()
    sizes = []
    for name, content in dictionaries.items():
        total = 0
        for a in range(0, len(data), piece):
            parameters = zstandard.ZstdCompressionParameters.from_level(6, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False, write_checksum=False)
            coder = zstandard.ZstdCompressor(compression_params=parameters, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            total += len(coder.compress(data[a : a + piece]))
        sizes.append((total, name))
    (best, name), (second, _) = sorted(sizes)[:2]
    return name, (second - best) / best < least


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_against_compressing_one_by_one(spark):
    docs = spark.read.parquet(str(SF)).where("doc_id % 5 = 0")
    model = Z.fit_dictionaries(spark.read.parquet(str(SF)))
    text = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (r.lang_id, r.rejected) for r in Z.identify_language(docs, model).collect()}
    want = {i: brute(t, model) for i, t in text.items()}
    assert {i: r for i, (_, r) in got.items()} == {i: r for i, (_, r) in want.items()}
    assert {i: n for i, (n, r) in got.items() if not r} == {i: n for i, (n, r) in want.items() if not r}


def test_pieces(spark):
    """Texts of a piece, one byte less or more, and of many pieces, through Spark; sizes are those of the pieces in turn."""
    words = "the cat and the dog went to the house of the king while "
    model = {"de": b"der hund und die katze gingen in das haus", "en": b"the cat and the dog went to the house of the king"}
    coder = Z.Coder(model, 6, 100)
    whole = (words * 3)[:300]
    assert coder.sizes(whole) == [sum(x) for x in zip(*(coder.sizes(whole[a : a + 100]) for a in (0, 100, 200)))]
    rows = [(n, (words * 20_000)[:n]) for n in (99, 100, 101, 32767, 32768, 32769, 1_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for piece in (100, 32768):
        got = {r.doc_id: r.best_bytes for r in Z.identify_language(df, model, piece_bytes=piece).collect()}
        assert got == {n: Z.Coder(model, 6, piece).sizes(t)[1] for n, t in rows}
