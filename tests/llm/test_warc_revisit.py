from __future__ import annotations

from glyphmill.llm import shared
from glyphmill.llm import warc_revisit as R

ROWS = [
    (3, "http://a/3", "same\r\n\r\npage"), (1, "http://a/1", "same\r\n\r\npage"), (2, "http://b\r\nX: y", "ünlike"), (4, None, None), (5, "http://a/5", ""),
    (None, "http://a/0", "same\r\n\r\npage"), (6, "http://a/6", "long " * 60_000), (2, "http://b\r\nX: y", "ünlike"),
]


def test_round_trip_of_archives(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, digest string")
    made = R.resolve(df)
    path = shared.fresh_dir(spark, "warc")
    R.write_archives(made, path, records_per_file=3)
    got = {(r.page_id, r.target_uri): r for r in R.read_archives(spark, path).collect()}
    assert R.read_archives(spark, path).count() == len(ROWS)
    assert got[1, "http://a/1"].record_type == "response" and bytes(got[1, "http://a/1"].block).endswith(b"\r\n\r\nsame\r\n\r\npage")
    for key in ((3, "http://a/3"), (None, "http://a/0")):
        assert (got[key].record_type, got[key].refers_to, got[key].refers_to_uri) == ("revisit", got[1, "http://a/1"].record_id, "http://a/1")
        assert bytes(got[key].block) == b"" and got[key].payload_digest == got[1, "http://a/1"].payload_digest
    assert got[2, "http://b X: y"].record_type == "response" and got[2, "http://b X: y"].content_length == len(bytes(got[2, "http://b X: y"].block))
    assert got[4, None].record_type == "response" and got[5, "http://a/5"].record_type == "revisit"
    assert bytes(got[6, "http://a/6"].block).endswith(b"long " * 60_000)


def test_given_revisits(spark):
    rows = [(1, "u1", "body", "response", None), (2, "u2", None, "revisit", None), (3, "u3", None, "Revisit", "sha256:none")]
    digest = "sha256:230d8358dc8e8890b4c58deeb62912ee2f20357ae92a5cc861b98e68fe31acb5"
    rows[1] = (*rows[1][:4], digest)
    df = spark.createDataFrame(rows, "page_id long, url string, html string, kind string, digest string")
    got = {r.page_id: r for r in R.resolve(df, record_type="kind", payload_digest="digest").collect()}
    assert got[1].payload_digest == digest
    assert [(got[i].record_type, got[i].refers_to_id, got[i].refers_to_uri) for i in (1, 2, 3)] == [("response", None, None), ("revisit", 1, "u1"), ("revisit", None, None)]


def test_empty(spark):
    assert R.resolve(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_join_by_shuffle_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"u{i}", f"body {i % 7}") for i in range(50)], "page_id long, url string, html string")
    want = sorted(map(tuple, R.resolve(df).collect()))
    monkeypatch.setattr(R, "small", lambda links: links.hint("merge"))
    assert sorted(map(tuple, R.resolve(df).collect())) == want


def test_files_are_read_side_by_side(spark):
    """Files of a few kilobytes with as little to a task."""
    df = spark.createDataFrame([(i, f"u{i}", f"{i} " * 3000) for i in range(60)], "page_id long, url string, html string").repartition(6, "page_id")
    path = shared.fresh_dir(spark, "warc")
    R.write_archives(R.resolve(df), path, records_per_file=5)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, "40k")
    try:
        got = R.read_archives(spark, path)
        assert got.rdd.getNumPartitions() >= 6 and sorted(r.page_id for r in got.collect()) == list(range(60))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
