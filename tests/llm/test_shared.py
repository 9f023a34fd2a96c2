from __future__ import annotations

from types import SimpleNamespace

import pytest

from glyphmill.llm import shared


def test_sides_are_broadcast_by_their_bytes(spark):
    df = spark.createDataFrame([(i, "x" * 100, [1, 2]) for i in range(100)], "id long, text string, v array<long>")
    assert shared.byte_size(df) == 100 * (8 + 108 + 24) and shared.byte_size(df.limit(0)) == 0
    plan = lambda most: spark.range(10).join(shared.small(df, most), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(20_000) and "broadcast" not in plan(10_000)


def test_clusters_need_a_shared_folder():
    """A session of a cluster that names none."""
    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: d)))
