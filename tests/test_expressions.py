from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from glyphmill.functions import expressions as X
from glyphmill.languages import LANGUAGES, language_of


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_fixed2_is_exact(spark):
    values = [k / 8 for k in range(0, 4000)] + [k / 100 / 8 for k in range(4000)] + [1.005, 2.675, 1e6 + 0.005, 0.0]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", X.fixed2(F.col("x"))).collect()
    for x, got in rows:
        assert got == float(Decimal(x).quantize(Decimal("0.01"), ROUND_HALF_UP))


def test_text(spark):
    assert one(spark, X.trim(F.lit("﻿  a b\t\r\n"))) == "a b"
    assert one(spark, X.is_blank(F.lit("  \r"))) and one(spark, X.is_blank(F.lit(""))) and not one(spark, X.is_blank(F.lit(" x")))
    assert one(spark, X.clean_signature(F.lit("f(\n  uint a ,\n  uint b,\n )  public"))) == "f(uint a, uint b, ) public"
    assert [one(spark, X.truncate(F.lit("x" * n), 80)) for n in (80, 81)] == ["x" * 80, "x" * 77 + "..."]
    assert one(spark, X.utf16_length(F.lit("a🙂"))) == 3
    assert one(spark, X.truncate(F.lit("🙂" * 45), 80)) == "🙂" * 38 + "\ufffd..." and one(spark, X.truncate(F.lit("x" + "🙂" * 45), 80)) == "x" + "🙂" * 38 + "..."
    assert one(spark, X.truncate(F.lit("🙂" * 40), 80)) == "🙂" * 40
    assert one(spark, F.size(X.lines_of(F.lit("a\n\n")))) == 3
    lines = [("// a", True, True), ("  /* a", True, True), ("* a", True, True), ("# a", True, True), ("-- a", False, True), (";; a", False, True), ("x // a", False, False)]
    for line, whole, changed in lines:
        assert (one(spark, X.comment_only(F.lit(line))), one(spark, X.comment_only_changed(F.lit(line)))) == (whole, changed)


def test_languages(spark):
    assert len(LANGUAGES) == 15
    for path, language in (("a/b.SOL", "solidity"), ("x.d.ts", "typescript"), ("x.h", "cpp"), ("a.sol/x", None), (".go", None), ("m.masm", "masm"), ("x.txt", None)):
        assert one(spark, language_of(F.lit(path))) == language
