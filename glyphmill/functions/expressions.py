"""Text and number expressions; all stay within whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\x0B\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def trim(text: Column) -> Column:
    """Without white space at its ends, no-break space and byte order mark included."""
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def is_blank(line: Column) -> Column:
    return line.rlike(f"^{_SPACE}*$")


def comment_only(line: Column) -> Column:
    """What counts as a line of comment alone in a file."""
    return trim(line).rlike(r"^(//|/\*|\*|#)")


def comment_only_changed(line: Column) -> Column:
    """What counts as one among changed lines."""
    return trim(line).rlike(r"^(//|/\*|\*|#|--|;;)")


def lines_of(content: Column) -> Column:
    """The lines as an array; a line feed at the end is followed by an empty line."""
    return F.split(content, "\n", -1)


def clean_signature(raw: Column) -> Column:
    out = F.regexp_replace(raw, f"{_SPACE}+", " ")
    for pattern, by in ((r"\(\s+", "("), (r"\s+\)", ")"), (r"\s*,\s*", ", ")):
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def utf16_length(text: Column) -> Column:
    """Code units, of which characters beyond the basic plane have two."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def truncate(text: Column, most: int) -> Column:
    """Texts of more than ``most`` code units are cut to three less and end in dots. Half a character that the cut leaves becomes U+FFFD, as it does wherever such text is written."""
    units, n = F.encode(text, "UTF-16BE"), most - 3
    last = F.hex(F.substring(units, 2 * n - 1, 2))
    halved = last.between("D800", "DBFF")
    kept = F.decode(F.substring(units, F.lit(1), F.when(halved, 2 * n - 2).otherwise(2 * n)), "UTF-16BE")
    short = F.concat(kept, F.when(halved, "\ufffd").otherwise(""), F.lit("..."))
    return F.when(utf16_length(text) > most, short).otherwise(text)


def fixed2(x: Column) -> Column:
    """Two decimals, halves up on the exact binary value; x must not be negative.

    The error of x * 200 is found by splitting x in halves of its mantissa, so the comparison with the half is exact.
    """
    n = F.floor(x * 100)
    product = x * 200
    high = x * 134217729.0 - (x * 134217729.0 - x)
    error = (high * 200 - product) + (x - high) * 200
    up = (product - (2 * n + 1).cast("double")) + error >= 0
    return F.when(up, (n + 1).cast("double") / 100).otherwise(n.cast("double") / 100)


def review_hours(nloc: Column, complexity: Column, density: Column) -> Column:
    """Hours to review ``nloc`` lines; the constants are columns of ``language_dim``."""
    shape = F.tanh((complexity - F.col("mid")) / F.col("steep"))
    by_complexity = F.when(shape >= 0, shape * F.col("penalty_cap")).otherwise(shape * F.col("benefit_cap"))
    documented = F.greatest(F.lit(0.0), density) / F.greatest(F.lit(1.0), F.col("full_density"))
    by_comments = F.tanh(documented * 2.646) * F.col("doc_cap")
    factor = F.lit(1.0) + by_complexity - by_comments
    factor = F.greatest(F.lit(0.5), F.least(F.lit(1.0) + F.col("penalty_cap"), factor))
    return fixed2(nloc / F.col("rate") * 8 * factor)


def share(part: Column, whole: Column) -> Column:
    """part / whole in per cent, 0 where there is no whole."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))
