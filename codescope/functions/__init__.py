"""Column expressions: identifiers, sizes, scores and zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_identifier(name: Column) -> Column:
    """Tokens of an identifier: cut at underscores, digits, lowerUpper and ACRONYMWord."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.filter(F.split(spaced, r"[_\s\d#]+"), lambda t: t != "")


def fingerprint(shape: Column) -> Column:
    return F.substring(F.sha1(shape), 1, 12)


def text_shape(text: Column) -> Column:
    """What is left of a text when words and numbers are all alike."""
    return F.regexp_replace(F.regexp_replace(text, r"\p{L}+", "w"), "[0-9]+", "n")


def volume(vocabulary: Column, length: Column) -> Column:
    return F.when(vocabulary > 0, length * F.log2(vocabulary.cast("double"))).otherwise(F.lit(0.0))


def difficulty(n1: Column, n2: Column, operands: Column) -> Column:
    return F.when(n2 > 0, n1 / F.lit(2.0) * (operands / n2)).otherwise(F.lit(0.0))


def terse_penalty(mean_tokens: Column, alpha: float) -> Column:
    return 1 + F.lit(alpha) * F.greatest(F.lit(0.0), 2 - mean_tokens)


def complexity_zone(ccx: Column) -> Column:
    return F.when(ccx <= 10, "simple").when(ccx <= 20, "moderate").when(ccx <= 50, "complex").otherwise("untestable")


def instability(ca: Column, ce: Column) -> Column:
    return F.try_divide(ce.cast("double"), ca + ce)


def abstractness(na: Column, nc: Column) -> Column:
    return F.try_divide(na.cast("double"), na + nc)


def package_zone(i: Column, a: Column, d: Column) -> Column:
    return (
        F.when(i.isNull() | a.isNull(), "unknown").when((i < 0.3) & (a < 0.3), "pain").when((i > 0.7) & (a > 0.7), "uselessness")
        .when(d >= 0.5, "warning").when(d < 0.2, "clean").otherwise("ok")
    )


def is_trivial_number(literal: Column) -> Column:
    """0, 1, -1 and 2 as integers; 0, 1, -1, 0.5, 2 and 100 as decimals."""
    bare = F.regexp_replace(F.regexp_replace(literal, "[_a-zA-Z]+$", ""), "_", "")
    # trailing letters go first, so 0x1F reads as 0x1
    hexed = F.conv(F.regexp_extract(bare, "^0[xX]([0-9a-fA-F]+)$", 1), 16, 10).try_cast("bigint")
    whole = F.when(bare.rlike("^0[xX][0-9a-fA-F]+$"), hexed).otherwise(F.when(~bare.rlike("^0+[1-9]"), bare.try_cast("bigint")))
    return _trivial(bare, whole)


def is_trivial_written(number: Column) -> Column:
    """The same values for digits in a text, where leading zeros make no decimal of a whole number: 0100 is 100."""
    return _trivial(number, number.try_cast("bigint"))


def _trivial(bare: Column, whole: Column) -> Column:
    return F.when(whole.isNotNull() & ~bare.contains("."), whole.isin(0, 1, -1, 2)).otherwise(F.coalesce(bare.try_cast("double").isin(0.0, 1.0, -1.0, 0.5, 2.0, 100.0), F.lit(False)))


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a glob whose ``*`` also crosses ``/``."""
    import re

    out = ""
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (j := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : j]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", r"\\") + "]"
            i = j
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def confidence(name: Column, dynamic: Column, common: Column) -> Column:
    """How sure it is that an unreferenced symbol is dead: low, medium or high."""
    size = F.length(name)
    score = 3 - F.when(size <= 4, 2).when(size <= 7, 1).otherwise(0) - F.when(common, 2).otherwise(0) - F.when(dynamic, 1).otherwise(0)
    return F.when(name.rlike("^__.*__$"), "low").when(score >= 3, "high").when(score >= 1, "medium").otherwise("low")
