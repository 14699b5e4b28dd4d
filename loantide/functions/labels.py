"""Code labels, score bands and number formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .parsing import to_number


def code_label(c, labels: dict[int, str], missing: str | None = None) -> Column:
    """Label of a numeric code held as text.

    Text that is no number counts as missing; a number without a label gives NULL.
    """
    code = to_number(c)
    chain = F.when(code.isNull(), F.lit(missing))
    for value, label in labels.items():
        chain = chain.when(code == F.lit(float(value)), label)
    return chain


def text_label(c, labels: dict[str, str]) -> Column:
    """Label of a code compared as text; any other text gives NULL."""
    c = F.col(c) if isinstance(c, str) else c
    chain = None
    for value, label in labels.items():
        chain = F.when(c == F.lit(value), label) if chain is None else chain.when(c == F.lit(value), label)
    return chain


def band_index(c, low: float = 400, high: float = 900, width: float = 25) -> Column:
    """1-based equal-width band, open on the left and closed on the right; NULL outside."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when((c > low) & (c <= high), F.ceil((c - F.lit(low)) / F.lit(width)).cast("int"))


def band_label(index, low: int = 400, width: int = 25) -> Column:
    """``(400,425]`` style label of a band index."""
    index = F.col(index) if isinstance(index, str) else index
    upper = F.lit(low) + index * F.lit(width)
    return F.concat(
        F.lit("("), (upper - F.lit(width)).cast("string"), F.lit(","), upper.cast("string"), F.lit("]")
    )


def thousands(c, digits: int = 0) -> Column:
    """Number with thousands separators."""
    return F.format_number(c, digits)


def significant(c, digits: int = 7) -> Column:
    """Number with thousands separators, rounded to significant digits, no trailing zeros."""
    c = F.col(c) if isinstance(c, str) else c
    whole = F.when(c != 0, F.floor(F.log10(F.abs(c))) + 1).otherwise(1)
    decimals = F.greatest(F.lit(0), F.lit(digits) - whole).cast("int")
    text = F.call_function("format_number", c, decimals)
    trimmed = F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")
    return F.when(F.instr(text, ".") > 0, trimmed).otherwise(text)


def money_label(c, scale: float = 1e-3, prefix: str = "$", suffix: str = "", digits: int = 0) -> Column:
    """Scaled money label, such as ``$1,235k``; the sign goes before the prefix."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.concat(F.lit(prefix), F.format_number(F.abs(c) * F.lit(scale), digits), F.lit(suffix))
    return F.concat(F.when(c < 0, "-").otherwise(""), text)
