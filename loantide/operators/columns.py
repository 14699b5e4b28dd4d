"""Choosing, naming and reshaping columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def clean_name(name: str) -> str:
    """snake_case form of a heading: ``File number(s)`` becomes ``file_number_s``."""
    text = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    text = text.replace("'", "").replace('"', "").replace("%", "_percent_").replace("#", "_number_")
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text)
    text = re.sub(r"[^A-Za-z0-9]+", "_", text).strip("_").lower()
    return f"x{text}" if not text or text[0].isdigit() else text


def clean_names(df: DataFrame) -> DataFrame:
    """Rename all columns to snake_case, numbering repeats ``_2``, ``_3``."""
    seen: dict[str, int] = {}
    names = []
    for name in map(clean_name, df.columns):
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def columns_containing(df: DataFrame, *needles: str) -> list[str]:
    """Columns whose name contains any needle, ignoring case, in table order."""
    needles = tuple(n.lower() for n in needles)
    return [c for c in df.columns if any(n in c.lower() for n in needles)]


def all_but(df: DataFrame, *names: str) -> list[str]:
    return [c for c in df.columns if c not in names]


def across(names: Iterable[str], fn: Callable[[Column], Column], name: str = "{col}") -> list[Column]:
    """One expression per column, named by the pattern."""
    return [fn(F.col(c)).alias(name.format(col=c)) for c in names]


def stack_by_name(*tables: DataFrame) -> DataFrame:
    """Union by column name; a column missing from one table is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def to_long(df: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """Wide to long: one row per key and column, as ``name`` and ``value``."""
    return df.unpivot(keys, columns or all_but(df, *keys), "name", "value")
