"""Normalised arguments: comma lists, token lengths, positions, dotted keys, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def listed(c: Column) -> Column:
    """Trimmed items of a comma-separated list, without empty ones."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def token_length(item: Column) -> Column:
    """8K, 8_192 or 8192 as a number of tokens; null if it is none or not positive."""
    text = F.replace(F.lower(F.trim(item)), F.lit("_"), F.lit(""))
    k = F.endswith(text, F.lit("k"))
    n = F.when(k, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text).try_cast("bigint") * F.when(k, 1024).otherwise(1)
    return F.when(n > 0, n)


def position(item: Column) -> Column:
    """A share of a text: what is above 1 is a percentage; null if it is none or outside 0..1."""
    p = F.trim(item).try_cast("double")
    share = F.when(p > 1, p / 100).otherwise(p)
    return F.when((share >= 0) & (share <= 1), share)


def list_problems(rows: DataFrame, key: str, text: str, item, unique: bool = False) -> DataFrame:
    """Violations (rule, key) of argument lists: empty ones, items that are none, and where asked items that repeat."""
    from ..operators.audits import violations

    items = F.transform(listed(F.col(text)), item)
    rules = {"not_empty": F.size(items) > 0, "valid_items": F.forall(items, lambda x: x.isNotNull())}
    if unique:
        rules["unique_items"] = F.size(F.array_distinct(F.array_compact(items))) == F.size(F.array_compact(items))
    return violations(rows, key, **rules)


def dotted(name: str) -> Column:
    """The trimmed text of a field by its dotted path; a blank one is null."""
    return F.nullif(F.trim(F.col(name).cast("string")), F.lit(""))


def blank_keys(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Violations: rows whose field by a dotted path is missing or blank."""
    from ..operators.audits import violations

    return violations(rows, key, key_present=dotted(name).isNotNull())
