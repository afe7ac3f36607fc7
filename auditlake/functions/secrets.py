"""Expressions about secret values: entropy and masking."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy(value: Column) -> Column:
    """Shannon entropy in bits per character, 0 for the empty string.

    The sum runs over sorted distinct characters and is rounded to nine places, so the
    last bit does not depend on an iteration order.
    """
    n = F.length(value).cast("double")
    chars = F.array_sort(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != "")))
    total = F.aggregate(
        chars,
        F.lit(0.0),
        lambda acc, c: acc
        - ((n - F.length(F.replace(value, c, F.lit("")))) / n)
        * F.log2((n - F.length(F.replace(value, c, F.lit("")))) / n),
    )
    return F.when(F.length(value) == 0, F.lit(0.0)).otherwise(F.round(total, 9))


def _keep_prefix(value: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.repeat(F.lit("*"), F.length(value) - len(prefix)))


def mask_secret(value: Column, provider: Column) -> Column:
    """Hide a secret but keep its length and the recognisable provider prefix."""
    masked = F.when(F.length(value) <= 8, F.lit("********"))
    for name, prefix in [
        ("github", "ghp_"),
        ("openai", "sk-proj-"),
        ("openai", "sk-"),
        ("anthropic", "sk-ant-sid01-"),
    ]:
        masked = masked.when(
            (provider == name) & F.startswith(value, F.lit(prefix)), _keep_prefix(value, prefix)
        )
    return masked.otherwise(
        F.concat(
            F.substring(value, 1, 4),
            F.repeat(F.lit("*"), F.length(value) - 8),
            F.right(value, F.lit(4)),
        )
    )
