"""Constraints of the data model as one pass per table that counts violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def violations(df: DataFrame, relation: str, rules: dict[str, Column]) -> DataFrame:
    """Rows (relation, rule, n) of the rules that some rows break; a rule that is null for a row holds."""
    counts = df.agg(*(F.count_if(~F.coalesce(c, F.lit(True))).alias(n) for n, c in rules.items()))
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("n")) for n in rules)))
    return counts.select(pairs.alias("v")).select(F.lit(relation).alias("relation"), "v.rule", "v.n").where("n > 0")


def many(parts: dict[str, tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    return reduce(DataFrame.unionByName, (violations(df, name, rules) for name, (df, rules) in parts.items()))
