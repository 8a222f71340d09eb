"""Evaluation measures as aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from mnemoframe.operators.relational import ratio


def confusion(df: DataFrame, gold: str, predicted: str, *by: str) -> DataFrame:
    """tp, fp, fn and support per class and group: each row counts once for its gold and once for its predicted class."""
    sides = F.explode(F.array(F.struct(F.col(gold).alias("label"), F.lit(1).alias("is_gold")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("is_gold"))))
    long = df.select(*by, (F.col(gold) == F.col(predicted)).alias("same"), sides.alias("s")).select(*by, "same", "s.*").where(F.col("label").isNotNull())
    same = F.coalesce("same", F.lit(False))
    return long.groupBy(*by, "label").agg(F.count_if(same & (F.col("is_gold") == 1)).alias("tp"), F.count_if(~same & (F.col("is_gold") == 0)).alias("fp"), F.count_if(~same & (F.col("is_gold") == 1)).alias("fn"))


def prf(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 = 2tp / (2tp + fp + fn), null on zero denominators."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def strict_f1(precision: Column, recall: Column) -> Column:
    """The harmonic mean; null, not zero, where both are zero."""
    return F.when(precision + recall > 0, F.bround(2 * precision * recall / (precision + recall), 6))


def nearest_rank(df: DataFrame, value: str, *by: str) -> DataFrame:
    """p50, p95 and p99 by nearest rank."""
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")
    return df.groupBy(*by).agg(F.count("*").alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


def key_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Keys that are missing from or unexpected in the actual rows."""
    return reduce(DataFrame.unionByName, (expected.exceptAll(actual).withColumn("problem", F.lit("missing")), actual.exceptAll(expected).withColumn("problem", F.lit("unexpected"))))


def expansion(left: DataFrame, right: DataFrame, repetitions: int) -> DataFrame:
    """Every combination of two key sets and a repetition number; the right one is held by every task, so it may have 1,000 rows at most."""
    if (n := right.count()) > 1000:
        raise ValueError(f"{n} rows on the right, more than 1000")
    return left.join(F.broadcast(right), F.lit(True)).withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(repetitions))))


def payload_bytes(df: DataFrame, relation: str) -> DataFrame:
    """Rows and bytes of a relation's rows as JSON."""
    return df.agg(F.lit(relation).alias("relation"), F.count("*").alias("n_rows"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0)).alias("n_bytes"))


def text_bytes(df: DataFrame, relation: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows and bytes of the text columns of a relation."""
    size = reduce(Column.__add__, (F.coalesce(F.octet_length(c), F.lit(0)) for c in columns))
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(size), F.lit(0)).alias("n_bytes")).select(F.lit(relation).alias("relation"), "n_rows", "n_bytes")


def evidence_scores(gold: Column, ranked: Column, selected: Column, forbidden: Column) -> list[Column]:
    """Measures of one query from its id sets, ``ranked`` in order; a stage is the first at which a gold id is lost."""
    found, chosen = F.size(F.array_intersect(gold, ranked)), F.size(F.array_intersect(gold, selected))
    places = F.filter(F.transform(gold, lambda g: F.array_position(ranked, g)), lambda p: p > 0)
    complete, kept = F.size(F.array_except(gold, ranked)) == 0, F.size(F.array_except(gold, selected)) == 0
    return [
        (found > 0).alias("hit"), complete.alias("complete"), F.coalesce(1 / F.array_min(places), F.lit(0.0)).alias("reciprocal_rank"), ratio(found, F.size(gold)).alias("recall"), F.coalesce(ratio(found, F.size(ranked)), F.lit(0.0)).alias("precision"),
        kept.alias("selected_complete"), chosen.alias("selected_relevant"), F.size(selected).alias("selected_total"), (F.size(forbidden) > 0).alias("forbidden_labeled"), F.arrays_overlap(forbidden, selected).alias("forbidden_exposure"),
        F.when(~complete, "retrieval").when(~kept, "context").otherwise("none").alias("failure_stage"),
    ]


def answer_fits(kind: Column, acceptable: Column, items: Column) -> Column:
    """ABSTAIN wants no item, SET exactly the acceptable ones, TEXT a single one of them."""
    among = F.size(F.array_except(items, acceptable)) == 0
    return F.when(kind == "ABSTAIN", F.size(items) == 0).when(kind == "SET", among & (F.size(F.array_except(acceptable, items)) == 0)).otherwise((F.size(items) == 1) & among)


def leaks(forbidden: Column, items: Column) -> Column:
    """Whether a forbidden text stands within an item, whatever the case."""
    return F.exists(forbidden, lambda b: F.exists(items, lambda i: F.contains(F.lower(i), F.lower(b))))


def storage(observations: DataFrame, by: str, components: dict[str, str]) -> DataFrame:
    """Totals, means and component sums of a group's observations, null unless all of them are complete."""
    whole = F.bool_and("complete")
    only = lambda c: F.when(whole, c)
    total = reduce(Column.__add__, (F.sum(c) for c in components.values()))
    return observations.groupBy(by).agg(
        F.count("*").alias("observations"), whole.alias("complete"), only(total).alias("total_bytes"), only(F.bround(total / F.count("*"), 3)).alias("mean_bytes"), *(only(F.sum(c)).alias(name) for name, c in components.items())
    )


def usage(kinds: list[DataFrame], by: str) -> DataFrame:
    """Sums of input (i), output (o) and embedding (e) tokens and of calls over several kinds of rows; each kind is summed first."""
    parts = [df.groupBy(by).agg(*(F.sum(c).alias(c) for c in "ioe"), F.count("*").alias("calls"), F.bool_and("done").alias("done")) for df in kinds]
    return reduce(DataFrame.unionByName, parts).groupBy(by).agg(
        F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"), F.sum("e").alias("embedding_tokens"), F.sum("calls").alias("model_calls"), F.bool_and("done").alias("complete")
    )
