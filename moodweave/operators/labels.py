"""Label harmonisation, codes and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.domains import FINE_LABELS, LABELS, PRIORITY_LABELS, ROMANIAN_LABELS, lookup


def fine_target(label: Column) -> Column:
    """The label that a fine label maps to, or null."""
    return lookup(FINE_LABELS, F.lower(label))


def bilingual_target(label: Column) -> Column:
    """The label that an English or else a Romanian name stands for, or null."""
    name = F.lower(F.trim(label))
    return F.coalesce(lookup({x: x for x in LABELS}, name), lookup(ROMANIAN_LABELS, name))


def first_fine(ids: Column) -> Column:
    """The target of the first id of a list of fine-label ids, or null."""
    names = F.array(*map(F.lit, FINE_LABELS))
    return F.when(F.try_element_at(ids, F.lit(1)) >= 0, fine_target(F.get(names, F.try_element_at(ids, F.lit(1)).cast("int"))))


def first_mappable(ids: Column) -> Column:
    """The target of the first id that has one."""
    names = F.array(*map(F.lit, FINE_LABELS))
    targets = F.transform(ids, lambda i: F.when(i >= 0, fine_target(F.get(names, i.cast("int")))))
    return F.get(F.filter(targets, lambda t: t.isNotNull()), F.lit(0))


def priority_label(flags: dict[str, Column], agreed: Column | None = None, *names: Column) -> Column:
    """The first true flag in the fixed priority, else the first 1 of ``agreed``, else the first name given."""
    order = F.array(*map(F.lit, PRIORITY_LABELS))
    found = F.coalesce(*[F.when(flags[p], F.lit(p)) for p in PRIORITY_LABELS if p in flags], F.lit(None).cast("string"))
    parts = [found]
    if agreed is not None:
        at = F.array_position(agreed, F.lit(1)).cast("int")
        parts.append(F.when(at > 0, F.get(order, at - 1)))
    return F.coalesce(*parts, *[F.nullif(n, F.lit("")) for n in names])


def usable(corpus: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Rows whose text and label are neither null nor blank."""
    return corpus.where((F.trim(text) != "") & (F.trim(label) != ""))


def label_index(corpus: DataFrame, label: str = "label") -> DataFrame:
    """label and code: distinct labels in ascending order, from 0. One row per label, so one small sort."""
    found = corpus.select(F.col(label).alias("label")).where(F.col(label).isNotNull()).distinct()
    return found.withColumn("code", (F.row_number().over(Window.orderBy("label")) - 1).cast("int"))


def class_weights(corpus: DataFrame, label: str = "label") -> DataFrame:
    """label, n and the balanced weight: all rows over (classes times rows of the class)."""
    counts = corpus.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))
    weight = F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))
    return counts.select("label", "n", weight.alias("weight"))


def common_labels(available: DataFrame, target: DataFrame) -> DataFrame:
    return available.select("label").intersect(target.select("label"))
