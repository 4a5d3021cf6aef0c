"""Mixing sources to target weights.

Sizes are aggregated per source; a source's rate is its target over its size; a document is taken
``floor(rate)`` times, and once more if a hash of its id and text falls below the fraction of the rate.

Defined results: a null text has size 0; a null source is a source of its own, after all others; a
source without words has target 0 and takes nothing; every row draws for itself, whether its id is null, shared or its own: rows
equal in id, source and text are told by a number among them; an empty table gives an empty mix; columns beyond doc_id, text and source are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checked, count_words, gapless, plain, stage, unit_hash

SEED = "mix-1"
WEIGHTS = (3, 1, 2)
#: The sum of the targets, and the most of one source's target, as multiples of the sizes.
TOTAL, MOST = 1.5, 2.0


def _with_sums_before(rows: DataFrame, order: list[Column], *names: str) -> DataFrame:
    """``rows`` in an order, with a number ``_rank`` and, for each name, the sum over all earlier rows (``name_before``).

    Rows are sorted and summed in parts; only one row a part comes together, so no task holds all of them.
    """
    placed = stage(rows.orderBy(*order).withColumn("_rank", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_rank", 33))
    sums = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_{c}") for c in names])
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", *[F.coalesce(F.sum(f"_{c}").over(ahead), F.lit(0.0)).alias(f"_{c}") for c in names])
    inner = Window.partitionBy("_part").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    before = [(F.col(f"_{c}") + F.coalesce(F.sum(c).over(inner), F.lit(0.0))).alias(f"{c}_before") for c in names]
    return placed.join(starts, "_part").select(*rows.columns, "_rank", *before)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """Per source: size and target. ``sizes``: source, source_size, a row per source.

    Targets are ``min(most * size, level * weight)`` at the level where they sum to ``total`` times
    all sizes, which is where resharing what stands above a source's bound ends. Sources may be many: they
    are ranked in parts.
    """
    first = [F.col("source").isNotNull().desc(), F.col("source")]
    named = _with_sums_before(sizes.withColumn("_one", F.lit(1.0)), first, "_one")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_one_before").cast("long") % len(weights) + 1).cast("int"))
    ranked = named.select("source", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(most)).alias("cap"))
    ranked = _with_sums_before(ranked.withColumn("ratio", F.col("cap") / F.col("w")), [F.col("ratio"), *first], "cap", "w")
    ranked = stage(ranked)
    whole = ranked.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()  # two numbers
    if whole["size"] is None:
        return sizes.select("source", "source_size", F.lit(0.0).alias("target"))
    # If all sources before the row stand at their bounds, this is the level for the row and the rest.
    level = (F.lit(total * whole["size"]) - F.col("cap_before")) / (F.lit(whole["w"]) - F.col("w_before"))
    free = ranked.agg(F.min(F.when(F.col("ratio") >= level, F.struct("_rank", level.alias("level")))).alias("free")).first()["free"]
    bounded = F.col("cap") if free is None else F.least("cap", F.lit(free["level"]) * F.col("w"))
    return ranked.select("source", "source_size", bounded.cast("double").alias("target"))


def copies(rate: Column, draw: Column) -> Column:
    """``floor(rate)``, and one more with probability of the fraction."""
    whole = F.floor(rate)
    return (whole + F.when(draw < rate - whole, 1).otherwise(0)).cast("long")


def drawn(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` with a number in [0, 1) for each row, ``_draw``.

    A row draws by its id, the digest of its text and, among rows that are equal in id, source and text, its number;
    as such rows are alike, it doesn't matter which is which. Only they are numbered.
    """
    plain_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    keyed = docs.select("*", plain_id.alias("_id"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("_source"), F.md5(plain(F.col("text"))).alias("_text"))
    key = ["_id", "_source", "_text"]
    draw = lambda number: unit_hash(seed, F.col("_id"), F.col("_text"), number)
    counted = keyed.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1")
    repeated = stage(counted.drop("_n"))
    if repeated.isEmpty():
        return keyed.withColumn("_draw", draw(F.lit(0))).drop(*key)
    repeated = checked(repeated)
    single = keyed.join(repeated, key, "left_anti").withColumn("_draw", draw(F.lit(0)))
    numbered = gapless(keyed.join(repeated, key, "left_semi"), key, "_number").withColumn("_draw", draw(F.col("_number")))
    return single.drop(*key).unionByName(numbered.drop(*key, "_number"))


def plan(docs: DataFrame, seed: str = SEED, **law) -> DataFrame:
    """Each row of ``docs`` with size, source_size, target and n_copies, one row per input row."""
    per_source = docs.groupBy("source").agg(F.sum(count_words(F.col("text"))).cast("long").alias("source_size"))
    # A row per source: with few sources no text is shuffled, with very many Spark splits hot ones.
    law = stage(targets(stage(per_source), **law).withColumnRenamed("source", "_source"))
    sized = drawn(docs, seed).withColumn("size", count_words(F.col("text")))
    joined = sized.join(checked(law), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return joined.withColumn("n_copies", copies(rate, F.col("_draw"))).drop("_draw")


def mix(docs: DataFrame, seed: str = SEED, **law) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    # The whole row travels as one column, so that its names clash with none of the plan's.
    taken = plan(docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_row")), seed, **law).where("n_copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies")))).select("_row.*")


def digest(docs: DataFrame, seed: str = SEED) -> DataFrame:
    # The text is read twice but never shuffled: only counts per source are.
    return plan(docs.select("doc_id", "text", "source"), seed).select(
        "doc_id", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).cast("long").alias("taken")
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, '')) || ':'
           || (row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) - 1) AS name
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w
  FROM s
), l AS (
  SELECT *, cap / w AS ratio,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS rn
  FROM r
), t AS (
  SELECT source, source_size, least(cap, (SELECT arg_min(level, rn) FROM l WHERE ratio >= level) * w) AS target FROM l
), c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('mix-1:' || d.name), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM c
"""
