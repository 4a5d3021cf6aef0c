"""Helpers shared by the corpus operators: staged tables, checked broadcasts, gapless ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Most rows of a side that may be broadcast, and most bytes of its files; a larger one is joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 16 << 20
_NO_ID = -(2**63)
#: The tables staged by the step that runs, if they are to go with it.
_OPEN: ContextVar[list[DataFrame] | None] = ContextVar("open", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a session without a cluster may do without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="moodweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _folder(spark: SparkSession, path: str):
    """A path and its file system, as the JVM's objects."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    Cuts the lineage, survives the loss of executors and computes what several later plans read
    just once. The files go with ``release``, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/moodweave/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, files = _folder(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    if (tables := _OPEN.get()) is not None:
        tables.append(out)
    return out


def stage_step(step: Callable[[], DataFrame]) -> DataFrame:
    """Stage what ``step`` returns; all that it has staged on the way is deleted then."""
    before = _OPEN.set(inner := [])
    try:
        made = step()
    finally:
        _OPEN.reset(before)
    out = stage(made)
    release(*inner)
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of staged tables that no later plan reads."""
    for t in tables:
        at, files = _folder(t.sparkSession, t.staged_at)
        files.delete(at, True)


def checked(small: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """A staged table marked for broadcast if its rows and the bytes of its files are within bounds, else for a merge join."""
    at, files = _folder(small.sparkSession, small.staged_at)
    fits = files.getContentSummary(at).getLength() <= size and small.count() <= rows
    return F.broadcast(small) if fits else small.hint("merge")


def id_key(col: Column) -> Column:
    """An id that can be a join key: null becomes the least long."""
    return F.coalesce(col.cast("long"), F.lit(_NO_ID))


def plain(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def row_key() -> list[Column]:
    """did and tid: ids may be null or shared, so a row is told by its id and the hash of its text."""
    return [id_key(F.col("doc_id")).alias("did"), F.xxhash64(plain(F.col("text"))).alias("tid")]


def count_words(text: Column) -> Column:
    """Number of words (runs of anything but space, tab, LF, VT, FF and CR); null has none."""
    return F.regexp_count(plain(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def unit_hash(seed: str, *cols: Column) -> Column:
    """A double in [0, 1) fixed by the seed and the columns; any SQL engine with md5 can repeat it."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / float(2**52)


def gapless(df: DataFrame, group: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, whatever the sizes of the groups.

    Rows are numbered within (group, input partition); counts of the partitions give the offsets.
    No task sees more of a group than one input partition holds.
    """
    rows = stage(df.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    keys = [*group, "_part"]
    ahead = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    inner = Window.partitionBy(*keys).orderBy("_at")
    numbered = rows.withColumn("_k", F.row_number().over(inner))
    return (
        numbered.join(starts, keys)
        .withColumn(name, (F.col("_start") + F.col("_k") - 1).cast("long"))
        .drop("_at", "_part", "_k", "_start")
    )


def slices(texts: list, chars: int = 1 << 20) -> list[slice]:
    """The texts of a batch in turn, of so many characters together at most (a longer one by itself)."""
    out, start, held = [], 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and held + n > chars:
            out.append(slice(start, i))
            start, held = i, 0
        held += n
    return [*out, slice(start, len(texts))] if len(texts) else []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
