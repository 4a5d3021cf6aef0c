"""Checks of files: where they are no UTF-8, and their sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import AffectError


class NotUtf8(AffectError):
    """A file holds bytes that are no UTF-8."""


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The bytes of each line (up to a line feed), its file and split, and a number that grows within a split."""
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value"
    )


def valid_bytes(text: Column) -> Column:
    """How many bytes of a text stand before the first that is no UTF-8.

    The repaired text is cut at its replacement characters; those that the text itself holds, and only those, are passed over.
    """
    parts = F.split(F.make_valid_utf8(text), "�", -1)
    raw = text.cast("binary")
    begin = F.struct(F.octet_length(parts[0]).alias("at"), F.lit(False).alias("over"))

    def pass_over(state: Column, part: Column) -> Column:
        own = ~state["over"] & (F.hex(F.substring(raw, state["at"] + 1, F.lit(3))) == "EFBFBD")
        return F.struct(F.when(own, state["at"] + 3 + F.octet_length(part)).otherwise(state["at"]).alias("at"), (~own).alias("over"))

    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), begin, pass_over, lambda s: s["at"])


def bad_bytes(spark: SparkSession, path: str) -> DataFrame:
    """file, n_lines and offset of each file that is no UTF-8: its lines that aren't, and where its first such byte stands (from 0).

    Splits are read by themselves, as no character goes over a line feed. Only bad files are read a second time, to count what stands
    before. A byte order mark at the beginning of a file isn't counted.
    """
    lines = _lines(spark, path)
    bad = lines.where(~F.is_valid_utf8("value"))
    first = F.min(F.struct("block", "n", valid_bytes(F.col("value")).alias("at"))).alias("f")
    files = bad.groupBy("file").agg(F.count("*").alias("n_lines"), first)
    before = (F.col("block") < F.col("f.block")) | ((F.col("block") == F.col("f.block")) & (F.col("n") < F.col("f.n")))
    size = F.when(before, F.octet_length("value") + 1).otherwise(0).cast("long")
    counted = lines.join(files, "file").groupBy("file").agg(F.first("n_lines").alias("n_lines"), (F.sum(size) + F.first("f.at")).alias("offset"))
    return counted


def check_utf8(spark: SparkSession, path: str) -> None:
    """``NotUtf8`` names the first bad file and offset, if there is one."""
    found = bad_bytes(spark, path).orderBy("file").limit(1).collect()
    if found:
        raise NotUtf8(f"{found[0]['file']}: no UTF-8 at byte {found[0]['offset']}")


def file_stats(spark: SparkSession, path: str) -> DataFrame:
    """file, size_bytes and n_lines of each file of a path; files without a line have none."""
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    counts = lines.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n_lines"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("size_bytes"))
    return files.join(counts, "file", "left").fillna(0, ["n_lines"])


def lexicon_file(spark: SparkSession, path: str, expected: tuple[str, ...] | None = None) -> dict:
    """All statistics of a finished lexicon in CSV with a header, and of its files; only bytes that are no UTF-8 are an error."""
    from ..operators import lexbuild
    from .sinks import fingerprint

    check_utf8(spark, path)
    rows = spark.read.option("header", True).csv(path)
    flags = [c for c in lexbuild.FLAGS if c in rows.columns]
    typed = rows.withColumns({c: F.col(c).try_cast("int") if c in flags else F.lit(None).cast("int") for c in lexbuild.FLAGS})
    wanted = list(expected or lexbuild.FINAL_FIELDS)
    diff = lexbuild.schema_diff(spark, wanted, rows.columns).first()
    stats = lexbuild.validation(typed, tuple(wanted))
    stats["schema"] = {"missing_fields": diff["missing"], "extra_fields": diff["extra"], "schema_valid": diff["valid"]}
    sizes = file_stats(spark, path).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes"), F.sum("n_lines").alias("n_lines")).first()
    return stats | {"utf8_valid": True, "file": {"path": path, "sha256": fingerprint(spark, path), "row_count": stats["duplicates"]["total_rows"], **sizes.asDict()}}
