"""Runs of named steps with manifests: a broken run is resumed at the step that broke, and changed tables are made anew."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .sinks import AffectError, fingerprint


@dataclass(frozen=True)
class Step:
    """``make`` takes the tables of the steps in ``needs``, by name, and returns the step's table; ``sources`` are paths that it reads besides."""

    name: str
    make: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()


class StepFailed(AffectError):
    """A step raised an error; ``step`` names it and ``record`` tells what was done before."""

    def __init__(self, step: str, record: dict[str, str], reason: str) -> None:
        super().__init__(f"{step}: {reason}")
        self.step, self.record = step, record


def ordered(steps: list[Step]) -> list[Step]:
    """Steps after all that they need, else as given; ``ValueError`` for names that repeat, are unknown or need each other."""
    named = {s.name: s for s in steps}
    if len(named) < len(steps):
        raise ValueError("two steps have one name")
    if unknown := {n for s in steps for n in s.needs} - set(named):
        raise ValueError(f"unknown steps: {sorted(unknown)}")
    out: dict[str, Step] = {}
    while len(out) < len(steps):
        ready = next((s for s in steps if s.name not in out and all(n in out for n in s.needs)), None)
        if ready is None:
            raise ValueError(f"steps need each other: {sorted(set(named) - set(out))}")
        out[ready.name] = ready
    return list(out.values())


def digest(df: DataFrame) -> dict:
    """Schema, number of rows and two sums of row hashes: the same for the same rows in whatever order and files.

    Sums are combined before the shuffle; one row comes to the driver. Tables with map columns have no row hash.
    """
    sums = [F.sum(F.xxhash64(F.lit(salt), F.struct("*") if df.columns else F.lit(0)).cast("decimal(38,0)")).cast("string").alias(f"sum{salt}") for salt in (1, 2)]
    row = df.agg(F.count("*").alias("rows"), *sums).first()
    return {"schema": df.schema.json(), **row.asDict()}


def _manifest(spark: SparkSession, path: str) -> dict | None:
    at = f"{path}/manifest"
    return json.loads(spark.read.text(at).first()[0]) if store.complete(spark, at) else None


def _inputs(spark: SparkSession, root: str, step: Step) -> dict:
    """Digests of what a step reads: sources by content, earlier tables by the digest of their manifest."""
    made = {n: (_manifest(spark, f"{root}/{n}") or {}).get("output") for n in step.needs}
    return {"sources": {p: fingerprint(spark, p) for p in step.sources}, "needs": made}


def intact(spark: SparkSession, root: str, step: Step) -> bool:
    """Whether a step's table is there as a whole, holds the rows of its manifest, and comes from what its inputs are now."""
    path = f"{root}/{step.name}"
    found = _manifest(spark, path)
    if found is None or not store.complete(spark, f"{path}/data") or found["inputs"] != _inputs(spark, root, step):
        return False
    return digest(spark.read.parquet(f"{path}/data")) == found["output"]


def tables(spark: SparkSession, root: str, names) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{root}/{n}/data") for n in names}


def run(spark: SparkSession, root: str, steps: list[Step], resume: bool = True, only: str | None = None) -> dict[str, str]:
    """Make the tables of all steps under ``root``: step to "kept" or "made", in the order of the run.

    With ``resume`` a step is kept if it is ``intact``; else it is made anew, and so are those after it whose inputs then differ. ``only`` makes one step, of
    tables that have to be intact. The first error ends the run as ``StepFailed``; tables before it stay. Tables appear whole or not at all,
    and a table counts once its manifest is written, so a killed run goes on at the step that it was in.
    """
    plan = ordered(steps)
    if only is not None and only not in {s.name for s in plan}:
        raise ValueError(f"unknown step: {only}")
    record: dict[str, str] = {}
    for step in plan:
        if only is not None and step.name != only:
            continue
        path = f"{root}/{step.name}"
        try:
            if only is not None and (broken := [s.name for s in plan if s.name in step.needs and not intact(spark, root, s)]):
                raise AffectError(f"needs {', '.join(broken)}")
            if resume and intact(spark, root, step):
                record[step.name] = "kept"
                continue
            store.delete(spark, f"{path}/manifest")
            inputs = _inputs(spark, root, step)
            store.publish(step.make(**tables(spark, root, step.needs)), f"{path}/data")
            note = {"step": step.name, "inputs": inputs, "output": digest(spark.read.parquet(f"{path}/data"))}
            spark.createDataFrame([(json.dumps(note),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
        except Exception as error:
            raise StepFailed(step.name, record, str(error) or type(error).__name__) from error
        record[step.name] = "made"
    return record
