"""Store of computed steps, addressed by what they are computed from.

The address is a digest of the input files (path, size, modification time), of
the package's code and of the step's name.  A step is written once and every
flow over the same files reads it, within a session and, with a root of the
caller's, between sessions; a changed file or changed code gives another
address.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import lru_cache, reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tributary.sources.files import checkpoint_folder, materialized

PACKAGE = Path(__file__).resolve().parents[1]
#: Parts of the package whose code decides a step's rows.
CODE = ("config.py", "functions", "operators", "sources")


@lru_cache(maxsize=1)
def code_digest() -> str:
    digest = hashlib.sha256()
    for part in CODE:
        for f in sorted([PACKAGE / part] if part.endswith(".py") else (PACKAGE / part).glob("*.py")):
            digest.update(f.name.encode() + b"\0" + f.read_bytes())
    return digest.hexdigest()


def input_digest(spark: SparkSession, *paths: str) -> str:
    """Digest of the files that Spark reads below the paths; only their metadata is scanned."""
    meta = [spark.read.parquet(p).select(*[F.col(f"_metadata.file_{c}").alias(c) for c in ("path", "size", "modification_time")]) for p in paths]
    found = reduce(DataFrame.unionAll, meta).distinct()
    total = found.agg(F.count("*"), F.sum(F.xxhash64("path", "size", "modification_time").cast("decimal(38,0)"))).first()
    return hashlib.sha256(repr((sorted(paths), tuple(total))).encode()).hexdigest()


class StepStore:
    """Steps over one set of inputs.  ``root`` defaults to a folder of the session's checkpoint folder."""

    def __init__(self, spark: SparkSession, *inputs: str, root: str | None = None):
        self.spark, self.root = spark, root or f"{checkpoint_folder(spark)}/steps"
        self.digest = hashlib.sha256((input_digest(spark, *inputs) + code_digest()).encode()).hexdigest()[:32]

    def _finished(self, folder: str) -> str | None:
        """A complete writing of the step; what a stopped job left has no mark of success."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(path):
            return None
        tried = sorted(s.getPath().toString() for s in store.listStatus(path))
        return next((t for t in tried if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{t}/_SUCCESS"))), None)

    def step(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The step's table, built and written if no flow has done so.

        Two flows that build it at once write two copies with equal rows.
        """
        folder = f"{self.root}/{name}-{self.digest}"
        done = self._finished(folder)
        if done is None:
            done = f"{folder}/{uuid.uuid4().hex}"
            build().write.parquet(done)
        return self.spark.read.parquet(done)


def counted(df: DataFrame, **counters: Column) -> tuple[DataFrame, dict]:
    """``df`` written once, and its counters (aggregates by name) taken while it was written: no second scan."""
    seen = Observation()
    table = materialized(df.observe(seen, *[c.alias(n) for n, c in counters.items()]))
    return table, seen.get


class Counters:
    """Running counters of a session's work: steps add theirs as they are written, snapshots give the change since another."""

    def __init__(self):
        self.values: dict[str, int] = {}

    def add(self, found: dict) -> None:
        for name, value in found.items():
            self.values[name] = self.values.get(name, 0) + (value or 0)

    def write(self, df: DataFrame, **counters: Column) -> DataFrame:
        table, found = counted(df, **counters)
        self.add(found)
        return table

    def snapshot(self) -> dict[str, int]:
        return dict(self.values)

    def since(self, before: dict[str, int]) -> dict[str, int]:
        return {name: value - before.get(name, 0) for name, value in self.values.items()}
