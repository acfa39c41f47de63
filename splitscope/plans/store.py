"""Stages on shared storage under content hashes: written whole, found by identity, repaired by what is missing.

Paths go through Spark's file system layer, so any store that Spark reads will do.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Sequence
from dataclasses import asdict, is_dataclass
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SPLIT


def plain(x: Any) -> Any:
    """Settings as JSON values: mappings by sorted key, sets sorted."""
    if is_dataclass(x) and not isinstance(x, type):
        return plain(asdict(x))
    if isinstance(x, dict):
        return {str(k): plain(x[k]) for k in sorted(x, key=str)}
    if isinstance(x, (set, frozenset)):
        return sorted((plain(v) for v in x), key=str)
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x if isinstance(x, (str, int, float, bool, type(None))) else str(x)


def content_hash(x: Any) -> str:
    return hashlib.sha256(json.dumps(plain(x), sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def stage_hash(name: str, upstream: str, settings: Any = None) -> str:
    """A stage's identity hangs on what it reads and on its own settings."""
    return content_hash({"stage": name, "upstream": upstream, "settings": settings})


class Appended:
    """A stored table that grows by appends.

    A writer first claims the next number by creating a file that nobody else can create, then writes a folder of that number, which counts once it
    is whole.  So writers at the same time never share a folder, a broken one leaves a number without rows, and a reader's paths are those of
    the moment it asked: later appends do not change what it reads."""

    def __init__(self, store: Store, path: str):
        self.store, self.path = store, path

    def parts(self) -> list[str]:
        """The whole parts, in the order of their numbers."""
        return [f"{self.path}/{n}" for n in self.store.names(self.path) if n.startswith("part=") and self.store.has(f"{self.path}/{n}")]

    def claim(self) -> int:
        """A number that no other writer has or will have."""
        taken = self.store.names(f"{self.path}/_claims")
        number = int(taken[-1]) + 1 if taken else 0
        while not self.store.create(f"{self.path}/_claims/{number:09d}"):
            number += 1
        return number

    def part(self, number: int) -> str:
        return f"{self.path}/part={number:09d}"

    def read(self, schema: str) -> DataFrame:
        """All rows so far; columns that older rows lack are NULL."""
        parts = self.parts()
        return self.store.spark.read.schema(schema).parquet(*parts) if parts else self.store.spark.createDataFrame([], schema)

    def append(self, rows: DataFrame, schema: str) -> int:
        """Add rows; a column ``attempt`` of the schema gets the number of the part, which is returned."""
        fields = self.store.spark.createDataFrame([], schema).schema.fields
        number = self.claim()
        column = lambda f: F.lit(number) if f.name == "attempt" else F.col(f"`{f.name}`")
        rows.select(*(column(f).cast(f.dataType).alias(f.name) for f in fields)).write.parquet(self.part(number))
        return number


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, stage: int, name: str, key: str, kind: str = "parquet") -> str:
        return f"{self.root}/stage{stage}_{name}/{key}.{kind}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def has(self, path: str) -> bool:
        """Whether a folder was written to its end."""
        fs, p = self._fs(f"{path}/_SUCCESS")
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        """What a folder holds, in order."""
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def create(self, path: str) -> bool:
        """Create an empty file; False if there is one.  Of several who try one succeeds."""
        fs, p = self._fs(path)
        fs.mkdirs(p.getParent())
        if fs.getScheme() == "file":  # Hadoop's local file system looks first and creates then, which two may do at once
            try:
                os.close(os.open(p.toUri().getPath(), os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                return False
            return True
        try:
            fs.create(p, False).close()
        except Py4JJavaError as e:
            if fs.exists(p):
                return False
            raise e
        return True

    def _newest(self, path: str) -> str | None:
        parts = Appended(self, path).parts()
        return parts[-1] if parts else None

    def write(self, df: DataFrame, stage: int, name: str, key: str) -> DataFrame:
        """Write a stage whole.  Of several that are written at the same time each is whole, and the last number counts."""
        table = self.table(stage, name, key)
        path = table.part(table.claim())
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, stage: int, name: str, key: str) -> DataFrame | None:
        path = self._newest(self.path(stage, name, key))
        return self.spark.read.parquet(path) if path else None

    def once(self, stage: int, name: str, key: str, build: Callable[[], DataFrame], enabled: bool = True) -> DataFrame:
        """The stored stage, built where it is missing."""
        if not enabled:
            return build()
        found = self.read(stage, name, key)
        return self.write(build(), stage, name, key) if found is None else found

    def table(self, stage: int, name: str, key: str, kind: str = "parquet") -> Appended:
        return Appended(self, self.path(stage, name, key, kind))

    def write_json(self, x: Any, stage: int, name: str, key: str) -> None:
        table = self.table(stage, name, key, "json")
        self.spark.createDataFrame([(json.dumps(plain(x), sort_keys=True),)], "value string").coalesce(1).write.text(table.part(table.claim()))

    def read_json(self, stage: int, name: str, key: str) -> Any:
        path = self._newest(self.path(stage, name, key, "json"))
        return json.loads("".join(r["value"] for r in self.spark.read.text(path).collect())) if path else None

    def invalidate(self, from_stage: int) -> list[str]:
        """Delete the folders of a stage and all later ones; returns what went."""
        fs, root = self._fs(self.root)
        gone = []
        if fs.exists(root):
            for s in fs.listStatus(root):
                name = s.getPath().getName()
                number = name.removeprefix("stage").split("_", 1)[0]
                if s.isDirectory() and name.startswith("stage") and number.isdigit() and int(number) >= from_stage:
                    fs.delete(s.getPath(), True)
                    gone.append(name)
        return sorted(gone)


# --- one row per split: identity, failures, repair ------------------------------------------------------------


def with_identity(table: DataFrame, settings: Any, problem_type: str | None = None) -> DataFrame:
    """Adds ``identity``: the hash of the settings and of the problem type."""
    return table.withColumn("identity", F.sha2(F.concat_ws("|", F.lit(content_hash(settings)), F.coalesce(F.col(problem_type).cast("string"), F.lit("")) if problem_type else F.lit("")), 256))


def failures(table: DataFrame) -> DataFrame:
    """``feature_set, reason, n``: how often each set failed."""
    return table.select(F.explode(F.from_json("failed_sets", "map<string,string>"))).groupBy(F.col("key").alias("feature_set"), F.col("value").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def patch_absent_categories(table: DataFrame, columns: Sequence[str] = ("mean_cat_cardinality", "max_cat_cardinality", "high_cardinality_fraction", "cat_cardinality_to_n_ratio", "cat_missing_fraction")) -> DataFrame:
    """Descriptors of categorical columns become 0 where a split has none."""
    return table.withColumns({c: F.when(F.col("n_cat_features") == 0, F.lit(0.0)).otherwise(F.col(c)) for c in columns if c in table.columns})


def export_handoff(tables: dict[str, DataFrame], root: str) -> DataFrame:
    """Write every table and a manifest of rows, columns and datasets; returns the manifest."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        back = spark.read.parquet(f"{root}/{name}")
        units = F.count_distinct("dataset") if "dataset" in back.columns else F.lit(None).cast("long")
        r = back.agg(F.count(F.lit(1)), units).first()
        rows.append((name, r[0], len(back.columns), r[1]))
    manifest = spark.createDataFrame(rows, "name string, rows long, columns int, datasets long")
    manifest.coalesce(1).write.mode("overwrite").json(f"{root}/_manifest")
    return manifest


def load_handoff(spark: SparkSession, root: str, name: str, required: bool = True) -> DataFrame | None:
    if not required and not Store(spark, root).has(f"{root}/{name}"):
        return None
    return spark.read.parquet(f"{root}/{name}")


def export_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).csv(path)
