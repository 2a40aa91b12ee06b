"""Caches keyed by what a source holds: numeric tables of CSV files, and parsed specifications."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.operators.spec import Spec
from wayfare.sources.tables import read_spec

FORMAT = 1
#: Types that a numeric input may ask for.
NUMERIC = ("byte", "short", "int", "long", "float", "double", "boolean")
#: Parsed specifications that are kept.
KEPT = 256


def source_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file's bytes, or of the names and bytes of a folder's files; hashed where they are read, whatever their times say."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", F.sha2("content", 256).alias("sha"))
    rows = sorted((r["name"], r["length"], r["sha"]) for r in files.collect())
    if not rows:
        raise FileNotFoundError(path)
    return hashlib.sha256(json.dumps([r[1:] for r in rows] if len(rows) == 1 else rows).encode()).hexdigest()


def bits(df: DataFrame) -> dict:
    """Rows, schema and an order-free hash of all values; floating-point numbers by their text, which tells -0.0 from 0.0, as ``xxhash64`` does not."""
    values = [F.col(c).cast("string") if kind in ("float", "double") else F.col(c) for c, kind in sorted(df.dtypes)]
    row = df.select(F.xxhash64(*values).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.pmod("h", F.lit(1 << 31))).alias("s")).first()
    return {"rows": row["n"], "xor": row["x"] or 0, "sum": row["s"] or 0, "schema": [list(x) for x in df.dtypes]}


@dataclass
class NumericInputs:
    """Numeric CSV tables as Parquet in ``folder``, found again by the source's bytes, the types asked for and the reader's version.

    A table is never taken for another: any changed byte, type or version makes another key, and a cached table whose values no
    longer match what was recorded raises.  ``events`` tell of each read whether it was a hit.
    """

    spark: SparkSession
    folder: str
    events: list[dict] = field(default_factory=list)

    def identity(self, path: str, types: dict[str, str]) -> dict:
        bad = sorted(t for t in types.values() if t not in NUMERIC)
        if bad or not types:
            raise ValueError(f"types must be numeric, not {bad}")
        return {"format": FORMAT, "source": source_digest(self.spark, path), "types": sorted(types.items()), "reader": pyspark.__version__}

    def _place(self, identity: dict) -> str:
        return f"{self.folder.rstrip('/')}/{hashlib.sha256(json.dumps(identity).encode()).hexdigest()}"

    def _record(self, place: str) -> dict | None:
        held = self.spark._jvm.org.apache.hadoop.fs.Path(f"{place}/record/_SUCCESS")
        if not held.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(held):
            return None
        return json.loads(self.spark.read.text(f"{place}/record").first()[0])

    def parse(self, path: str, types: dict[str, str]) -> DataFrame:
        """The table as the file has it: the columns asked for, a value that is not of its type raises."""
        raw = self.spark.read.options(header=True, mode="FAILFAST").csv(path)
        missing = sorted(set(types) - set(raw.columns))
        if missing:
            raise ValueError(f"{path} has no columns {missing}")
        return raw.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()])

    def prepare(self, path: str, types: dict[str, str]) -> dict:
        """Writes a table that is not there yet, and its record once it reads back bit for bit and the source is still the same."""
        identity = self.identity(path, types)
        place = self._place(identity)
        if self._record(place) is not None:
            raise FileExistsError(f"{path} is prepared")
        fresh = self.parse(path, types)
        fresh.write.mode("overwrite").parquet(f"{place}/table")
        held = bits(self.spark.read.parquet(f"{place}/table"))
        if held != bits(fresh):
            raise ValueError(f"{path} does not read back as it was")
        if self.identity(path, types) != identity:
            raise ValueError(f"{path} has changed while it was prepared")
        record = {"identity": identity, "table": held}
        self.spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(f"{place}/record")
        return record

    def read(self, path: str, types: dict[str, str]) -> DataFrame:
        """The cached table of these bytes and types, checked, or the file itself where none is prepared."""
        identity = self.identity(path, types)
        place = self._place(identity)
        record = self._record(place)
        self.events.append({"path": path, "hit": record is not None})
        if record is None:
            return self.parse(path, types)
        table = self.spark.read.parquet(f"{place}/table")
        if record["identity"] != json.loads(json.dumps(identity)) or bits(table) != record["table"]:
            raise ValueError(f"the cached table of {path} has changed")
        return table

    @property
    def hits(self) -> int:
        return sum(e["hit"] for e in self.events)


@dataclass
class SpecificationFiles:
    """Specifications by the bytes of their files, which are read each time; parsed ones are immutable, so that all readers share them."""

    spark: SparkSession
    read: Callable[[SparkSession, str, str, str], Spec] = read_spec
    held: dict[tuple[str, ...], Spec] = field(default_factory=dict)
    hits: int = 0
    misses: int = 0

    def get(self, name: str, spec_path: str, coefficients_path: str) -> Spec:
        key = (name, *(f"{p}:{source_digest(self.spark, p)}" for p in (spec_path, coefficients_path)))
        if key in self.held:
            self.hits += 1
            return self.held[key]
        self.misses += 1
        found = self.read(self.spark, name, spec_path, coefficients_path)
        if len(self.held) >= KEPT:
            self.held.clear()
        self.held[key] = found
        return found
