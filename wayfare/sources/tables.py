"""Readers and writers: specification files, matrix artifacts, checkpoints and trip matrices."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.operators.spec import Spec, resolved


def read_spec(spark: SparkSession, name: str, spec_path: str, coefficients_path: str) -> Spec:
    """A specification and its coefficients from CSV files, which are small: S1, S7."""
    options = {"header": True, "comment": "#", "escape": '"', "mode": "FAILFAST"}
    rows = [r.asDict() for r in spark.read.options(**options).csv(spec_path).collect()]
    held = spark.read.options(**options).csv(coefficients_path)
    values = {r["coefficient_name"]: float(r["value"]) for r in held.select("coefficient_name", "value").collect()}
    return resolved(rows, values, name)


def fingerprint(df: DataFrame) -> dict:
    """Rows, schema and an order-free hash of all values."""
    held = df.select(F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).alias("h"))
    row = held.agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.pmod("h", F.lit(1 << 31))).alias("s")).first()
    return {"rows": row["n"], "xor": row["x"] or 0, "sum": row["s"] or 0, "schema": df.schema.jsonValue()}


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(f"{path}/_manifest_json")


def write_artifact(df: DataFrame, path: str, metadata: dict | None = None) -> dict:
    """An immutable Parquet artifact with a manifest; an existing one is never overwritten."""
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(f"{path}/data")
    manifest = {"table": fingerprint(spark.read.parquet(f"{path}/data")), "metadata": metadata or {}}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/_manifest_json")
    return manifest


def read_artifact(spark: SparkSession, path: str, columns: list[str] | None = None, verify: bool = True) -> DataFrame:
    """An artifact's table, checked against its manifest; only ``columns`` are scanned later."""
    manifest = json.loads(_manifest(spark, path).first()[0])
    df = spark.read.parquet(f"{path}/data")
    if verify and fingerprint(df) != manifest["table"]:
        raise ValueError(f"{path} does not match its manifest")
    return df.select(*columns) if columns else df


def write_cube(cube: DataFrame, path: str, keys: list[str]) -> dict:
    """Matrices of one cube (orig, dest[, period] and a column for each) with a fingerprint of each in the manifest."""
    spark = cube.sparkSession
    cube.write.mode("errorifexists").parquet(f"{path}/data")
    held = spark.read.parquet(f"{path}/data")
    places = [c for c in held.columns if c not in keys]
    manifest = {"matrices": {k: fingerprint(held.select(*places, k)) for k in keys}, "metadata": {"places": places}}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/_manifest_json")
    return manifest


def read_cube(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The matrices ``keys`` of a cube: only their columns are scanned, and each is checked against its own fingerprint."""
    manifest = json.loads(_manifest(spark, path).first()[0])
    held = spark.read.parquet(f"{path}/data")
    places = manifest["metadata"]["places"]
    for key in keys:
        if fingerprint(held.select(*places, key)) != manifest["matrices"].get(key):
            raise ValueError(f"{key} in {path} does not match its manifest")
    return held.select(*places, *keys)


def artifact_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(_manifest(spark, path).first()[0])["metadata"]


def matrix_cells(trips: DataFrame, fields: dict[str, list[str]], weight: str | None = None) -> DataFrame:
    """(matrix, orig, dest, value): trips over the expansion weight summed by cell, cells without trips left out."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    values = [F.struct(F.lit(m).alias("matrix"), (sum((F.col(n).cast("double") for n in names), F.lit(0.0)) / w).alias("value")) for m, names in fields.items()]
    each = trips.select("orig", "dest", F.inline(F.array(*values)))
    return each.groupBy("matrix", "orig", "dest").agg(F.sum("value").alias("value")).where("value <> 0")


def write_matrices(trips: DataFrame, fields: dict[str, list[str]], path: str, weight: str | None = None) -> None:
    """Trip matrices in sparse long form, one partition each; trips are read once, however many matrices."""
    matrix_cells(trips, fields, weight).write.mode("errorifexists").partitionBy("matrix").parquet(path)


def dense_matrix(cells: DataFrame, zones: list[int]) -> DataFrame:
    """One matrix with a column for each destination zone."""
    return cells.groupBy("orig").pivot("dest", zones).agg(F.sum("value")).na.fill(0.0)
