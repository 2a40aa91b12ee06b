"""Dense cubes beside NumPy arrays and the long form."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.operators import skims
from wayfare.plans.session import workspace
from wayfare.sources import cubes

PERIODS = ("AM", "MD", "PM")
ZONES = [3, 7, 8, 20, 41]


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("matrices")
    rng = np.random.default_rng(8)
    held = {name: rng.uniform(0, 90, (5, 5)) for name in ["DIST", "BIKE", *[f"TIME__{p}" for p in PERIODS]]}
    for name, x in held.items():
        np.save(folder / f"{name}.npy", x)
    np.save(folder / "BROKEN.npy", np.zeros((5, 4)))
    np.save(folder / "SMALL.npy", np.zeros((4, 4)))
    return str(folder), held


def zones_of(spark):
    return cubes.zone_map(spark.createDataFrame([(z,) for z in reversed(ZONES)], "zone long"))


def test_reads_by_position(spark, files):
    folder, held = files
    cube = cubes.load_cube(cubes.matrix_files(spark, folder, ["DIST", *[f"TIME__{p}" for p in PERIODS]]), zones_of(spark), {"DIST": 2, "TIME": 3}, 400, PERIODS)
    assert cube.bytes == 4 * 25 * 4 and cube.count == 5
    rng = np.random.default_rng(9)
    trips = [(i, int(rng.choice([*ZONES, -1])), int(rng.choice([*ZONES, -1])), int(rng.integers(3))) for i in range(200)]
    rows = spark.createDataFrame(trips, "i int, a long, b long, p int")
    reads = {"there": ("DIST", "a", "b", None), "back": ("DIST", "b", "a", None), "time": ("TIME", "a", "b", "p"), "time_back": ("TIME", "b", "a", "p")}
    found = cube.lookup(rows, reads)
    at = {z: k for k, z in enumerate(ZONES)}

    def want(name, a, b):
        return math.nan if -1 in (a, b) else float(np.float32(held[name][at[a], at[b]]))

    for r in found.collect():
        got = [r.there, r.back, r.time, r.time_back]
        wanted = [want("DIST", r.a, r.b), want("DIST", r.b, r.a), want(f"TIME__{PERIODS[r.p]}", r.a, r.b), want(f"TIME__{PERIODS[r.p]}", r.b, r.a)]
        assert all(x == y or (math.isnan(x) and math.isnan(y)) for x, y in zip(got, wanted, strict=True))
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("BroadcastHashJoin") == 4 and "SortMergeJoin" not in plan


def test_equals_the_long_form(spark):
    zones = zones_of(spark)
    rng = np.random.default_rng(10)
    cells = [(a, b, p, float(np.float32(rng.uniform(0, 9))), float(np.float32(rng.uniform(0, 9)))) for a in ZONES for b in ZONES for p in range(3)]
    table = spark.createDataFrame(cells, "orig long, dest long, period int, DIST double, TIME double")
    cube = cubes.load_cube(cubes.long_blocks(table, zones, ["DIST", "TIME"], "period", PERIODS), zones, {"DIST": 3, "TIME": 3}, 1000, PERIODS)
    rows = spark.createDataFrame([(i, ZONES[i % 5], ZONES[i // 5 % 5], i % 3) for i in range(75)], "i int, o long, d long, p int")
    dense = cube.lookup(rows, {"DIST": ("DIST", "o", "d", "p"), "TIME": ("TIME", "o", "d", "p")})
    assert sorted(dense.collect()) == sorted(skims.lookup(rows, table, ["DIST", "TIME"], "o", "d", "p").collect())
    with pytest.raises(ValueError, match="full square"):
        cubes.load_cube(cubes.long_blocks(table.where("not (orig = 3 and dest = 7)"), zones, ["TIME"], "period", PERIODS), zones, {"TIME": 3}, 1000, PERIODS)


def test_refuses(spark, files):
    folder, _ = files
    blocks, zones = cubes.matrix_files(spark, folder, ["DIST", "SMALL", "TIME__AM"]), zones_of(spark)
    with pytest.raises(MemoryError, match="200 bytes of 199"):
        cubes.load_cube(blocks, zones, {"DIST": 2, "BIKE": 2}, 199)
    with pytest.raises(KeyError, match="BIKE"):
        cubes.load_cube(blocks, zones, {"DIST": 2, "BIKE": 2}, 1000)
    with pytest.raises(KeyError, match="TIME__MD"):
        cubes.load_cube(blocks, zones, {"TIME": 3}, 1000, PERIODS)
    with pytest.raises(ValueError, match="full square"):
        cubes.load_cube(blocks, zones, {"SMALL": 2}, 1000)
    with pytest.raises(Exception, match="not square"):
        cubes.matrix_files(spark, folder, ["BROKEN"]).collect()
    with pytest.raises(ValueError, match="each once"):
        cubes.zone_map(spark.createDataFrame([(1,), (1,)], "zone long"))
    cube = cubes.load_cube(blocks, zones, {"DIST": 2}, 1000)
    rows = spark.createDataFrame([(3, 7, 0)], "a long, b long, p int")
    with pytest.raises(ValueError, match="rank"):
        cube.lookup(rows, {"x": ("DIST", "a", "b", "p")})
    with pytest.raises(KeyError, match="not loaded"):
        cube.lookup(rows, {"x": ("BIKE", "a", "b", None)})
    for bad in (99, None):
        with pytest.raises(Exception, match="no zone"):
            cube.lookup(rows.withColumn("a", F.lit(bad).cast("long")), {"x": ("DIST", "a", "b", None)}).collect()
    assert cube.lookup(rows.where("a < 0"), {"x": ("DIST", "a", "b", None)}).count() == 0


def test_only_the_matrices_asked_for_are_opened(spark, files):
    folder, _ = files
    zones = zones_of(spark)
    place = workspace(spark, "blocks")
    cubes.matrix_files(spark, folder, ["DIST", "BIKE"]).write.partitionBy("matrix").parquet(place)
    cube = cubes.load_cube(spark.read.parquet(place), zones, {"DIST": 2}, 1000)
    filters = cube.rows._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "DIST" in filters and "BIKE" not in filters and cube.rows.count() == 5
