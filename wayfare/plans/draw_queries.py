"""Registered queries of Mersenne Twister draws, with the generator as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions.rng import Ledger, row_seed, seeded_normals, seeded_uniforms
from wayfare.functions.twister import AHEAD, BACK, MATRIX, SEEDING, TEMPER_B, TEMPER_C, WORDS
from wayfare.operators.draws import DrawService
from wayfare.plans.choice_queries import rounded, table
from wayfare.plans.component_queries import HASH32
from wayfare.plans.session import workspace


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _turned(source: str, high: str, low: str) -> str:
    return f"xor(xor({source}, (({high} & 2147483648) | ({low} & 2147483647)) >> 1), ({low} & 1) * {int(MATRIX)})"


def twister_sql(seeds: str, turns: int) -> str:
    """Tables after ``seeds`` (id, seed), the last of which is u (id, u): the uniforms of the first ``turns`` states."""

    def stretch(a: int, b: int, source: str, back: int) -> str:
        return f"list_transform(range({a}, {b}), lambda i: {_turned(f'{source}[i + 1 + {back}]', 'w[i + 1]', 'w[i + 2]')})"

    out = [
        f"m(id, j, x) AS (SELECT id, 0, seed::BIGINT FROM {seeds} UNION ALL SELECT id, j + 1, ({int(SEEDING)} * xor(x, x >> 30) + j + 1) & 4294967295 FROM m WHERE j < {WORDS - 1})",
        "w0 AS (SELECT id, list(x ORDER BY j) AS w FROM m GROUP BY id)",
    ]
    for t in range(1, turns + 1):
        out += [
            f"a{t} AS (SELECT *, {stretch(0, BACK, 'w', AHEAD)} AS a FROM w{t - 1})",
            f"b{t} AS (SELECT *, {stretch(BACK, 2 * BACK, 'a', -BACK)} AS b FROM a{t})",
            f"c{t} AS (SELECT *, {stretch(2 * BACK, WORDS - 1, 'b', -2 * BACK)} AS c FROM b{t})",
            f"w{t} AS (SELECT id, list_concat(a, b, c, [{_turned(f'b[{AHEAD - BACK}]', f'w[{WORDS}]', 'a[1]')}]) AS w FROM c{t})",
        ]
    joined = "w1.w" if turns == 1 else f"list_concat({', '.join(f'w{t}.w' for t in range(1, turns + 1))})"
    tempered = joined
    for step in ("x >> 11", f"(x << 7) & {int(TEMPER_B)}", f"(x << 15) & {int(TEMPER_C)}", "x >> 18"):
        tempered = f"list_transform({tempered}, lambda x: xor(x, {step}))"
    out += [
        f"o AS (SELECT w1.id, {tempered} AS o FROM w1 {' '.join(f'JOIN w{t} ON w{t}.id = w1.id' for t in range(2, turns + 1))})",
        f"u AS (SELECT id, list_transform(range(0, {turns * WORDS // 2}), lambda k: ((o[2 * k + 1] >> 5) * 67108864.0::DOUBLE + (o[2 * k + 2] >> 6)) / 9007199254740992.0::DOUBLE) AS u FROM o)",
    ]
    return ", ".join(out)


def normal_sql(offset: str) -> str:
    """The first normal after ``offset`` uniforms of a list u."""
    pairs = f"list_transform(range(0, 60), lambda k: {{'x': 2 * u[{offset} + 2 * k + 1] - 1, 'y': 2 * u[{offset} + 2 * k + 2] - 1}})"
    first = f"list_filter({pairs}, lambda p: p.x * p.x + p.y * p.y < 1 AND p.x * p.x + p.y * p.y <> 0)[1]"
    return f"list_transform([{first}], lambda p: sqrt(-2.0::DOUBLE * ln(p.x * p.x + p.y * p.y) / (p.x * p.x + p.y * p.y)) * p.y)[1]"


def seed_sql(entity: str, base: int, channel: str, step: str) -> str:
    return f"({entity} + {base} + {HASH32.format(x=channel)} + {HASH32.format(x=step)}) % 4294967296"


@query(
    f"""WITH RECURSIVE s AS (SELECT c_custkey AS id, {seed_sql("c_custkey", 0, "persons", "auto_ownership")} AS seed FROM customer), {twister_sql("s", 2)}
    SELECT id AS c_custkey, u[id % 400 + 1] AS draw_1, u[id % 400 + 2] AS draw_2, u[id % 400 + 3] AS draw_3 FROM u"""
)
def seeded_draws(spark: SparkSession, folder: str) -> DataFrame:
    """Three draws of each customer after skipping up to 399, some over the end of the first state."""
    rows = table(spark, folder, "customer").select("c_custkey")
    seed = row_seed(F.col("c_custkey"), 0, "persons", "auto_ownership")
    held = rows.select("c_custkey", seeded_uniforms(seed, F.col("c_custkey") % 400, 3).alias("u"))
    return held.select("c_custkey", *[F.get("u", F.lit(i)).alias(f"draw_{i + 1}") for i in range(3)])


@query(
    f"""WITH RECURSIVE s AS (SELECT c_custkey AS id, {seed_sql("c_custkey", 5, "persons", "step")} AS seed FROM customer), {twister_sql("s", 1)},
    h AS (SELECT u.*, 2 + (id IN (SELECT o_custkey FROM orders))::INT AS offset FROM u)
    SELECT id AS c_custkey, u[1] AS first_1, u[2] AS first_2, CASE WHEN h.offset = 3 THEN u[3] END AS more, h.offset AS rng_offset, round({normal_sql("h.offset")}, 9) + 0.0 AS normal FROM h"""
)
def ledger_draws(spark: SparkSession, folder: str) -> DataFrame:
    """Two reservations of a ledger, the second for some entities only, and a normal from where each stands."""
    ledger = Ledger.start(table(spark, folder, "customer").select("c_custkey"), "c_custkey", 5, "persons", "step")
    first, ledger = ledger.reserve(2)
    second, ledger = ledger.reserve(1, table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey")))
    held = first.join(second.withColumnRenamed("draws", "second"), "c_custkey", "left").join(ledger.rows, "c_custkey")
    held = held.withColumn("normal", seeded_normals(F.col("seed"), F.col("rng_offset"), 1))
    return held.select(
        "c_custkey", F.col("draws")[0].alias("first_1"), F.col("draws")[1].alias("first_2"), F.col("second")[0].alias("more"), "rng_offset", rounded(F.col("normal")[0], 9).alias("normal")
    )


@query(
    f"""WITH RECURSIVE s AS (SELECT 2 * c_custkey AS id, {seed_sql("c_custkey", 3, "persons", "location")} AS seed FROM customer
        UNION ALL SELECT 2 * c_custkey + 1, {seed_sql("c_custkey", 3, "persons", "mode")} FROM customer), {twister_sql("s", 1)},
    h AS (SELECT l.id // 2 AS c_custkey, l.u AS l, m.u AS u, l.id // 2 IN (SELECT o_custkey FROM orders) AS busy FROM u l JOIN u m ON m.id = l.id + 1 WHERE l.id % 2 = 0)
    SELECT c_custkey, l[1] AS location_1, l[2] AS location_2, u[1] AS mode_draw, CASE WHEN busy THEN round(2.0 * {normal_sql("1")} + 0.5, 9) + 0.0 END AS mode_normal,
        1 + busy::INT AS rng_offset FROM h"""
)
def scoped_draws(spark: SparkSession, folder: str) -> DataFrame:
    """Two steps of a draw service; the second fails after a reservation and is taken up again by a new service."""
    customers = table(spark, folder, "customer").select("c_custkey")
    busy = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    place = workspace(spark, "draws")
    with DrawService(spark, place, {"persons": (customers, "c_custkey")}, 3).step("location") as service:
        location = service.uniforms("persons", 2)
    try:
        with service.step("mode"):
            service.uniforms("persons", 1)
            raise InterruptedError
    except InterruptedError:
        service = DrawService(spark, place, {"persons": (customers, "c_custkey")}, 3)
    with service.step("mode"):
        mode = service.uniforms("persons", 1)
        normal = service.normals("persons", 1, 0.5, 2.0, busy)
        offsets = service.offsets("persons")
    held = location.select("c_custkey", F.col("draws")[0].alias("location_1"), F.col("draws")[1].alias("location_2"))
    held = held.join(mode.select("c_custkey", F.col("draws")[0].alias("mode_draw")), "c_custkey").join(
        normal.select("c_custkey", rounded(F.col("draws")[0], 9).alias("mode_normal")), "c_custkey", "left"
    )
    return held.join(offsets.select("c_custkey", "rng_offset"), "c_custkey")
