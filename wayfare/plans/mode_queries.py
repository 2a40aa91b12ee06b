"""Registered queries of mode choice with trees and coefficients as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.operators import mode_choice, nested
from wayfare.plans.choice_queries import draw, draw_sql, rounded, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Trees of three components that differ in depth, alternatives and coefficients (fixed values).
TREES = {
    "work": nested.mode_tree(),
    "shop": nested.Nest.of({"name": "root", "coefficient": 1.0, "alternatives": [
        {"name": "auto", "coefficient": 0.6, "alternatives": ["alone", "shared", "passenger"]}, "walk",
        {"name": "transit", "coefficient": 0.45, "alternatives": ["bus", "ferry", {"name": "rail", "coefficient": 0.8, "alternatives": ["light", "heavy"]}]}]}),
    "atwork": nested.Nest.of({"name": "root", "coefficient": 0.9, "alternatives": ["drive", {"name": "slow", "coefficient": 0.5, "alternatives": ["foot", "cycle"]}, "taxi"]}),
}
PURPOSES = list(TREES)
TERMS = ("time", "cost", "constant")
ROWS = [row for purpose, tree in TREES.items() for row in mode_choice.tree_rows(tree, (purpose,))]
_VALUES = ", ".join(f"('{p}', '{n}', {'NULL' if u is None else repr(u)}, {'NULL' if c is None else c}::DOUBLE, {'NULL' if a is None else a}::INTEGER)" for p, n, u, c, a in ROWS)


def beta(purpose: int, segment: int, position: int, term: int) -> float:
    """A coefficient; such values stand in for a specification's."""
    return ((purpose * 5 + segment * 3 + position * 7 + term * 4) % 13 - 6) / 8


def levels_sql(deepest: int) -> str:
    """Values of nests from the deepest level up, and probabilities down again; tables n1 and leaf probabilities q."""
    out, down = [], ["q1 AS (SELECT id, node, 1.0::DOUBLE AS p FROM n1)"]
    for d in range(deepest, 0, -1):
        below = f"SELECT id, purpose, parent, node, x FROM v WHERE depth = {d + 1}" + (f" UNION ALL SELECT id, purpose, parent, node, x FROM n{d + 1}" if d < deepest else "")
        out.append(f"k{d} AS ({below}), n{d} AS (SELECT id, purpose, t.parent, t.node, any_value(t.coefficient) * ln(sum(exp(x))) AS x FROM k{d} JOIN t USING (purpose) WHERE t.node = k{d}.parent AND t.depth = {d} GROUP BY id, purpose, t.parent, t.node)")
    for d in range(1, deepest + 1):
        down.append(f"q{d + 1} AS (SELECT k.id, k.node, q.p * exp(k.x) / sum(exp(k.x)) OVER (PARTITION BY k.id, k.parent) AS p FROM k{d} k JOIN q{d} q ON q.id = k.id AND q.node = k.parent)")
    return ", ".join(out + down) + ", q AS (" + " UNION ALL ".join(f"SELECT * FROM q{d}" for d in range(2, deepest + 2)) + ")"


_SQL = f"""
WITH RECURSIVE t0(purpose, node, parent, coefficient, position) AS (VALUES {_VALUES}),
t(purpose, node, parent, coefficient, position, depth, scale) AS (SELECT *, 1, coefficient FROM t0 WHERE parent IS NULL
    UNION ALL SELECT t0.*, t.depth + 1, t.scale * coalesce(t0.coefficient, 1) FROM t0 JOIN t ON t.purpose = t0.purpose AND t.node = t0.parent),
c AS (SELECT o_orderkey AS id, (o_orderkey % 3)::INTEGER AS p, (c_acctbal > 4000)::INTEGER AS segment, o_totalprice / 200000 AS price, {draw_sql("o_orderkey", 41)} AS z
    FROM orders JOIN customer ON c_custkey = o_custkey),
u AS (SELECT c.id, c.z, t.purpose, t.node, t.parent, t.depth, t.position, t.scale,
    ((p * 5 + segment * 3 + position * 7 + 0) % 13 - 6) / 8.0::DOUBLE * (((id % 1000) * (position + 3)) % 17 / 10.0::DOUBLE)
    + ((p * 5 + segment * 3 + position * 7 + 4) % 13 - 6) / 8.0::DOUBLE * (price * (position % 4))
    + ((p * 5 + segment * 3 + position * 7 + 8) % 13 - 6) / 8.0::DOUBLE AS util
    FROM c JOIN t ON t.purpose = ['work', 'shop', 'atwork'][p + 1] AND t.position IS NOT NULL WHERE (id + position) % 5 <> 0),
v AS (SELECT *, util / scale AS x FROM u),
{levels_sql(4)},
r AS (SELECT v.id, v.position, v.node, v.z, q.p, sum(q.p) OVER (PARTITION BY v.id ORDER BY v.position ROWS UNBOUNDED PRECEDING) AS upto FROM v JOIN q USING (id, node)),
f AS (SELECT id, CAST(coalesce(min(CASE WHEN upto >= z THEN position END), arg_max(position, p)) AS INTEGER) AS choice FROM r GROUP BY id)
SELECT f.id AS o_orderkey, v.purpose, f.choice, v.node AS alternative, round(n1.x, 6) + 0.0 AS logsum FROM f JOIN v ON v.id = f.id AND v.position = f.choice JOIN n1 ON n1.id = f.id
"""


def mode_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Trees and coefficients as tables."""
    tree = spark.createDataFrame(ROWS, "purpose string, node string, parent string, coefficient double, position int")
    rows = [
        (purpose, segment, position, term, beta(p, segment, position, t))
        for p, purpose in enumerate(PURPOSES)
        for segment in (0, 1)
        for position in range(len(TREES[purpose].leaves()))
        for t, term in enumerate(TERMS)
    ]
    return tree, spark.createDataFrame(rows, "purpose string, segment int, position int, term string, coefficient double")


def purpose_mode_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Modes of trips, tours and at-work subtours: a tree, scales and segments' coefficients for each purpose."""
    tree, coefficients = mode_tables(spark)
    found = mode_choice.with_coefficients(mode_choice.branches(tree, ["purpose"]), coefficients, ["segment"], list(TERMS))
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(customers, "o_custkey")
    purpose = F.element_at(F.array(*map(F.lit, PURPOSES)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    choosers = orders.select(
        "o_orderkey", purpose.alias("purpose"), (F.col("c_acctbal") > 4000).cast("int").alias("segment"), (F.col("o_totalprice") / 200000).alias("price"), draw(F.col("o_orderkey"), 41).alias("z")
    )
    terms = {
        "time": (F.col("o_orderkey") % 1000 * (F.col("position") + 3)) % 17 / 10.0,
        "cost": F.col("price") * (F.col("position") % 4),
        "constant": F.lit(1.0),
    }
    open_ = (F.col("o_orderkey") + F.col("position")) % 5 != 0
    chosen = mode_choice.choose_modes(choosers, found, "o_orderkey", "z", terms, open_)
    held = chosen.where("choice >= 0").withColumn("purpose", F.element_at(F.array(*map(F.lit, PURPOSES)), (F.col("o_orderkey") % 3 + 1).cast("int")))
    return held.select("o_orderkey", "purpose", "choice", "alternative", rounded(F.col("logsum")).alias("logsum"))


QUERIES["purpose_mode_choice"] = purpose_mode_choice
ORACLE_SQL["purpose_mode_choice"] = _SQL
