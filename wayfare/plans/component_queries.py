"""Registered queries: single operators that the other queries do not reach, each with equivalent SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import ieee
from wayfare.functions.expressions import Compiler
from wayfare.functions.rng import Ledger, row_seed
from wayfare.operators import aggregates, chains, choice, inputs, lookup, nested, skims, timetable, tours
from wayfare.operators.spec import Spec, read_document, split_stateful, utilities, write_document
from wayfare.plans.choice_queries import _CUBE, _LINES, _NESTS, CHOOSE, TREE, cube, draw, draw_sql, lines, mode_utility, rounded, table
from wayfare.plans.stages import Graph
from wayfare.plans.table_queries import _TDD, timetabled
from wayfare.sources.tables import artifact_metadata, read_artifact, read_cube, read_spec, write_artifact, write_cube
from wayfare.plans.session import workspace

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


LOCALS_SPEC = Spec(
    "locals",
    ("stay", "go"),
    ("_price", "near", "middle", "far", "price"),
    ("_price@o_totalprice / 70001", "x.clip(0, 2)", "(x - 2).clip(0, 5)", "(x - 7).clip(0)", "_price * (o_orderstatus == 'O')"),
    ((0.0, 0.0), (0.1, 0.0), (0.2, -0.1), (0.0, 0.3), (0.0, 0.25)),
)


@query(
    """WITH x AS (SELECT o_orderkey, o_orderkey % 25 AS x, o_totalprice / 70001 * (o_orderstatus = 'O')::INT AS price FROM orders),
    s AS (SELECT *, least(x, 2) AS a, least(greatest(x - 2, 0), 5) AS b, greatest(x - 7, 0) AS c FROM x)
    SELECT o_orderkey, round(0.1::DOUBLE * a + 0.2::DOUBLE * b, 6) + 0.0 AS stay, round(-0.1::DOUBLE * b + 0.3::DOUBLE * c + 0.25::DOUBLE * price, 6) + 0.0 AS go FROM s"""
)
def locals_and_splines(spark: SparkSession, folder: str) -> DataFrame:
    """Locals that later terms read, without utility of their own, and a piecewise-linear distance."""
    rows = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", (F.col("o_orderkey") % 25).cast("double").alias("x"))
    held = utilities(rows, LOCALS_SPEC)
    parts = ieee.spline(F.col("x"), [0.0, 2.0, 7.0])
    agree = sum(parts[1:], parts[0]) == F.col("x")
    checked = F.when(agree, F.col("utilities")).otherwise(F.raise_error(F.lit("a spline lost a part")).cast("array<double>"))
    return held.withColumn("u", checked).select("o_orderkey", rounded(F.col("u")[0]).alias("stay"), rounded(F.col("u")[1]).alias("go"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber > 1 THEN round(l_quantity / (1 - l_linenumber), 6)::VARCHAR WHEN l_discount = 0.05 THEN 'nan' WHEN l_discount > 0.05 THEN '-inf' ELSE 'inf' END AS ratio
    FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_discount, l_quantity, l_linenumber > 1 AS some FROM lineitem)"""
)
def signed_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """Division by numbers and by a negative zero: infinities of either sign and NaN as they are."""
    rows = table(spark, folder, "lineitem")
    compiler = Compiler({c: F.col(c) for c in ("above", "l_quantity", "l_linenumber")})
    excess = F.when(F.col("l_linenumber") > 1, F.col("l_quantity")).otherwise(F.signum(F.round(F.col("l_discount") - 0.05, 4)))
    held = rows.withColumn("above", excess).withColumn("value", compiler.number("above / -(l_linenumber - 1)"))
    names = F.when(F.isnan("value"), "nan").when(F.col("value") == ieee.INF, "inf").when(F.col("value") == -ieee.INF, "-inf")
    return held.select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(names, F.round("value", 6).cast("string")).alias("ratio"))


@query(
    """WITH f AS (SELECT o_custkey AS id, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
    SELECT c_custkey, coalesce(o_orderkey, -1) AS first_order, coalesce(round(o_totalprice, 2), 0.0) AS first_price FROM customer LEFT JOIN f ON id = c_custkey AND n = 1"""
)
def first_orders(spark: SparkSession, folder: str) -> DataFrame:
    """A source with many rows of a key: the first counts, and a default where there is none."""
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("first_order"), F.round("o_totalprice", 2).alias("first_price"))
    held = lookup.gather(table(spark, folder, "customer").select("c_custkey"), orders, ["c_custkey"], ["first_order", "first_price"], {"first_order": -1, "first_price": 0.0}, "first_order")
    return held.select("c_custkey", "first_order", "first_price")


@query(
    """WITH d AS (SELECT l_returnflag AS flag, l_linestatus AS status, l_linenumber AS line, count(*) AS n FROM lineitem GROUP BY 1, 2, 3), t AS (SELECT flag, status, sum(n) AS t FROM d GROUP BY 1, 2)
    SELECT l_orderkey, l_linenumber, l_partkey, round(n / t::DOUBLE, 9) AS prob FROM lineitem JOIN d ON flag = l_returnflag AND status = l_linestatus AND line = l_linenumber JOIN t USING (flag, status)"""
)
def departure_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Probabilities looked up by several columns, of a table that must hold each key once."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
    key = ["l_returnflag", "l_linestatus", "l_linenumber"]
    cells = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    totals = cells.groupBy(*key[:2]).agg(F.sum("n").alias("t"))
    shares = lookup.gather(cells, totals, key[:2], ["t"]).select(*key, (F.col("n") / F.col("t")).alias("prob"))
    return lookup.gather(rows, shares, key, ["prob"]).select("l_orderkey", "l_linenumber", "l_partkey", F.round("prob", 9).alias("prob"))


@query(
    f"""WITH {_CUBE} t AS (SELECT c_custkey, c_nationkey AS o, (c_custkey % 25)::INTEGER AS p FROM customer)
    SELECT c_custkey, CAST(a.dest AS INTEGER) AS alt, a.dist AS there, b.dist AS onward FROM t JOIN k a ON a.orig = o AND a.period = 0 JOIN k b ON b.orig = a.dest AND b.dest = p AND b.period = 0"""
)
def two_leg_destinations(spark: SparkSession, folder: str) -> DataFrame:
    """Every destination with the way to it and from it to the primary destination."""
    trips = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("o"), (F.col("c_custkey") % 25).cast("int").alias("p"))
    held = skims.two_legs(trips, cube(spark, folder).where("period = 0").drop("period"), "o", "p", ["DIST"])
    return held.select("c_custkey", F.col("alt_pos").cast("int").alias("alt"), F.col("od_DIST").alias("there"), F.col("dp_DIST").alias("onward"))


@query(
    """WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::FLOAT AS a, (l_extendedprice / 7)::FLOAT AS b, (-l_discount * 1000)::FLOAT AS c, (l_tax / 3)::FLOAT AS d, (l_extendedprice / 11)::FLOAT AS e, l_linenumber::FLOAT AS g FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, (((((a + b) + c) + d) + e) + g)::DOUBLE AS from_left, ((((a + b) + c) + d) + (e + g))::DOUBLE AS by_four FROM f"""
)
def policy_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Single-precision sums from the left and by groups of four, to the last bit."""
    rows = table(spark, folder, "lineitem")
    price = F.col("l_extendedprice")
    terms = [F.col("l_quantity"), price / 7, -F.col("l_discount") * 1000, F.col("l_tax") / 3, price / 11, F.col("l_linenumber")]
    sums = (choice.grouped_sum(terms).cast("double").alias("from_left"), choice.grouped_sum(terms, 4).cast("double").alias("by_four"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *sums)


def single_sql(tree: nested.Nest, leaf: str) -> str:
    """Tables after v, from columns v_<leaf> to v_<root>: a nest's value in single precision, level by level."""
    found = nested._nests(tree)
    deepest = max(d for d, _, _ in found)
    out = [f"v{deepest + 1} AS ({leaf})"]
    for level in range(deepest, -1, -1):
        here = [(n, f"{float(np.float32(scale))!r}") for d, n, scale in found if d == level]
        parts = {n.name: [x if isinstance(x, str) else x.name for x in n.parts] for n, _ in here}
        z = ", ".join(f"(v_{x}::DOUBLE / {mu}::DOUBLE)::FLOAT AS z_{x}" for n, mu in here for x in parts[n.name])
        tops = ", ".join(f"greatest({', '.join(f'z_{x}' for x in parts[n.name])}) AS t_{n.name}" for n, _ in here)
        values = ", ".join(
            f"((ln(({' + '.join(f'exp((z_{x} - t_{n.name})::FLOAT::DOUBLE)::FLOAT' for x in parts[n.name])})::DOUBLE)::FLOAT + t_{n.name})::FLOAT * {mu}::FLOAT)::FLOAT AS v_{n.name}" for n, mu in here
        )
        out.append(f"v{level} AS (SELECT *, {values} FROM (SELECT *, {tops} FROM (SELECT *, {z} FROM v{level + 1})))")
    return ", ".join(out)


_LEAVES = "SELECT id, " + ", ".join(f"max(util) FILTER (m = {i})::FLOAT AS v_m{i}" for i in range(21)) + " FROM v GROUP BY id"


_LANED = aggregates.pairwise_tree([f"embedding[{i + 1}]" for i in range(64)])


@query(f"SELECT vec_id, {_LANED}::DOUBLE AS pairwise, {aggregates.pairwise_tree([f'embedding[{i + 1}]' for i in range(13)])}::DOUBLE AS head FROM embeddings")
def pairwise_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Single-precision sums of arrays in the order of NumPy's lanes, to the last bit."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", F.slice("embedding", 1, 13).alias("first"))
    sums = [aggregates.pairwise_columns(c, lengths).cast("double").alias(name) for c, lengths, name in (("embedding", [64], "pairwise"), ("first", [13], "head"))]
    return rows.select("vec_id", *sums)


@query(f"WITH {_NESTS}, {single_sql(TREE, _LEAVES)} SELECT id AS c_custkey, v_root::DOUBLE AS single, round(logsum, 6) + 0.0 AS unshifted FROM root JOIN v0 USING (id)")
def nested_policies(spark: SparkSession, folder: str) -> DataFrame:
    """Log-sums in single precision at every step, to the last bit, and without a shift, over a checked tree."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    rows = customers.select("c_custkey", *[mode_utility(i, F.col("c_acctbal"), F.col("c_nationkey")).alias(f"m{i}") for i in range(21)])
    tree = nested.validated(TREE)
    both = nested.logsum(nested.single_logsum(rows, tree, "single"), tree, "unshifted", shift=False)
    return both.select("c_custkey", F.col("single").cast("double").alias("single"), rounded(F.col("unshifted")).alias("unshifted"))


@query(
    """SELECT o_orderkey, 'o_orderpriority' AS "column", o_orderpriority AS reference, 'none' AS candidate FROM orders WHERE o_orderkey % 10 = 3
    UNION ALL SELECT o_orderkey, 'cents', CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR), CAST(CAST(round(o_totalprice * 100) AS BIGINT) + 7 AS VARCHAR) FROM orders WHERE o_orderkey % 10 = 4"""
)
def output_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Two outputs compared, decisions exactly and values within a tolerance: only true differences are listed."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long").alias("cents")
    reference = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", cents)
    key = F.col("o_orderkey") % 10
    moved = F.when(key == 4, F.col("cents") + 7).when(key == 5, F.col("cents") + 2).otherwise(F.col("cents"))
    candidate = reference.withColumn("o_orderpriority", F.when(key == 3, "none").otherwise(F.col("o_orderpriority"))).withColumn("cents", moved)
    return aggregates.compare_outputs(reference, candidate, ["o_orderkey"], {"cents": 5})


@query(
    """SELECT l_orderkey AS trip_id, l_returnflag AS direction, any_value(l_orderkey % 7) AS zone, any_value(l_orderkey * 2 + (l_returnflag = 'R')::INT) AS state FROM lineitem GROUP BY 1, 2"""
)
def directional_states(spark: SparkSession, folder: str) -> DataFrame:
    """One state for each trip and direction, of columns that must not vary within it."""
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("trip_id"), F.col("l_returnflag").alias("direction"), (F.col("l_orderkey") % 7).alias("zone"),
        (F.col("l_orderkey") * 2 + (F.col("l_returnflag") == "R").cast("int")).alias("state"),
    )
    return aggregates.directional_state(rows, "trip_id", "direction", ["zone", "state"])


@query(
    """SELECT o_custkey, o_orderkey, row_number() OVER w = 1 AS is_start, CAST(row_number() OVER w - 1 AS INTEGER) AS before, CAST(count(*) OVER (PARTITION BY o_custkey) - row_number() OVER w AS INTEGER) AS after,
    CAST(floor(o_custkey / 100) AS BIGINT) AS part FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"""
)
def run_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Where each customer's orders stand: the first, counts both ways, and ranges of customers."""
    rows = table(spark, folder, "orders").select("o_custkey", "o_orderkey")
    held = aggregates.first_of_run(rows, "o_custkey", "o_orderkey")
    for name, up in (("before", True), ("after", False)):
        held = chains.cumulative_count(held, ["o_custkey"], "o_orderkey", name, up)
    return aggregates.in_ranges(held, "o_custkey", 100)


HASH32 = "('0x' || md5('{x}')[25:32])::BIGINT"


@query(f"SELECT c_custkey, (c_custkey + 5 + {HASH32.format(x='persons')} + {HASH32.format(x='auto_ownership')}) % 4294967296 AS seed FROM customer")
def entity_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Seeds of entities in a channel and a step."""
    return table(spark, folder, "customer").select("c_custkey", row_seed(F.col("c_custkey"), 5, "persons", "auto_ownership").alias("seed"))


FIXED_SPEC = Spec(
    "fixed",
    ("none", "one", "two"),
    ("autos", "total", "urgent"),
    ("autos", "o_totalprice / 100000", "(o_orderpriority == '1-URGENT')"),
    ((0.0, 0.2, 0.3), (0.1, 0.2, -0.1), (0.0, 0.5, 0.4)),
)


@query(
    f"""WITH f AS (SELECT o_orderkey AS id, c_nationkey % 4 AS autos, o_totalprice / 100000 AS p, (o_orderpriority = '1-URGENT')::INT AS r, {draw_sql("o_orderkey", 31)} AS z FROM orders JOIN customer ON c_custkey = o_custkey),
    u AS (SELECT id, z, a AS alt, CASE a WHEN 0 THEN 0.1::DOUBLE * p WHEN 1 THEN 0.2::DOUBLE * autos + 0.2::DOUBLE * p + 0.5::DOUBLE * r ELSE 0.3::DOUBLE * autos - 0.1::DOUBLE * p + 0.4::DOUBLE * r END AS util FROM f, (SELECT unnest(range(3)) AS a)), {CHOOSE}
    SELECT id AS o_orderkey, choice, logsum FROM chosen"""
)
def fused_choice(spark: SparkSession, folder: str) -> DataFrame:
    """A small fixed model whose one changing input is looked up as it is evaluated, in one projection."""
    autos = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") % 4).alias("autos"))
    rows = lookup.gather(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), autos, ["o_custkey"], ["autos"])
    held = choice.choose_fixed(utilities(rows, FIXED_SPEC).withColumn("z", draw(F.col("o_orderkey"), 31)), "utilities", "z")
    return held.select("o_orderkey", F.col("choice").cast("int").alias("choice"), rounded(F.col("logsum")).alias("logsum"))


@query(
    f"""WITH {_LINES}, u AS (SELECT id, alt, exp((u - max(u) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS w, {draw_sql("id", 32)} AS z FROM (SELECT id, alt, (l_extendedprice * 0.00002::DOUBLE + l_discount * -3.0::DOUBLE)::FLOAT::DOUBLE AS u FROM l)),
    p AS (SELECT id, alt, z, (w / (sum(w) OVER (PARTITION BY id))::FLOAT::DOUBLE)::FLOAT::DOUBLE AS p FROM u),
    c AS (SELECT id, alt, z - sum(p) OVER (PARTITION BY id ORDER BY alt ROWS UNBOUNDED PRECEDING) AS rest FROM p)
    SELECT id AS l_orderkey, CAST(coalesce(min(CASE WHEN rest <= 0 THEN alt END), max(alt)) AS INTEGER) AS choice FROM c GROUP BY id"""
)
def single_precision_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Each order chooses a line by single-precision probabilities and double subtraction."""
    rows = lines(spark, folder).select("l_orderkey", "alt_pos", (F.col("l_extendedprice") * 0.00002 + F.col("l_discount") * -3.0).alias("u"), draw(F.col("l_orderkey"), 32).alias("z"))
    found = choice.choose_long_single(rows, "l_orderkey", "alt_pos", "u", "z")
    return found.select("l_orderkey", F.col("choice").cast("int").alias("choice"))


def tour_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Orders as tours between zones, and the zones."""
    zone = F.col("n_nationkey")
    land = table(spark, folder, "nation").select(
        zone.alias("zone_id"), (zone % 6 + 0.5).alias("TERMINAL"), (zone * 3 % 11).alias("PRKCST"), (zone % 3).alias("TOPOLOGY"), (zone % 5).alias("area_type")
    )
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("origin"))
    key = F.col("o_orderkey")
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("work", "escort", "shopping")]), (key % 3 + 1).cast("int"))
    rows = table(spark, folder, "orders").join(customers, "o_custkey").select(
        "o_orderkey", "origin", (key % 25).cast("int").alias("destination"), kinds.alias("tour_type"), (key % 4 == 0).alias("free_parking_at_work"), ((key % 7 + 1) * 2.0).alias("value_of_time"),
        (key % 3).alias("number_of_participants"), F.when(key % 3 == 0, "mandatory").otherwise("other").alias("tour_category"), (key % 4 + 1).alias("hhsize"), (key % 2).alias("num_workers"),
        (key % 2 == 0).alias("outbound"), (key % 3 + 1).alias("trip_num"), F.lit(3).alias("trip_count"), (key % 5 == 0).alias("free_parking"),
    )
    return rows, land


_ENDS = """
z AS (SELECT n_nationkey AS zone, n_nationkey % 6 + 0.5::DOUBLE AS term, n_nationkey * 3 % 11 AS park, n_nationkey % 3 AS topo, n_nationkey % 5 AS area FROM nation),
o AS (SELECT o_orderkey AS k, x.term AS ot, x.park AS op, x.topo, y.term AS dt, y.park AS dp, y.area FROM orders JOIN customer ON c_custkey = o_custkey JOIN z x ON x.zone = c_nationkey JOIN z y ON y.zone = o_orderkey % 25)
"""


@query(
    f"""WITH {_ENDS} SELECT k AS o_orderkey, ot + dt AS total_terminal_time, round(1 / ((k % 7 + 1) * 2.0), 9) AS ivot, CASE WHEN k % 12 = 0 THEN 0.0 ELSE dp::DOUBLE END AS daily_parking_cost, topo AS origin_topology,
    area = 0 AS destination_in_cbd, k % 3 > 1 AS is_joint, k % 3 = 0 AS is_mandatory, k % 3 = 1 AS is_escort, k % 4 + 1 - k % 2 AS non_workers FROM o"""
)
def tour_mode_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Mode inputs of tours from the zones at both ends."""
    names = ("total_terminal_time", "ivot", "daily_parking_cost", "origin_topology", "destination_in_cbd", "is_joint", "is_mandatory", "is_escort", "non_workers")
    return inputs.tour_columns(*tour_inputs(spark, folder)).withColumn("ivot", F.round("ivot", 9)).select("o_orderkey", *names)


@query(
    f"""WITH {_ENDS} SELECT k AS o_orderkey, CASE WHEN k % 2 = 0 THEN dt ELSE ot END AS terminal_time, CASE WHEN k % 2 = 0 THEN k % 3 = 0 ELSE k % 3 = 2 END AS first_trip, CASE WHEN k % 5 = 0 THEN 0.0 ELSE dp::DOUBLE END AS parking_cost FROM o"""
)
def trip_mode_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Mode inputs of trips by direction."""
    return inputs.trip_columns(*tour_inputs(spark, folder)).select("o_orderkey", "terminal_time", "first_trip", "parking_cost")


_READS = inputs.tour_availability_columns()


def _open_sql() -> str:
    """The 18 availabilities over columns named as the matrices."""
    parts = {}
    for mode, (key, how) in inputs.AUTOS.items():
        parts[mode] = {"both": f"out_{key} > 0 AND in_{key} > 0", "either": f"out_{key} > 0 OR in_{key} > 0", "sum": f"out_{key} + in_{key} > 0"}[how]
    for way, at in (("walk", "WLK"), ("drive", "DRV")):
        for service, x in inputs.SERVICES_BY_LINE.items():
            out, back = f"out_{at}_{x}_WLK", f"in_WLK_{x}_{at}"
            parts[f"{way}_{service}"] = " AND ".join(
                [f"{out}_TOTIVT > 0 AND {back}_TOTIVT > 0"]
                + ([f"{out}_KEYIVT + {back}_KEYIVT > 0"] if service != "local" else [])
                + ([f"{out}_FERRYIVT + in_WLK_LRF_WLK_FERRYIVT > 0"] if service == "ferry" else [])
                + (["autos > 0"] if way == "drive" else [])
            )
    return ", ".join(f"({v}) AS {k}_available" for k, v in parts.items())


@query(
    "WITH m AS (SELECT o_orderkey, o_custkey % 3 AS autos, "
    + ", ".join(f"(o_orderkey * {i % 7 + 1} + o_custkey + {i}) % 3 * 40 AS {c}" for i, c in enumerate(_READS))
    + f" FROM orders) SELECT o_orderkey, {_open_sql()} FROM m"
)
def tour_mode_availability(spark: SparkSession, folder: str) -> DataFrame:
    """The 18 availabilities of tours by mode, ferry and legs with a line of their own among them."""
    key, other = F.col("o_orderkey"), F.col("o_custkey")
    values = [((key * (i % 7 + 1) + other + i) % 3 * 40).alias(c) for i, c in enumerate(_READS)]
    held = inputs.tour_availability(table(spark, folder, "orders").select("o_orderkey", (other % 3).alias("auto_ownership"), *values))
    return held.select("o_orderkey", *[c for c in held.columns if c.endswith("_available")])


_MODES = [[1, 2, 3], [4, 5], [6, 7, 8, 9], [10], [11, 12]]


@query(
    "SELECT o_orderkey, CAST("
    + " + ".join(f"CASE WHEN o_custkey % 14 IN ({', '.join(map(str, m))}) THEN {1 << i} ELSE 0 END" for i, m in enumerate(_MODES))
    + " AS INTEGER) AS mask, CAST(o_orderkey % 5 AS INTEGER) AS period FROM orders"
)
def mode_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Bits for the groups that hold a mode, and places of period labels."""
    labels = F.element_at(F.array(*[F.lit(x) for x in ("EA", "AM", "MD", "PM", "EV")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, folder, "orders").select("o_orderkey", ieee.membership(F.col("o_custkey") % 14, _MODES).alias("mask"), ieee.label_position(labels).alias("period"))


STATEFUL_SPEC = Spec(
    "stateful",
    ("utility",),
    ("start", "long", "_run", "ends", "run", "left"),
    (
        "start * -0.05",
        "(end - start > 8) * 0.3",
        "_run@tt.adjacent_window_before(df.person_id, df.start)",
        "@tt.previous_tour_ends(df.person_id, df.start)",
        "_run / 10",
        "@np.minimum(tt.remaining_periods_available(df.person_id, df.start, df.end), 6)",
    ),
    ((1.0,), (1.0,), (0.0,), (0.4,), (1.0,), (0.02,)),
)


@query(
    f"""WITH {_TDD}, mid AS (SELECT id, count(*) AS m FROM win WHERE w = 7 GROUP BY 1),
    b AS (SELECT ok.id, ok.tdd, max(p) AS last FROM ok LEFT JOIN win ON win.id = ok.id AND w = 7 AND p < s GROUP BY 1, 2)
    SELECT ok.id AS person_id, tdd, CAST(s - 1 - coalesce(last, 4) AS INTEGER) AS free_before,
        round(s * -0.05::DOUBLE + (e - s > 8)::INT * 0.3::DOUBLE + coalesce(a.w IN (4, 6), false)::INT * 0.4::DOUBLE + (s - 1 - coalesce(last, 4)) / 10.0::DOUBLE
            + 0.02::DOUBLE * least(19 - coalesce(m, 0) - greatest(e - s - 1, 0), 6), 6) + 0.0 AS utility
    FROM ok JOIN b USING (id, tdd) LEFT JOIN win a ON a.id = ok.id AND a.p = s LEFT JOIN mid ON mid.id = ok.id"""
)
def stateful_utilities(spark: SparkSession, folder: str) -> DataFrame:
    """Utilities of feasible tours in two parts: rows in the narrow grammar, and rows that ask the timetable."""
    windows, alternatives, prints = timetabled(spark, folder)
    rows = timetable.vocabulary(timetable.feasible(windows, alternatives), prints.first, prints.width)
    rows = rows.withColumn("free_before", timetable.free_runs(F.col("w_m7"), F.col("start") - prints.first, prints.width, True))
    plain, stateful = split_stateful(STATEFUL_SPEC)
    columns = {c: F.col(c) for c in ("start", "end")}
    narrow = Compiler(columns, restricted=True)
    asked = {"adjacent_window_before": F.col("free_before"), "previous_tour_ends": F.col("previous_ends"), "remaining_periods_available": F.col("remaining")}
    early = sum((narrow.number(e) * w for _, e, (w,) in plain.terms()), F.lit(0.0))
    held = rows.withColumns({name: Compiler(columns, timetable=asked).number(e) for name, e in stateful.locals})
    wide = Compiler(columns | {name: F.col(name) for name, _ in stateful.locals}, timetable=asked)
    late = sum((wide.number(e) * w for _, e, (w,) in stateful.terms()), F.lit(0.0))
    return held.select("person_id", "tdd", F.col("free_before").cast("int").alias("free_before"), rounded(early + late).alias("utility"))


def _pattern_rows(size: int) -> list[tuple[int, str, int, float]]:
    """(alternative, its name, person or -1, weight) of the patterns of households of ``size``: T11."""
    names = tours.pattern_alternatives(size)
    out = []
    for t, (term, entered) in enumerate(tours.pattern_terms(size)):
        who = int(term.split("_p")[1]) - 1 if term.count("_p") == 1 else -1
        out += [(names.index(p), p, who, ((t * 5) % 7 - 3) / 10) for p in entered]
    return out


_PATTERNS = "(VALUES " + ", ".join(f"({n}, {a}, '{p}', {who}, {w}::DOUBLE)" for n in (1, 2, 3) for a, p, who, w in _pattern_rows(n)) + ") AS v(n, alt, name, who, w)"


@query(
    f"""WITH h AS (SELECT c_custkey AS id, 1 + c_custkey % 3 AS n, {draw_sql("c_custkey", 33)} AS z FROM customer),
    pat AS (SELECT * FROM {_PATTERNS}),
    u AS (SELECT id, z, alt, name, sum(w * CASE WHEN who < 0 THEN 1.0 ELSE 1.0 + (id + who) % 4 / 4.0::DOUBLE END) AS util FROM h JOIN pat USING (n) GROUP BY id, z, alt, name), {CHOOSE}
    SELECT id AS c_custkey, name AS pattern, logsum FROM chosen JOIN h USING (id) JOIN (SELECT DISTINCT n, alt, name FROM pat) k ON k.n = h.n AND k.alt = choice"""
)
def daily_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Activity patterns of whole households, from a specification made for each size."""
    households = table(spark, folder, "customer").select("c_custkey", (1 + F.col("c_custkey") % 3).cast("int").alias("n"), draw(F.col("c_custkey"), 33).alias("z"))
    terms = spark.createDataFrame([(n, *row) for n in (1, 2, 3) for row in _pattern_rows(n)], "n int, alt int, name string, who int, w double")
    factor = F.when(F.col("who") < 0, 1.0).otherwise(1.0 + (F.col("c_custkey") + F.col("who")) % 4 / 4.0)
    rows = households.join(terms, "n").groupBy("c_custkey", "z", "alt").agg(F.sum(F.col("w") * factor).alias("u"))
    chosen = choice.choose_long(rows, "c_custkey", "alt", "u", "z")
    named = lookup.gather(households.join(chosen, "c_custkey").withColumnRenamed("choice", "alt"), terms.select("n", "alt", "name").distinct(), ["n", "alt"], ["name"])
    return named.select("c_custkey", F.col("name").alias("pattern"), rounded(F.col("logsum")).alias("logsum"))


#: A specification as files hold it: symbols, blanks, a row without an expression and one without weights.
_SPEC_ROWS = (
    ("price", "", "@df.o_totalprice / 70001", "0.25", "beta_price"),
    ("heading", "", "", "1", "1"),
    ("urgent", "", "(o_orderpriority == '1-URGENT')", "", "0.5"),
    ("nothing", "", "o_totalprice", "0", ""),
)


@query(
    "SELECT o_orderkey, round(0.25::DOUBLE * o_totalprice / 70001, 5) AS ship, round(-0.125::DOUBLE * o_totalprice / 70001 + 0.5::DOUBLE * (o_orderpriority = '1-URGENT')::INT, 5) + 0.0 AS hold FROM orders"
)
def specification_from_files(spark: SparkSession, folder: str) -> DataFrame:
    """A specification and its coefficients read from CSV files, through its document and back, and its utilities."""
    place = workspace(spark, "specification")
    rows = spark.createDataFrame(_SPEC_ROWS, "Label string, Description string, Expression string, ship string, hold string")
    rows.coalesce(1).write.option("header", True).option("escape", '"').csv(f"{place}/spec")
    spark.createDataFrame([("beta_price", -0.125)], "coefficient_name string, value double").coalesce(1).write.option("header", True).csv(f"{place}/coefficients")
    write_document(spark, read_spec(spark, "orders", f"{place}/spec", f"{place}/coefficients"), f"{place}/document")
    spec = read_document(spark, f"{place}/document")
    held = utilities(table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), spec)
    return held.select("o_orderkey", *[rounded(F.col("utilities")[i], 5).alias(name) for i, name in enumerate(spec.alternatives)])


@query("SELECT c_nationkey, CAST(count(*) AS BIGINT) AS customers, CAST(2 AS INTEGER) AS version FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def restored_stage(spark: SparkSession, folder: str) -> DataFrame:
    """A graph of stages whose checkpoint another one restores, ledger and all, and a gather under a lease."""
    place = workspace(spark, "stages")
    graph = Graph(spark)
    graph.ingress("persons", table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal"))
    graph.ledgers["persons"] = Ledger.start(graph.tables["persons"], "c_custkey", 5, "persons", "step").reserve(3)[1]
    graph.seal()
    graph.run("solvent", ["persons"], ["persons"], lambda held: {"persons": held["persons"].where("c_acctbal > 0")})
    graph.checkpoint(place, ["persons"])
    again = Graph(spark)
    again.restore(place, ["persons"])
    offsets = again.ledgers["persons"].rows.where("rng_offset = 3").select("c_custkey")
    drawn = again.publish("persons", ["c_custkey"]).join(offsets, "c_custkey", "left_semi")
    held = again.gather(again.lease("persons"), drawn, ["c_custkey"], ["c_nationkey"])
    return held.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), F.lit(again.versions["persons"]).alias("version"))


@query(
    f"WITH {_CUBE} o AS (SELECT o_orderkey, c_nationkey AS a, (o_orderkey % 25)::INTEGER AS b, (o_orderkey % 5)::INTEGER AS p FROM orders JOIN customer ON c_custkey = o_custkey) SELECT o_orderkey, dist * (10 + p) / 10.0 AS time FROM o JOIN k ON orig = a AND dest = b AND period = p"
)
def verified_matrices(spark: SparkSession, folder: str) -> DataFrame:
    """One matrix of a cube, checked by its own fingerprint, and looked up."""
    place = workspace(spark, "cube")
    write_cube(cube(spark, folder), place, ["DIST", "TIME"])
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("orig"))
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey").join(customers, "o_custkey")
    rows = rows.select("o_orderkey", "orig", (F.col("o_orderkey") % 25).cast("int").alias("dest"), (F.col("o_orderkey") % 5).cast("int").alias("period"))
    held = skims.lookup(rows, read_cube(spark, place, ["TIME"]), ["TIME"], "orig", "dest", "period")
    return held.select("o_orderkey", F.col("TIME").alias("time"))


@query("SELECT s_nationkey, round(sum(s_acctbal), 2) AS balance, 'suppliers' AS source FROM supplier GROUP BY 1")
def verified_artifact(spark: SparkSession, folder: str) -> DataFrame:
    """A table written once with a manifest, and read back checked, only the columns that are wanted."""
    place = workspace(spark, "artifact")
    write_artifact(table(spark, folder, "supplier"), place, {"source": "suppliers"})
    held = read_artifact(spark, place, ["s_nationkey", "s_acctbal"])
    return held.groupBy("s_nationkey").agg(F.round(F.sum("s_acctbal"), 2).alias("balance"), F.lit(artifact_metadata(spark, place)["source"]).alias("source"))
