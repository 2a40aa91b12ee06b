"""Registered queries of evaluations that are made once for many rows, or again for few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.operators import comparisons, guards, pairs
from wayfare.plans import choice_queries
from wayfare.plans.choice_queries import cube, draw, draw_sql, rounded, table
from wayfare.plans.session import kept, workspace
from wayfare.sources import cubes
from wayfare.sources.caches import NumericInputs
from wayfare.sources.ranges import Ranged
from wayfare.sources.tables import matrix_cells

PERIODS = ("EA", "AM", "MD", "PM", "EV")

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


_SHARES = """
w{0} AS (SELECT *, exp(u - max(u) OVER (PARTITION BY id)) AS w FROM u{0}),
s{0} AS (SELECT *, sum(w) OVER x AS hi, sum(w) OVER (PARTITION BY id) AS total, sum(w * exp(-e)) OVER x AS low, sum(w * exp(e)) OVER x AS high,
    sum(w * exp(-e)) OVER (PARTITION BY id) AS low_all, sum(w * exp(e)) OVER (PARTITION BY id) AS high_all
    FROM w{0} WINDOW x AS (PARTITION BY id ORDER BY alt ROWS UNBOUNDED PRECEDING)),
b{0} AS (SELECT *, coalesce(lag(hi) OVER x, 0) AS hi_before, coalesce(lag(low) OVER x, 0) AS low_before, coalesce(lag(high) OVER x, 0) AS high_before,
    max(alt) OVER (PARTITION BY id) AS last FROM s{0} WINDOW x AS (PARTITION BY id ORDER BY alt)),
c{0} AS (SELECT b.id, n, z, alt AS choice, w / total AS prob,
    low / (low + high_all - high) > z AND CASE WHEN high_before = 0 THEN 0 ELSE high_before / (high_before + low_all - low_before) END <= z AS proven
    FROM b{0} b JOIN r ON r.id = b.id AND z >= hi_before / total AND (z < hi / total OR alt = last))
"""


@query(
    f"""WITH r AS (SELECT c_custkey AS id, n, CASE n WHEN 0 THEN {draw_sql("c_custkey", 51)} WHEN 1 THEN {draw_sql("c_custkey", 52)} ELSE {draw_sql("c_custkey", 53)} END AS z FROM customer, (SELECT unnest(range(3)) AS n)),
    v AS (SELECT c_custkey AS id, n_nationkey AS alt, ((c_nationkey * 7 + n_nationkey * 11) % 50 + 1) * -0.06::DOUBLE + c_acctbal / 10000 * ((n_nationkey % 5) / 4.0::DOUBLE) AS u FROM customer, nation),
    ua AS (SELECT id, alt, floor(u * 32 + 0.5) / 32 AS u, 1 / 64.0::DOUBLE AS e FROM v), ub AS (SELECT id, alt, u, 0.0::DOUBLE AS e FROM v),
    {_SHARES.format("a")}, {_SHARES.format("b")}, g AS (SELECT id, NOT bool_and(proven) AS guarded FROM ca GROUP BY id)
    SELECT cb.id AS c_custkey, n AS draw_no, cb.choice, guarded, round(CASE WHEN guarded THEN cb.prob ELSE (SELECT prob FROM ca WHERE ca.id = cb.id AND ca.n = cb.n) END, 9) + 0.0 AS prob FROM cb JOIN g USING (id)"""
)
def guarded_destinations(spark: SparkSession, folder: str) -> DataFrame:
    """Destinations sampled from utilities in steps of 1/32; customers whose draws lie too near a boundary are evaluated again."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("alt"))
    ways = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey")).join(nations, F.lit(True))
    ways = ways.withColumn("dist", ((F.col("c_nationkey") * 7 + F.col("alt") * 11) % 50 + 1).cast("double"))

    def exact(who: DataFrame) -> DataFrame:
        rows = who.join(ways, "c_nationkey")
        return rows.select("c_custkey", "alt", (F.col("dist") * -0.06 + F.col("c_acctbal") / 10000 * ((F.col("alt") % 5) / 4.0)).alias("utility"))

    coarse = exact(customers).select("c_custkey", "alt", (F.floor(F.col("utility") * 32 + 0.5) / 32.0).alias("utility"), F.lit(1 / 64).alias("bound"))
    draws = customers.select("c_custkey", F.posexplode(F.array(*[draw(F.col("c_custkey"), 51 + i) for i in range(3)])).alias("draw_no", "rand"))
    found = guards.guarded_sample(
        coarse, draws, "c_custkey", "alt", "utility", "bound", lambda ids: exact(customers.join(ids, "c_custkey", "left_semi")), kept
    )
    return found.select("c_custkey", "draw_no", F.col("choice").cast("int").alias("choice"), "guarded", rounded(F.col("prob"), 9).alias("prob"))


@query(
    """WITH o AS (SELECT o_orderkey, (o_orderkey % 19 + 5)::SMALLINT AS s, (23 - o_custkey % (19 - o_orderkey % 19))::SMALLINT AS e FROM orders),
    r AS (SELECT *, CAST(dense_rank() OVER (ORDER BY s, e) - 1 AS INTEGER) AS slot, count(*) OVER (PARTITION BY s, e) AS sharing FROM o)
    SELECT o_orderkey, slot, sharing, round((SELECT sum(exp(-((h - s)::DOUBLE * (h - s) / 8.0 + (h - e)::DOUBLE * (h - e) / 8.0))) FROM range(5, 24) x(h)), 9) + 0.0 AS value FROM r"""
)
def pair_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """A sum over the day's hours for each distinct pair of start and end, scattered back to all orders that have the pair."""
    start = F.col("o_orderkey") % 19
    rows = table(spark, folder, "orders").select("o_orderkey", (start + 5).cast("short").alias("s"), (23 - F.col("o_custkey") % (19 - start)).cast("short").alias("e"))

    def evaluated(found: DataFrame) -> DataFrame:
        def near(h: Column) -> Column:
            a, b = (h - F.col("s")).cast("double"), (h - F.col("e")).cast("double")
            return F.exp(-(a * a / 8.0 + b * b / 8.0))

        total = F.aggregate(F.transform(F.sequence(F.lit(5), F.lit(23)), near), F.lit(0.0), lambda x, y: x + y)
        return pairs.pair_slots(found, "s", "e").withColumn("value", rounded(total, 9))

    return pairs.on_distinct(rows, ["s", "e"], evaluated, kept).select("o_orderkey", "slot", "sharing", "value")


@query(f"SELECT o_orderkey, od_dist, round(odt_time, 4) + 0.0 AS odt_time, round(dot_time, 4) + 0.0 AS dot_time, do_dist, max_dist FROM ({choice_queries.ORACLE_SQL['skim_lookup']})")
def dense_skims(spark: SparkSession, folder: str) -> DataFrame:
    """The reads of ``skim_lookup`` from a dense cube in memory: two joins on one end, cells by position."""
    nations = cubes.zone_map(table(spark, folder, "nation").select(F.col("n_nationkey").alias("zone")))
    held = cube(spark, folder)
    blocks = cubes.long_blocks(held.where("period = 0"), nations, ["DIST"]).unionByName(cubes.long_blocks(held, nations, ["TIME"], "period", PERIODS))
    dense = cubes.load_cube(kept(blocks, "blocks"), nations, {"DIST": 2, "TIME": 3}, 64 << 20, PERIODS)
    customers = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("orig"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey").join(customers, F.col("c_custkey") == F.col("o_custkey"))
    rows = orders.select(
        "o_orderkey", "orig", (F.col("o_orderkey") % 25).cast("int").alias("dest"),
        (F.col("o_orderkey") % 5).cast("int").alias("out_period"), (F.col("o_custkey") % 5).cast("int").alias("in_period"),
    )
    reads = {
        "od_dist": ("DIST", "orig", "dest", None), "odt_time": ("TIME", "orig", "dest", "out_period"),
        "dot_time": ("TIME", "dest", "orig", "in_period"), "do_dist": ("DIST", "dest", "orig", None),
    }
    found = dense.lookup(rows, reads).withColumn("max_dist", F.greatest("od_dist", "do_dist"))
    return found.select("o_orderkey", "od_dist", *[rounded(F.col(c), 4).alias(c) for c in ("odt_time", "dot_time")], "do_dist", "max_dist")


@query("SELECT o_custkey % 50 AS bucket, count(*) AS orders, round(sum(o_totalprice), 2) AS price, 2::BIGINT AS hits, 1::BIGINT AS misses FROM orders GROUP BY 1")
def cached_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """A CSV table read before it is cached, from the cache, and from the cache again under a new object."""
    place = workspace(spark, "inputs")
    table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice").write.option("header", True).csv(f"{place}/orders")
    types = {"o_orderkey": "long", "o_custkey": "long", "o_totalprice": "double"}
    first, second = NumericInputs(spark, f"{place}/cache"), NumericInputs(spark, f"{place}/cache")
    first.read(f"{place}/orders", types)
    first.prepare(f"{place}/orders", types)
    first.read(f"{place}/orders", types)
    held = second.read(f"{place}/orders", types)
    events = first.events + second.events
    hits = sum(e["hit"] for e in events)
    sums = held.groupBy((F.col("o_custkey") % 50).alias("bucket")).agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("price"))
    return sums.select("*", F.lit(hits).cast("long").alias("hits"), F.lit(len(events) - hits).cast("long").alias("misses"))


_WEIGHTS = {"stay": [0.5, 0.25, -0.125], "go": [0.25, -0.5, 1.0], "wait": [1.0, 0.0, 0.0]}


@query(
    """WITH o AS (SELECT o_orderkey, (o_custkey % 9)::FLOAT AS x, (o_orderkey % 16 / 8.0)::FLOAT AS y, (o_custkey % 5)::FLOAT AS z, o_orderkey % 50 = 0 AS bad, o_orderkey % 70 = 0 AS off FROM orders),
    p AS (SELECT *, CASE WHEN bad THEN y + 1 ELSE y END AS w FROM o),
    c AS (SELECT o_orderkey, 'feature' AS kind, 'y' AS name, NULL AS first_term, 'expression' AS category FROM p WHERE bad
        UNION ALL SELECT o_orderkey, 'utility', 'stay', 'y', 'inputs' FROM p WHERE bad
        UNION ALL SELECT o_orderkey, 'utility', 'go', CASE WHEN bad THEN 'y' END, CASE WHEN off THEN 'accumulation' ELSE 'inputs' END FROM p WHERE (bad AND NOT off) OR off)
    SELECT *, (SELECT count(*) FROM c) AS reported FROM c"""
)
def evaluation_report(spark: SparkSession, folder: str) -> DataFrame:
    """Two evaluations of a specification, one with a faulty term and a faulty sum; cells that differ, and the number that a written report gives."""
    key, owner = F.col("o_orderkey"), F.col("o_custkey")
    features = [(owner % 9).cast("float"), (key % 16 / 8.0).cast("float"), (owner % 5).cast("float")]
    rows = table(spark, folder, "orders").select("o_orderkey", F.array(*features).alias("features"))
    names = list(_WEIGHTS)

    def evaluated(held: DataFrame) -> DataFrame:
        return held.withColumn("utilities", F.array(*[comparisons.ordered_utility(F.col("features"), w) for w in _WEIGHTS.values()]))

    faulty = rows.withColumn("features", F.transform("features", lambda x, i: (x + F.when((i == 1) & (key % 50 == 0), 1.0).otherwise(0.0)).cast("float")))
    other = evaluated(faulty).withColumn("utilities", F.transform("utilities", lambda u, i: (u + F.when((i == 1) & (key % 70 == 0), 8.0).otherwise(0.0)).cast("float")))
    strict = evaluated(rows)
    found = kept(comparisons.divergences(strict, other, "o_orderkey", ["x", "y", "z"], names, _WEIGHTS), "divergences")
    place = f"{workspace(spark, 'report')}/report"
    comparisons.write_report(spark, comparisons.report(strict, found, "o_orderkey", ["x", "y", "z"], names), place)
    counted = sum(comparisons.read_report(spark, place)["categories"].values())
    return found.select("o_orderkey", "kind", "name", "first_term", "category", F.lit(counted).cast("long").alias("reported"))


@query(
    """WITH a AS (SELECT 'O' || o_orderstatus AS matrix, c_nationkey AS orig, o_orderkey % 7 AS dest, count(*)::DOUBLE AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
    b AS (SELECT 'O' || o_orderstatus AS matrix, c_nationkey AS orig, o_orderkey % 7 AS dest, count(*)::DOUBLE AS v FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 97 <> 0 GROUP BY ALL),
    j AS (SELECT a.matrix, coalesce(a.v, 0) AS r, coalesce(b.v, 0) AS c FROM a LEFT JOIN b ON a.matrix = b.matrix AND a.orig = b.orig AND a.dest = b.dest)
    SELECT matrix, sum(r) AS reference, sum(c) AS candidate, count(*) FILTER (r <> c) AS differing, max(abs(r - c)) AS largest FROM j GROUP BY matrix"""
)
def matrix_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse trip matrices beside those that some trips are missing from, by total and by cell."""
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("orig"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(customers, "o_custkey")
    trips = orders.select("orig", (F.col("o_orderkey") % 7).alias("dest"), "o_orderkey", *[(F.col("o_orderstatus") == s).cast("double").alias(s) for s in "FOP"])
    fields = {f"O{s}": [s] for s in "FOP"}
    whole, part = (matrix_cells(t, fields) for t in (trips, trips.where("o_orderkey % 97 <> 0")))
    return comparisons.compare_matrices(whole, part)[1]


@query(
    """WITH o AS (SELECT o_custkey AS household, count(*) AS orders, sum(o_totalprice) AS price, max(o_orderkey) AS newest FROM orders GROUP BY 1)
    SELECT c_custkey AS household, coalesce(orders, 0) AS orders, round(coalesce(price, 0), 2) AS price, newest,
        CAST(((c_custkey + 1) * ((m + 99) // 100) - 1) // m AS INTEGER) AS part FROM customer LEFT JOIN o ON household = c_custkey, (SELECT max(c_custkey) + 1 AS m FROM customer)"""
)
def ranged_households(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and customers kept by ranges of 100 households: grouped, and then joined, without another exchange."""
    place = workspace(spark, "ranges")
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("household"))
    ranges = Ranged.of(customers, "household", 100)
    people = ranges.write(customers, "customers", place)
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("household"), "o_orderkey", "o_totalprice")
    sums = ranges.write(orders, "orders", place).groupBy("part", "household")
    sums = sums.agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("price"), F.max("o_orderkey").alias("newest"))
    both = people.join(sums, ["part", "household"], "left")
    return both.select("household", F.coalesce("orders", F.lit(0)).alias("orders"), F.round(F.coalesce("price", F.lit(0.0)), 2).alias("price"), "newest", "part")
