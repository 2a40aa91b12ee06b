"""Registered queries: choices, nests, sampling and their composites, each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions.rng import entity_uniform
from wayfare.operators import choice, nested, sampling, skims
from wayfare.operators.lookup import gather
from wayfare.operators.spec import Spec, utilities

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def draw(key: Column, step: int = 0) -> Column:
    """A caller's reproducible draw in [0, 1): a multiplicative hash of a key."""
    return ((key % F.lit(1 << 31) * 2654435761 + step * 40503) % F.lit(1 << 32)) / F.lit(4294967296.0)


def draw_sql(key: str, step: int = 0) -> str:
    return f"((({key} % 2147483648) * 2654435761 + {step * 40503}) % 4294967296) / 4294967296.0::DOUBLE"


def rounded(x: Column, places: int = 6) -> Column:
    return F.round(x, places) + F.lit(0.0)


#: Choices over rows u(id, alt, util, z) in windows; ``miss`` is what is taken when no running sum reaches the draw.
CHOOSE = """
w AS (SELECT *, max(util) OVER (PARTITION BY id) AS top, exp(util - max(util) OVER (PARTITION BY id)) AS wt FROM u),
c AS (SELECT *, sum(wt) OVER (PARTITION BY id ORDER BY alt ROWS UNBOUNDED PRECEDING) AS upto FROM w),
t AS (SELECT *, max(upto) OVER (PARTITION BY id) AS total FROM c),
chosen AS (SELECT id, CAST(coalesce(min(CASE WHEN upto >= z * total THEN alt END), arg_max(alt, wt)) AS INTEGER) AS choice,
    round(max(top) + ln(max(total)), 6) + 0.0 AS logsum FROM t GROUP BY id)
"""

REGION_SPEC = Spec(
    "region",
    ("africa", "america", "asia", "europe", "middle_east"),
    ("balance", "near", "home", "constant"),
    ("(c_acctbal / 1000).clip(-2, 8)", "np.maximum(0, 5 - c_nationkey / 4)", "(c_nationkey > 4) & (c_nationkey <= 15)", "1"),
    ((0.05, 0.1, -0.05, 0.12, 0.0), (0.2, 0.1, 0.05, -0.1, 0.0), (0.0, 0.4, 0.3, 0.6, 0.1), (0.0, 0.3, 0.2, 0.1, -0.2)),
)
_REGION_U = """
f AS (SELECT c_custkey AS id, least(greatest(c_acctbal / 1000, -2), 8) AS f1, greatest(0, 5 - c_nationkey / 4.0) AS f2,
    CASE WHEN c_nationkey > 4 AND c_nationkey <= 15 THEN 1.0 ELSE 0.0 END AS f3 FROM customer),
b(alt, b1, b2, b3, b4) AS (VALUES (0, 0.05, 0.2, 0.0, 0.0), (1, 0.1, 0.1, 0.4, 0.3), (2, -0.05, 0.05, 0.3, 0.2), (3, 0.12, -0.1, 0.6, 0.1), (4, 0.0, 0.0, 0.1, -0.2)),
"""


def region_choice(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    held = utilities(customers, REGION_SPEC).withColumn("z", draw(F.col("c_custkey")))
    return choice.choose(held, "utilities", "z", width=5)


@query(f"WITH {_REGION_U} u AS (SELECT id, alt, b1::DOUBLE*f1 + b2::DOUBLE*f2 + b3::DOUBLE*f3 + b4::DOUBLE AS util, {draw_sql('id')} AS z FROM f, b), {CHOOSE} SELECT id AS c_custkey, choice, logsum FROM chosen")
def mnl_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Compiled specification, utilities, log-sum and choice in one projection."""
    return region_choice(spark, folder).select("c_custkey", "choice", rounded(F.col("logsum")).alias("logsum"))


@query(
    f"WITH {_REGION_U} u AS (SELECT id, alt, b1::DOUBLE*f1 + b2::DOUBLE*f2 + b3::DOUBLE*f3 + b4::DOUBLE AS util, {draw_sql('id', 1)} AS z FROM f, b WHERE (id + alt) % 3 <> 0), {CHOOSE} SELECT id AS c_custkey, choice, logsum FROM chosen"
)
def available_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Choice among the available alternatives only (A1, D3)."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    held = utilities(customers, REGION_SPEC).withColumn("z", draw(F.col("c_custkey"), 1))
    held = held.withColumn("open", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: (F.col("c_custkey") + i) % 3 != 0))
    return choice.choose(held, "utilities", "z", "open", 5).select("c_custkey", "choice", rounded(F.col("logsum")).alias("logsum"))


def beta(alternative: int, feature: int) -> float:
    return ((alternative * 7 + feature * 3) % 11 - 5) / 4


@query(
    f"""WITH e AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS f FROM embeddings),
    a AS (SELECT unnest(range(10)) AS alt), u AS (SELECT id, alt, sum(x * ((alt * 7 + f * 3) % 11 - 5) / 4.0) + alt / 20.0::DOUBLE AS util, {draw_sql("id")} AS z FROM e, a GROUP BY id, alt), {CHOOSE}
    SELECT id AS vec_id, choice, logsum FROM chosen"""
)
def linear_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Feature arrays times coefficients, then a choice (A2)."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    value = choice.linear_utilities("embedding", [[beta(a, f) for f in range(64)] for a in range(10)], [a / 20 for a in range(10)])
    held = rows.withColumn("u", value).withColumn("z", draw(F.col("vec_id")))
    return choice.choose(held, "u", "z", width=10).select("vec_id", "choice", rounded(F.col("logsum")).alias("logsum"))


@query(
    f"""WITH r AS (SELECT o_orderkey AS id, {draw_sql("o_orderkey", 2)} AS z, 1 + o_orderkey % 4 AS a, 1 + o_custkey % 3 AS b, 2 AS c FROM orders),
    p AS (SELECT id, z, a / (a + b + c)::DOUBLE AS p0, b / (a + b + c)::DOUBLE AS p1, c / (a + b + c)::DOUBLE AS p2 FROM r)
    SELECT id AS o_orderkey, CAST(CASE WHEN z - p0 <= 0 THEN 11 WHEN z - p0 - p1 <= 0 THEN 22 WHEN z - p0 - p1 - p2 <= 0 THEN 33
        WHEN p0 >= p1 AND p0 >= p2 THEN 11 WHEN p1 >= p2 THEN 22 ELSE 33 END AS INTEGER) AS label FROM p"""
)
def probability_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Choice by ordered subtraction from given probabilities, with labels (A3-A5)."""
    parts = [1 + F.col("o_orderkey") % 4, 1 + F.col("o_custkey") % 3, F.lit(2)]
    total = parts[0] + parts[1] + parts[2]
    rows = table(spark, folder, "orders").select("o_orderkey", draw(F.col("o_orderkey"), 2).alias("z"), F.array(*[p / total for p in parts]).alias("p"))
    return choice.make_choices(rows, "p", "z").select("o_orderkey", choice.labelled(F.col("choice"), [11, 22, 33]).alias("label"))


_LINES = """
l AS (SELECT l_orderkey AS id, l_extendedprice, l_discount, l_quantity, l_returnflag,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS alt FROM lineitem)
"""


def lines(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    rows = table(spark, folder, "lineitem")
    return rows.withColumn("alt_pos", F.row_number().over(order) - 1)


@query(
    f"""WITH {_LINES}, u AS (SELECT id, alt, l_extendedprice * 0.00002::DOUBLE + l_discount * -3.0::DOUBLE
        + (CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) * 0.3::DOUBLE AS util, {draw_sql("id", 3)} AS z FROM l), {CHOOSE}
    SELECT id AS l_orderkey, choice, logsum FROM chosen"""
)
def ragged_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Each order chooses one of its lines: ragged alternatives in long form, one shuffle."""
    rows = lines(spark, folder).select(
        "l_orderkey", "alt_pos", F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"),
        (F.col("l_returnflag") == "R").cast("double").alias("returned"), draw(F.col("l_orderkey"), 3).alias("z"),
    )
    held = choice.long_utilities(rows, ["price", "discount", "returned"], {"price": 0.00002, "discount": -3.0, "returned": 0.3})
    found = choice.choose_long(held, "l_orderkey", "alt_pos", "utility", "z")
    return found.select("l_orderkey", F.col("choice").cast("int").alias("choice"), rounded(F.col("logsum")).alias("logsum"))


@query(
    f"""WITH {_LINES}, s AS (SELECT l.*, c_mktsegment, length(c_mktsegment) AS n FROM l JOIN orders ON o_orderkey = id JOIN customer ON c_custkey = o_custkey),
    u AS (SELECT id, alt, l_extendedprice / 50000.0::DOUBLE * (n / 10.0::DOUBLE) + l_quantity * ((n - 8) / 100.0::DOUBLE) AS util, {draw_sql("id", 4)} AS z FROM s), {CHOOSE}
    SELECT id AS l_orderkey, choice, logsum FROM chosen"""
)
def segmented_choice(spark: SparkSession, folder: str) -> DataFrame:
    """As ragged_choice, with coefficients by the customer's segment."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey").join(customers, F.col("c_custkey") == F.col("o_custkey"))
    n = F.length("c_mktsegment")
    held = customers.select("c_mktsegment").distinct()
    coefficients = held.select(
        "c_mktsegment",
        F.inline(F.array(F.struct(F.lit("price").alias("term"), (n / 10.0).alias("coefficient")), F.struct(F.lit("quantity").alias("term"), ((n - 8) / 100.0).alias("coefficient")))),
    )
    rows = lines(spark, folder).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "alt_pos", "c_mktsegment", (F.col("l_extendedprice") / 50000.0).alias("price"), F.col("l_quantity").alias("quantity"), draw(F.col("l_orderkey"), 4).alias("z")
    )
    found = choice.choose_long(choice.long_utilities(rows, ["price", "quantity"], coefficients, "c_mktsegment"), "l_orderkey", "alt_pos", "utility", "z")
    return found.select("l_orderkey", F.col("choice").cast("int").alias("choice"), rounded(F.col("logsum")).alias("logsum"))


TREE = nested.validated(nested.mode_tree())


def mode_utility(m: int, balance: Column, nation: Column) -> Column:
    return balance / 20000.0 * ((m % 5) - 2) + ((nation * (m + 3)) % 7) / 7.0


_NESTS = f"""
m(m, nest, parent, scale, sub, top) AS (SELECT m, CASE WHEN m < 6 THEN m // 2 WHEN m < 8 THEN 3 WHEN m < 13 THEN 4 WHEN m < 18 THEN 5 ELSE 6 END,
    CASE WHEN m < 6 THEN 0 WHEN m < 8 THEN 1 WHEN m < 18 THEN 2 ELSE 3 END,
    CASE WHEN m < 6 THEN 0.72::DOUBLE * 0.35 WHEN m < 8 THEN 0.72::DOUBLE WHEN m < 18 THEN 0.72::DOUBLE * 0.5 ELSE 0.36::DOUBLE END,
    CASE WHEN m < 6 THEN 0.35::DOUBLE WHEN m < 8 THEN 0.72 WHEN m < 18 THEN 0.5 ELSE 0.36 END,
    CASE WHEN m < 6 THEN 0.72::DOUBLE WHEN m < 8 THEN 1.0 WHEN m < 18 THEN 0.72 ELSE 1.0 END FROM (SELECT unnest(range(21)) AS m)),
v AS (SELECT c_custkey AS id, m.*, c_acctbal / 20000.0 * ((m % 5) - 2) + ((c_nationkey * (m + 3)) % 7) / 7.0::DOUBLE AS util, {draw_sql("c_custkey", 5)} AS z FROM customer, m),
n1 AS (SELECT id, nest, any_value(parent) AS parent, any_value(top) AS top, any_value(sub) * ln(sum(exp(util / scale))) AS s FROM v GROUP BY id, nest),
n2 AS (SELECT id, parent, any_value(CASE WHEN parent IN (0, 2) THEN top ELSE 1.0 END) * ln(sum(exp(s))) AS s FROM n1 GROUP BY id, parent),
root AS (SELECT id, ln(sum(exp(s))) AS logsum FROM n2 GROUP BY id)
"""


@query(f"WITH {_NESTS} SELECT id AS c_custkey, round(logsum, 6) + 0.0 AS logsum FROM root")
def nested_logsum(spark: SparkSession, folder: str) -> DataFrame:
    """Log-sums over the 21-alternative mode tree."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    rows = customers.select("c_custkey", *[mode_utility(i, F.col("c_acctbal"), F.col("c_nationkey")).alias(f"m{i}") for i in range(21)])
    return nested.logsum(rows, TREE).select("c_custkey", rounded(F.col("logsum")).alias("logsum"))


@query(
    f"""WITH {_NESTS},
    p AS (SELECT v.id, v.m, v.z,
        exp(n2.s - root.logsum) * exp(n1.s - k.s) * exp(v.util / v.scale - n1.s / v.sub) AS p
        FROM v JOIN n1 USING (id, nest) JOIN n2 ON n2.id = v.id AND n2.parent = v.parent JOIN root ON root.id = v.id
        JOIN (SELECT id, parent, ln(sum(exp(s))) AS s FROM n1 GROUP BY id, parent) k ON k.id = v.id AND k.parent = v.parent),
    c AS (SELECT id, m, z, p, sum(p) OVER (PARTITION BY id ORDER BY m ROWS UNBOUNDED PRECEDING) AS upto FROM p)
    SELECT id AS c_custkey, CAST(coalesce(min(CASE WHEN upto >= z THEN m END), arg_max(m, p)) AS INTEGER) AS mode FROM c GROUP BY id"""
)
def mode_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Nested probabilities down the tree, and a choice."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    rows = customers.select(
        "c_custkey", draw(F.col("c_custkey"), 5).alias("z"), *[mode_utility(i, F.col("c_acctbal"), F.col("c_nationkey")).alias(f"m{i}") for i in range(21)]
    )
    held = nested.probabilities(rows, TREE, "p")
    return held.select("c_custkey", choice.choose_from_probabilities(F.col("p"), F.col("z")).cast("int").alias("mode"))


def cube(spark: SparkSession, folder: str) -> DataFrame:
    """A matrix table from the nations: (orig, dest, period) with DIST and TIME."""
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("orig"))
    pairs = nations.join(nations.select(F.col("orig").alias("dest")), F.lit(True))
    held = pairs.withColumn("period", F.explode(F.sequence(F.lit(0), F.lit(4))))
    dist = ((F.col("orig") * 7 + F.col("dest") * 11) % 50 + 1).cast("double")
    return held.select("orig", "dest", "period", dist.alias("DIST"), (dist * (10 + F.col("period")) / 10.0).alias("TIME"))


_CUBE = """
k AS (SELECT o.n_nationkey AS orig, d.n_nationkey AS dest, p AS period, ((o.n_nationkey * 7 + d.n_nationkey * 11) % 50 + 1)::DOUBLE AS dist
    FROM nation o, nation d, (SELECT unnest(range(5)) AS p)),
"""


@query(
    f"""WITH {_CUBE} o AS (SELECT o_orderkey, c_nationkey AS orig, (o_orderkey % 25)::INTEGER AS dest, (o_orderkey % 5)::INTEGER AS op, (o_custkey % 5)::INTEGER AS ip FROM orders JOIN customer ON c_custkey = o_custkey)
    SELECT o_orderkey, a.dist AS od_dist, b.dist * (10 + op) / 10.0 AS odt_time, c.dist * (10 + ip) / 10.0 AS dot_time, c.dist AS do_dist, greatest(a.dist, c.dist) AS max_dist
    FROM o JOIN k a ON a.orig = o.orig AND a.dest = o.dest AND a.period = 0 JOIN k b ON b.orig = o.orig AND b.dest = o.dest AND b.period = op
    JOIN k c ON c.orig = o.dest AND c.dest = o.orig AND c.period = 0"""
)
def skim_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Matrix reads in every direction: rank 2, both periods, reverse and the larger of both."""
    customers = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("orig"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey").join(customers, F.col("c_custkey") == F.col("o_custkey"))
    rows = orders.select(
        "o_orderkey", "orig", (F.col("o_orderkey") % 25).cast("int").alias("dest"),
        (F.col("o_orderkey") % 5).cast("int").alias("out_period"), (F.col("o_custkey") % 5).cast("int").alias("in_period"),
    )
    reads = [("od_skims", "DIST", "max"), ("odt_skims", "TIME", "plain"), ("dot_skims", "TIME", "plain")]
    held, columns = skims.bind(rows, cube(spark, folder), reads)
    there, back = columns["od_skims", "DIST", "plain"], columns["od_skims", "DIST", "reverse"]
    return held.select(
        "o_orderkey", there.alias("od_dist"), columns["odt_skims", "TIME", "plain"].alias("odt_time"), columns["dot_skims", "TIME", "plain"].alias("dot_time"),
        back.alias("do_dist"), F.greatest(there, back).alias("max_dist"),
    )


DRAWS = 8


def sampled(spark: SparkSession, folder: str) -> DataFrame:
    """Destinations that customers sample among all nations, with utilities and pick counts."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    held = skims.needed(cube(spark, folder), ["DIST"], True).where("period = 0").drop("period")
    rows = skims.destinations(customers.withColumnRenamed("c_nationkey", "orig"), held, "orig", ["DIST"])
    utility = F.col("DIST") * -0.05 + F.log1p((F.col("alt_pos") % 6).cast("double"))
    rows = rows.select("c_custkey", "alt_pos", utility.alias("u"))
    rows = sampling.softmax_rows(rows, "c_custkey", "u").withColumn("prob", F.col("prob").cast("double"))
    draws = customers.select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))).alias("draw_no"))
    draws = draws.select("c_custkey", "draw_no", draw(F.col("c_custkey") * DRAWS + F.col("draw_no"), 6).alias("rand"))
    taken = sampling.sample_long(rows.select("c_custkey", "alt_pos", "prob"), draws, "c_custkey", "alt_pos", "prob")
    found = sampling.collapsed(taken, "c_custkey")
    return found.join(rows.select("c_custkey", F.col("alt_pos").alias("choice"), "u").hint("merge"), ["c_custkey", "choice"])


_SAMPLED = f"""
{_CUBE} a AS (SELECT c_custkey AS id, dest AS alt, dist * -0.05::DOUBLE + ln(1 + dest % 6) AS util FROM customer JOIN k ON k.orig = c_nationkey AND period = 0),
p AS (SELECT id, alt, util, CAST(CAST(exp(util) / sum(exp(util)) OVER (PARTITION BY id) AS FLOAT) AS DOUBLE) AS prob FROM a),
q AS (SELECT *, sum(prob) OVER (PARTITION BY id ORDER BY alt ROWS UNBOUNDED PRECEDING) AS hi, max(alt) OVER (PARTITION BY id) AS last FROM p),
r AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY id ORDER BY alt), 0) AS lo FROM q),
d AS (SELECT c_custkey AS id, n, {draw_sql(f"(c_custkey * {DRAWS} + n)", 6)} AS rand FROM customer, (SELECT unnest(range({DRAWS})) AS n)),
s AS (SELECT r.id, r.alt, any_value(r.util) AS util, any_value(r.prob) AS prob, arg_min(rand, n) AS rand, count(*) AS picks
    FROM r JOIN d ON d.id = r.id AND rand >= lo AND (rand < hi OR alt = last) GROUP BY r.id, r.alt)
"""


@query(f"WITH {_SAMPLED} SELECT id AS c_custkey, CAST(alt AS INTEGER) AS dest, round(rand, 9) AS rand, round(prob, 6) AS prob, CAST(picks AS INTEGER) AS pick_count FROM s")
def destination_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Importance sampling with replacement, duplicates collapsed."""
    found = sampled(spark, folder)
    return found.select(
        "c_custkey", F.col("choice").cast("int").alias("dest"), F.round("rand", 9).alias("rand"), F.round(F.col("prob").cast("double"), 6).alias("prob"), "pick_count"
    )


@query(
    f"""WITH {_SAMPLED}, u AS (SELECT id, alt, util + least(ln(picks / prob), 60) AS util, {draw_sql("id", 7)} AS z FROM s), {CHOOSE}
    SELECT id AS c_custkey, choice AS dest, logsum FROM chosen"""
)
def destination_choice(spark: SparkSession, folder: str) -> DataFrame:
    """The final choice among sampled destinations, corrected for sampling."""
    rows = sampled(spark, folder).withColumn("z", draw(F.col("c_custkey"), 7))
    found = sampling.final_choice(rows, "c_custkey", "u", "z")
    return found.select("c_custkey", F.col("choice").cast("int").alias("dest"), rounded(F.col("logsum")).alias("logsum"))


@query(
    f"""WITH {_SAMPLED}, g AS (SELECT s.id, s.alt, 'od' AS direction, c_nationkey AS o, s.alt AS d FROM s JOIN customer ON c_custkey = s.id
        UNION ALL SELECT s.id, s.alt, 'dp', s.alt, (s.id % 25)::INTEGER FROM s),
    h AS (SELECT g.*, k.dist FROM g JOIN k ON k.orig = g.o AND k.dest = g.d AND k.period = 0),
    j AS (SELECT id, alt, direction, ln(exp(-0.03 * dist) + exp(0.5 - 0.06 * dist) + exp(1.0 - 0.12 * dist)) AS s FROM h)
    SELECT id AS c_custkey, CAST(alt AS INTEGER) AS dest, round(max(s) FILTER (direction = 'od'), 6) + 0.0 AS od_logsum, round(max(s) FILTER (direction = 'dp'), 6) + 0.0 AS dp_logsum FROM j GROUP BY id, alt"""
)
def directional_logsums(spark: SparkSession, folder: str) -> DataFrame:
    """Mode log-sums of both legs of each sampled destination in one pass, then side by side."""
    from wayfare.operators.lookup import legs

    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("trip_id"), F.col("c_nationkey").alias("origin"), (F.col("c_custkey") % 25).cast("int").alias("primary_dest")
    )
    sample = sampled(spark, folder).select(F.col("c_custkey").alias("trip_id"), F.col("choice").alias("dest"))
    both = legs(sample, customers)
    held = skims.lookup(both, cube(spark, folder).where("period = 0"), ["DIST"], "leg_orig", "leg_dest")
    u = F.array(*[F.lit(a) + F.col("DIST") * b for a, b in ((0.0, -0.03), (0.5, -0.06), (1.0, -0.12))])
    held = held.withColumn("s", choice.probabilities(u)[1])
    found = held.groupBy(F.col("trip_id").alias("c_custkey"), F.col("dest").cast("int").alias("dest")).pivot("direction", ["od", "dp"]).agg(F.max("s"))
    return found.select("c_custkey", "dest", rounded(F.col("od")).alias("od_logsum"), rounded(F.col("dp")).alias("dp_logsum"))


@query(
    """WITH k AS (SELECT c_custkey AS id, xor(c_custkey::UBIGINT, xor(((7::UHUGEINT * 15183679468541472403::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT, ((3::UHUGEINT * 14581110107779764567::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT)) AS key FROM customer),
    a AS (SELECT id, ((key::UHUGEINT + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM k),
    b AS (SELECT id, ((xor(z, z >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM a),
    c AS (SELECT id, ((xor(z, z >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM b)
    SELECT id AS c_custkey, round(CAST(CAST((xor(z, z >> 31) >> 40) + 0.5 AS DOUBLE) / 16777216.0::DOUBLE AS FLOAT)::DOUBLE, 7) AS u FROM c"""
)
def entity_draws(spark: SparkSession, folder: str) -> DataFrame:
    """Counter-based uniforms by entity."""
    rows = table(spark, folder, "customer").select("c_custkey")
    return rows.select("c_custkey", F.round(entity_uniform(F.col("c_custkey"), 7, 3).cast("double"), 7).alias("u"))


def household_features(rows: DataFrame) -> DataFrame:
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    derived = [
        F.least(F.greatest(balance / 2000, F.lit(-2.0)), F.lit(4.0)),
        F.least(F.col("c_nationkey").cast("double"), F.lit(10.0)) / 10,
        F.pmod(key, F.lit(7)) / 7.0,
        F.pmod(key, F.lit(5)) / 5.0,
        (balance > 5000).cast("double"),
        (balance < 0).cast("double"),
        F.length("c_mktsegment") / 10.0,
        F.lit(0.5),
    ]
    return rows.withColumn("x", F.array(*derived))


_HOUSEHOLD = f"""
h AS (SELECT c_custkey AS id, c_nationkey, least(greatest(c_acctbal / 2000, -2.0), 4.0)::DOUBLE AS x0, least(c_nationkey, 10) / 10.0::DOUBLE AS x1, c_custkey % 7 / 7.0::DOUBLE AS x2,
    c_custkey % 5 / 5.0::DOUBLE AS x3, (c_acctbal > 5000)::INT::DOUBLE AS x4, (c_acctbal < 0)::INT::DOUBLE AS x5, length(c_mktsegment) / 10.0::DOUBLE AS x6 FROM customer),
alt AS (SELECT unnest(range(21)) AS a),
"""


def _dot_sql(last: str) -> str:
    terms = [f"x{f} * (((a * 7 + {f * 3}) % 11 - 5) / 4.0::DOUBLE)" for f in range(7)] + [f"{last} * (((a * 7 + 21) % 11 - 5) / 4.0::DOUBLE)"]
    return " + ".join(terms)


def _pick_sql(name: str, source: str, last: str, step: int) -> str:
    return f"""
    {name}u AS (SELECT id, c_nationkey, x0, x1, x2, x3, x4, x5, x6, a AS alt, {_dot_sql(last)} AS util, {draw_sql("id", step)} AS z FROM {source}, alt),
    {name}w AS (SELECT *, exp(util - max(util) OVER (PARTITION BY id)) AS wt FROM {name}u),
    {name}c AS (SELECT *, sum(wt) OVER (PARTITION BY id ORDER BY alt ROWS UNBOUNDED PRECEDING) AS upto FROM {name}w),
    {name}t AS (SELECT *, max(upto) OVER (PARTITION BY id) AS total FROM {name}c),
    {name} AS (SELECT id, c_nationkey, x0, x1, x2, x3, x4, x5, x6, coalesce(min(CASE WHEN upto >= z * total THEN alt END), arg_max(alt, wt)) AS choice FROM {name}t GROUP BY ALL)"""


@query(
    f"""WITH {_HOUSEHOLD} {_pick_sql("one", "h", "0.5", 8)}, o AS (SELECT *, choice / 20.0::DOUBLE AS x7 FROM one), {_pick_sql("two", "o", "x7", 9)}
    SELECT one.c_nationkey AS zone, CAST(sum(one.choice) AS BIGINT) AS first_sum, CAST(sum(two.choice) AS BIGINT) AS second_sum, count(*) AS households FROM one JOIN two USING (id) GROUP BY 1"""
)
def household_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Features, a 21-alternative choice, its result as a feature of a second choice, sums by zone."""
    rows = household_features(table(spark, folder, "customer")).select("c_custkey", "c_nationkey", "x")
    coefficients = [[beta(a, f) for f in range(8)] for a in range(21)]
    for name, step in (("first", 8), ("second", 9)):
        rows = rows.withColumn("u", choice.linear_utilities("x", coefficients, [0.0] * 21)).withColumn("z", draw(F.col("c_custkey"), step))
        rows = choice.choose(rows, "u", "z", width=21).withColumnRenamed("choice", name).drop("logsum", "u", "z")
        rows = rows.withColumn("x", F.concat(F.slice("x", 1, 7), F.array(F.col(name) / 20.0)))
    return rows.groupBy(F.col("c_nationkey").alias("zone")).agg(
        F.sum("first").alias("first_sum"), F.sum("second").alias("second_sum"), F.count(F.lit(1)).alias("households")
    )


FREQUENCY_SPEC = Spec(
    "frequency",
    ("none", "one", "two"),
    ("autos", "total", "urgent"),
    ("autos", "o_totalprice / 100000", "(o_orderpriority == '1-URGENT')"),
    ((0.0, 0.1, 0.2), (0.0, 0.3, 0.1), (0.0, -0.2, 0.4)),
)


@query(
    f"""WITH {_REGION_U} u AS (SELECT id, alt, b1::DOUBLE*f1 + b2::DOUBLE*f2 + b3::DOUBLE*f3 + b4::DOUBLE AS util, {draw_sql("id")} AS z FROM f, b), {CHOOSE},
    g AS (SELECT o_orderkey AS id, choice AS autos, o_totalprice / 100000 AS p, (o_orderpriority = '1-URGENT')::INT::DOUBLE AS r, {draw_sql("o_orderkey", 10)} AS z FROM orders JOIN chosen ON chosen.id = o_custkey WHERE o_orderstatus <> 'F'),
    u2 AS (SELECT id, z, alt, CASE alt WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.1::DOUBLE * autos + 0.3::DOUBLE * p - 0.2::DOUBLE * r ELSE 0.2::DOUBLE * autos + 0.1::DOUBLE * p + 0.4::DOUBLE * r END AS util FROM g, (SELECT unnest(range(3)) AS alt)),
    c2 AS (SELECT *, sum(exp(util)) OVER (PARTITION BY id ORDER BY alt ROWS UNBOUNDED PRECEDING) AS upto, sum(exp(util)) OVER (PARTITION BY id) AS total FROM u2)
    SELECT id AS o_orderkey, CAST(min(CASE WHEN upto >= z * total THEN alt END) AS INTEGER) AS frequency FROM c2 GROUP BY id"""
)
def calibrated_chain(spark: SparkSession, folder: str) -> DataFrame:
    """A person-level choice looked up by the person's open orders, and a second choice that depends on it."""
    autos = region_choice(spark, folder).select(F.col("c_custkey").alias("o_custkey"), F.col("choice").alias("autos"))
    orders = table(spark, folder, "orders").where("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    held = gather(orders, autos, ["o_custkey"], ["autos"])
    held = utilities(held, FREQUENCY_SPEC).withColumn("z", draw(F.col("o_orderkey"), 10))
    return choice.choose(held, "utilities", "z", width=3).select("o_orderkey", F.col("choice").alias("frequency"))
