"""Queries over the star schema that have the shapes of the code-map questions: ranking, counting, joining, comparing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import age_bucket, freshness, fuzzy_score, path_score
from ..operators.folds import Greedy, folded
from ..operators.positions import stabbed
from .base import Registry, table

R = Registry()

NOW = "2024-01-20 12:00:00"
_NOW = f"TIMESTAMP '{NOW}'"


@R.add("""WITH s AS (SELECT p_partkey, replace(p_name, ' ', '_') AS name FROM part), sc AS (
SELECT p_partkey, name, CASE WHEN name = 'bolt' THEN 1000.0 WHEN starts_with(name, 'bolt') THEN 800.0 - len(name) WHEN strpos(name, 'bolt') > 0 THEN 600.0 - (strpos(name, 'bolt') - 1) - len(name) * 0.1
 WHEN FALSE THEN 0.0 ELSE 0.0 END AS score FROM s)
SELECT p_partkey, name, round(score, 6) AS score FROM sc WHERE score > 0 ORDER BY score DESC, len(name), p_partkey LIMIT 100""")
def q04_fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"))
    scored = named.withColumn("score", fuzzy_score(F.col("name"), "bolt")).where("score > 0")
    return scored.orderBy(F.desc("score"), F.char_length("name"), "p_partkey").limit(100).withColumn("score", F.round("score", 6))


@R.add("""WITH s AS (SELECT p_partkey, replace(p_name, ' ', '_') AS name FROM part)
SELECT p_partkey, name, round(CASE WHEN name = 'sw' THEN 1000.0 WHEN starts_with(name, 'sw') THEN 800.0 - len(name) WHEN strpos(name, 'sw') > 0 THEN 600.0 - (strpos(name, 'sw') - 1) - len(name) * 0.1
 ELSE 250.0 - len(name) * 0.1 END, 6) AS score FROM s WHERE strpos(name, 'sw') > 0 OR regexp_matches(name, '^(s|.*_s)(.*_)w')""")
def q04_fuzzy_initials(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"))
    return named.withColumn("score", F.round(fuzzy_score(F.col("name"), "sw"), 6)).where("score > 0")


@R.add("""WITH t AS (SELECT page_id, lower(url) AS t, regexp_extract(lower(url), '[^/]*$', 0) AS base, string_split(lower(url), '/') AS segs FROM pages),
k AS (SELECT *, len(t) - len(base) AS base_at, len(segs) - 1 AS depth FROM t),
s AS (SELECT page_id, CASE WHEN starts_with(base, '1') THEN 900.0 - len(base) WHEN starts_with(t, '1') THEN 800.0 - len(t) WHEN strpos(base, '1') > 0 THEN 600.0 - (strpos(base, '1') - 1) - len(base) * 0.1
  WHEN strpos(t, '1') > 0 THEN 500.0 - (strpos(t, '1') - 1) - len(t) * 0.1 END AS kind,
  CASE WHEN starts_with(base, '1') THEN base_at WHEN starts_with(t, '1') THEN 0 WHEN strpos(base, '1') > 0 THEN base_at + strpos(base, '1') - 1 ELSE strpos(t, '1') - 1 END AS hit, base_at, depth, segs FROM k)
SELECT page_id, round(kind + CASE WHEN hit >= base_at THEN 20 ELSE 0 END - least(depth, 10) * 2
 + CASE WHEN depth = 4 AND array_to_string(segs[1:4], '/') = 'https://blog.therst.example.net/en' THEN 12 ELSE 0 END
 + 3 * (CASE WHEN segs[1] = 'https:' THEN 1 ELSE 0 END + CASE WHEN array_to_string(segs[1:2], '/') = 'https:/' AND depth >= 2 THEN 1 ELSE 0 END
 + CASE WHEN depth >= 3 AND array_to_string(segs[1:3], '/') = 'https://blog.therst.example.net' THEN 1 ELSE 0 END + CASE WHEN depth >= 4 AND array_to_string(segs[1:4], '/') = 'https://blog.therst.example.net/en' THEN 1 ELSE 0 END), 6) AS score
FROM s WHERE kind IS NOT NULL""")
def q05_path_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = path_score(F.col("url"), "1", current="https://blog.therst.example.net/en/53")
    return table(spark, sf_dir, "pages").select("page_id", F.round(score, 6).alias("score")).where("score > 0")


@R.add(f"""SELECT event_type, CASE WHEN ts >= date_trunc('day', {_NOW}) THEN 1.0 WHEN ts >= {_NOW} - INTERVAL 3 DAY THEN 0.75 WHEN ts >= {_NOW} - INTERVAL 7 DAY THEN 0.5 ELSE 0.25 END AS fresh,
CASE WHEN event_type = 'purchase' THEN 'agent' WHEN ts >= {_NOW} - INTERVAL 1 DAY THEN 'recent' ELSE 'project' END AS origin, CAST(count(*) AS BIGINT) AS n FROM events WHERE ts <= {_NOW} GROUP BY ALL""")
def q07_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp")
    origin = F.when(F.col("event_type") == "purchase", "agent").when(F.col("ts") >= now - F.expr("INTERVAL 1 DAY"), "recent").otherwise("project")
    seen = table(spark, sf_dir, "events").where(F.col("ts") <= now)
    return seen.groupBy("event_type", freshness(F.col("ts"), now).alias("fresh"), origin.alias("origin")).agg(F.count("*").alias("n"))


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, imports, refs): from the customer's nation to the supplier's, by line status."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linestatus")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.where("src <> dst").groupBy("src", "dst").agg(F.count_if(F.col("l_linestatus") == "O").alias("imports"), F.count_if(F.col("l_linestatus") == "F").alias("refs"))


EDGES = """edges AS (SELECT c_nationkey AS src, s_nationkey AS dst, CAST(count(*) FILTER (WHERE l_linestatus = 'O') AS BIGINT) AS imports, CAST(count(*) FILTER (WHERE l_linestatus = 'F') AS BIGINT) AS refs
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL)"""


@R.add(f"WITH {EDGES} SELECT * FROM edges")
def q10_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_edges(spark, sf_dir)


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """In and out degrees, and edge totals, of every node; both directions in one pass over the edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"), (F.col("imports") + F.col("refs")).alias("w"), "refs")
    sums = ends.groupBy("e.node").agg(
        F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"), F.sum(F.col("e.i") * F.col("w")).alias("inbound"), F.sum(F.col("e.o") * F.col("w")).alias("outbound"), F.sum(F.col("e.i") * F.col("refs")).alias("symbol_refs")
    )
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("in_degree", "out_degree", "inbound", "outbound", "symbol_refs")]
    return nodes.join(sums, "node", "left").select("node", *zero)


_DEGREES = """deg AS (SELECT n_nationkey AS node, CAST(coalesce(i.d, 0) AS BIGINT) AS in_degree, CAST(coalesce(o.d, 0) AS BIGINT) AS out_degree, CAST(coalesce(i.w, 0) AS BIGINT) AS inbound, CAST(coalesce(o.w, 0) AS BIGINT) AS outbound, CAST(coalesce(i.r, 0) AS BIGINT) AS symbol_refs
FROM nation LEFT JOIN (SELECT dst, count(*) AS d, sum(imports + refs) AS w, sum(refs) AS r FROM kept GROUP BY dst) i ON i.dst = n_nationkey LEFT JOIN (SELECT src, count(*) AS d, sum(imports + refs) AS w FROM kept GROUP BY src) o ON o.src = n_nationkey)"""


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))


@R.add(f"WITH {EDGES}, kept AS (SELECT * FROM edges), {_DEGREES} SELECT * FROM deg")
def q11_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degrees(nation_edges(spark, sf_dir), nations(spark, sf_dir))


def denoised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges without those that touch a test node: here, the nations of region 0."""
    tests = table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("node"))
    edges = nation_edges(spark, sf_dir)
    return edges.join(tests, edges["src"] == tests["node"], "left_anti").join(tests, F.col("dst") == tests["node"], "left_anti")


_KEPT = "tests AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 0), kept AS (SELECT * FROM edges WHERE src NOT IN (SELECT * FROM tests) AND dst NOT IN (SELECT * FROM tests))"


@R.add(f"WITH {EDGES}, {_KEPT}, {_DEGREES} SELECT * FROM deg")
def q12_denoised_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degrees(denoised(spark, sf_dir), nations(spark, sf_dir))


@R.add("""WITH once AS (SELECT p_name, p_size, p_brand FROM part GROUP BY ALL HAVING count(*) = 1)
SELECT p_partkey, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS users FROM part JOIN once USING (p_name, p_size, p_brand) JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey""")
def q13_unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_brand")
    once = part.groupBy("p_name", "p_size", "p_brand").agg(F.count("*").alias("n"), F.first("p_partkey").alias("p_partkey")).where("n = 1").select("p_partkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey")
    return lines.join(once, "p_partkey").groupBy("p_partkey").agg(F.count_distinct("l_suppkey").alias("users"))


@R.add("""WITH per AS (SELECT p_brand, p_type, p_size, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY ALL) SELECT p_brand, p_type, p_size, n FROM per WHERE n = 1""")
def q13_names_defined_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type", "p_size").agg(F.count("*").alias("n")).where("n = 1")


_HOT = ("in_degree", "inbound", "symbol_refs")


@R.add(f"WITH {EDGES}, {_KEPT}, {_DEGREES} " + " UNION ALL ".join(f"(SELECT '{m}' AS metric, node, {m} AS score FROM deg WHERE {m} > 0 ORDER BY {m} DESC, node LIMIT 5)" for m in _HOT))
def q14_hot_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in _HOT])).alias("m")
    long = degrees(denoised(spark, sf_dir), nations(spark, sf_dir)).select("node", metrics).select("m.metric", "node", "m.score").where("score > 0")
    order = Window.partitionBy("metric").orderBy(F.desc("score"), "node")
    return long.withColumn("r", F.row_number().over(order)).where("r <= 5").drop("r")


@R.add(f"""WITH {EDGES}, e AS (SELECT a.n_regionkey AS src, b.n_regionkey AS dst, imports, refs FROM edges JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst WHERE a.n_regionkey <> b.n_regionkey)
SELECT r_regionkey, r_name, CAST(coalesce((SELECT count(DISTINCT src) FROM e WHERE dst = r_regionkey), 0) AS BIGINT) AS in_dirs, CAST(coalesce((SELECT count(DISTINCT dst) FROM e WHERE src = r_regionkey), 0) AS BIGINT) AS out_dirs,
CAST(coalesce((SELECT sum(imports + refs) FROM e WHERE dst = r_regionkey), 0) AS BIGINT) AS inbound FROM region""")
def q15_region_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    a, b = nation.toDF("src", "from"), nation.toDF("dst", "to")
    rolled = nation_edges(spark, sf_dir).join(a, "src").join(b, "dst").where("`from` <> `to`").groupBy("from", "to").agg(F.sum(F.col("imports") + F.col("refs")).alias("w"))
    into = rolled.groupBy(F.col("to").alias("r_regionkey")).agg(F.count("*").alias("in_dirs"), F.sum("w").alias("inbound"))
    out = rolled.groupBy(F.col("from").alias("r_regionkey")).agg(F.count("*").alias("out_dirs"))
    joined = table(spark, sf_dir, "region").join(into, "r_regionkey", "left").join(out, "r_regionkey", "left")
    return joined.select("r_regionkey", "r_name", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("in_dirs", "out_dirs", "inbound")])


@R.add(f"""SELECT event_type, CASE WHEN ts >= date_trunc('day', {_NOW}) THEN 'today' WHEN ts >= {_NOW} - INTERVAL 3 DAY THEN '3d' WHEN ts >= {_NOW} - INTERVAL 7 DAY THEN '7d' ELSE 'older' END AS bucket, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL""")
def q18_time_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", age_bucket(F.col("ts"), F.lit(NOW).cast("timestamp")).alias("bucket")).agg(F.count("*").alias("n"))


@R.add("""SELECT strftime(ts, '%Y-%m-%d') AS day, max(ts) AS newest, CAST(count(*) AS BIGINT) AS n, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM events GROUP BY day""")
def q19_day_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return table(spark, sf_dir, "events").groupBy(day).agg(F.max("ts").alias("newest"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@R.add("SELECT props, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY props")
def q20_same_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("props").agg(F.count("*").alias("n"))


@R.add("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS last, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS first FROM conversations)
SELECT conv_id, role, max(turn) FILTER (WHERE last = 1) AS last_turn, max(text) FILTER (WHERE last = 1) AS last_text, max(turn) FILTER (WHERE first = 1) AS first_turn, max(text) FILTER (WHERE first = 1) AS first_text FROM r GROUP BY conv_id, role""")
def q21_last_and_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = lambda f: f(F.struct("turn", "text"))
    got = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(best(F.max).alias("l"), best(F.min).alias("f"))
    return got.select("conv_id", "role", F.col("l.turn").alias("last_turn"), F.col("l.text").alias("last_text"), F.col("f.turn").alias("first_turn"), F.col("f.text").alias("first_text"))


@R.add("""SELECT p_brand, p_partkey, p_retailprice, CAST(r AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3""")
def q22_top_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf_dir, "part").withColumn("place", F.row_number().over(order)).where("place <= 3").select("p_brand", "p_partkey", "p_retailprice", "place")


@R.add("""SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS idx FROM conversations WHERE NOT (turn = 0 AND role = 'system')""")
def q23_argument_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").where("NOT (turn = 0 AND role = 'system')").select("conv_id", "turn", (F.row_number().over(order) - 1).alias("idx"))


@R.add("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS header FROM events""")
def q24_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(line).alias("header"))


@R.add("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), g AS (SELECT *, date_diff('day', DATE '2000-01-01', day) - row_number() OVER (PARTITION BY user_id ORDER BY day) AS grp FROM d)
SELECT user_id, strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day, CAST(count(*) AS BIGINT) AS days FROM g GROUP BY user_id, grp""")
def q25_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    grouped = days.withColumn("grp", F.datediff("day", F.lit("2000-01-01").cast("date")) - F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return grouped.groupBy("user_id", "grp").agg(text(F.min("day")).alias("first_day"), text(F.max("day")).alias("last_day"), F.count("*").alias("days")).drop("grp")


@R.add("SELECT event_id, user_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_event FROM events")
def q26_next_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("next_event"))


@R.add("""WITH RECURSIVE s AS (SELECT user_id, epoch_ms(ts) AS a, epoch_ms(ts) + CAST(floor(value) AS BIGINT) * 60000 AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, event_id FROM events),
w AS (SELECT user_id, r, event_id, b AS upto, TRUE AS kept FROM s WHERE r = 1 UNION ALL SELECT s.user_id, s.r, s.event_id, CASE WHEN s.a >= w.upto THEN s.b ELSE w.upto END, s.a >= w.upto FROM w JOIN s ON s.user_id = w.user_id AND s.r = w.r + 1)
SELECT user_id, event_id FROM w WHERE kept""")
def q27_greedy_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-come spans that don't overlap an earlier kept one, by an ordered fold."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    spans = table(spark, sf_dir, "events").select("user_id", ms.alias("a"), (ms + F.floor("value") * 60000).alias("b"), "event_id", "ts")
    return folded(spans, ["user_id"], ["ts", "event_id"], lambda: Greedy(1), "event_id long")


@R.add("""SELECT 'without' AS side, c_custkey AS k FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'both', c_custkey FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)
UNION ALL SELECT 'any', k FROM (SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders)""")
def q28_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    side = lambda df, name: df.select(F.lit(name).alias("side"), "k")
    return side(c.subtract(o), "without").unionByName(side(c.intersect(o), "both")).unionByName(side(c.union(o).distinct(), "any"))


_INTERVALS = """iv AS (SELECT o_orderkey, o_custkey, o_orderdate AS a, max(l_shipdate) AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), pt AS (SELECT DISTINCT o_custkey, l_shipdate AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""


def intervals_and_points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each order from its date to its last shipment, and each customer's shipment dates."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("a"))
    ships = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("p"))
    joined = orders.join(ships, "o_orderkey")
    return joined.groupBy("o_orderkey", "o_custkey", "a").agg(F.max("p").alias("b")), joined.select("o_custkey", "p").distinct()


def points_in_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of both where a customer's date lies in an order's interval, by bins of days and wider ones."""
    spans, points = intervals_and_points(spark, sf_dir)
    micros = lambda df, *names: df.withColumns({f"_{n}": F.unix_micros(F.col(n).cast("timestamp")) for n in names})
    return stabbed(micros(points, "p"), micros(spans, "a", "b"), ["o_custkey"], "_p", "_a", "_b", narrowest=8 * 86_400_000_000)


@R.add(f"WITH {_INTERVALS} SELECT pt.o_custkey, strftime(p, '%Y-%m-%d') AS p, arg_max(o_orderkey, (a, o_orderkey)) AS inside FROM pt JOIN iv ON iv.o_custkey = pt.o_custkey AND a <= p AND p <= b GROUP BY ALL".replace("arg_max(o_orderkey, (a, o_orderkey))", "max_by(o_orderkey, struct_pack(a := a, k := o_orderkey))"))
def q29_innermost_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = points_in_intervals(spark, sf_dir)
    return met.groupBy("o_custkey", F.date_format("p", "yyyy-MM-dd").alias("p")).agg(F.max_by("o_orderkey", F.struct("a", "o_orderkey")).alias("inside"))


@R.add(f"WITH {_INTERVALS} SELECT pt.o_custkey, strftime(p, '%Y-%m-%d') AS p, min_by(o_orderkey, struct_pack(d := date_diff('day', a, b), k := o_orderkey)) AS smallest FROM pt JOIN iv ON iv.o_custkey = pt.o_custkey AND a <= p AND p <= b GROUP BY ALL")
def q30_smallest_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = points_in_intervals(spark, sf_dir)
    return met.groupBy("o_custkey", F.date_format("p", "yyyy-MM-dd").alias("p")).agg(F.min_by("o_orderkey", F.struct(F.datediff("b", "a"), "o_orderkey")).alias("smallest"))


@R.add("""WITH old AS (SELECT doc_id, n_chars, source FROM documents WHERE doc_id % 7 <> 0), new AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars, source FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(n.source, o.source) AS source, CAST(count(*) FILTER (WHERE o.doc_id IS NULL) AS BIGINT) AS added, CAST(count(*) FILTER (WHERE n.doc_id IS NULL) AS BIGINT) AS deleted, CAST(count(*) FILTER (WHERE o.n_chars <> n.n_chars) AS BIGINT) AS modified,
CAST(sum(coalesce(n.n_chars, 0) - coalesce(o.n_chars, 0)) AS BIGINT) AS delta FROM old o FULL JOIN new n ON o.doc_id = n.doc_id GROUP BY ALL""")
def q31_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.diff import snapshot_diff

    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    old = docs.where("doc_id % 7 <> 0")
    new = docs.where("doc_id % 11 <> 0").withColumn("n_chars", F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    changes = snapshot_diff(old, new, "doc_id", ["n_chars"])
    where = F.coalesce("new.source", "old.source").alias("source")
    return changes.groupBy(where).agg(F.count_if(F.col("status") == "A").alias("added"), F.count_if(F.col("status") == "D").alias("deleted"), F.count_if(F.col("status") == "M").alias("modified"), F.sum(F.coalesce("new.n_chars", F.lit(0)) - F.coalesce("old.n_chars", F.lit(0))).alias("delta"))


@R.add("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def q32_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(large, "p_partkey", "left_anti").select("p_partkey", "p_name")


@R.add("""SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 AND count(*) = count(l_returnflag) THEN max(l_returnflag) END AS agreed FROM lineitem GROUP BY l_orderkey""")
def q33_agree_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    agreed = F.when((F.min(flag) == F.max(flag)) & (F.count("*") == F.count(flag)), F.max(flag))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(agreed.alias("agreed"))


@R.add("""SELECT s_suppkey, CASE WHEN n_name IS NOT NULL AND n_nationkey % 3 = 0 THEN 'nation:' || n_name WHEN r_name IS NOT NULL AND r_regionkey % 2 = 0 THEN 'region:' || r_name ELSE 'world' END AS found
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def q44_nearest_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest scope that defines the name: the chain of scopes is exploded, candidates are joined, the nearest one wins."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    defs = nation.where("n_nationkey % 3 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("scope"), F.concat(F.lit("nation:"), "n_name").alias("def"))
    defs = defs.unionByName(region.where("r_regionkey % 2 = 0").select(F.concat(F.lit("r"), "r_regionkey").alias("scope"), F.concat(F.lit("region:"), "r_name").alias("def")))
    chain = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    chain = chain.select("s_suppkey", F.posexplode(F.array(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"))).alias("dist", "scope"))
    nearest = chain.join(defs, "scope").groupBy("s_suppkey").agg(F.min_by("def", "dist").alias("found"))
    return table(spark, sf_dir, "supplier").select("s_suppkey").join(nearest, "s_suppkey", "left").select("s_suppkey", F.coalesce("found", F.lit("world")).alias("found"))


@R.add("""WITH o AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM o)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, sid""")
def q47_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    return got.select("user_id", "first_ts", "last_ts", "n")


_PRIORITY = "CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 2 ELSE 1 END"


@R.add(f"""WITH o AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM o)
SELECT user_id, min(ts) AS first_ts, max_by(event_type, struct_pack(a := {_PRIORITY}, b := -event_id)) AS kind FROM s GROUP BY user_id, sid""")
def q48_coalesced_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest kind of change in a burst wins; of equal ones the first."""
    from ..streaming.changes import strongest

    got = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.min("ts").alias("first_ts"), strongest("event_type", _PRIORITY, "event_id").alias("kind"))
    return got.select("user_id", "first_ts", "kind")


@R.add("""WITH RECURSIVE s AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
w AS (SELECT user_id, r, event_id, ts AS anchor FROM s WHERE r = 1 UNION ALL SELECT s.user_id, s.r, s.event_id, CASE WHEN s.ts - w.anchor > INTERVAL 6 HOUR THEN s.ts ELSE w.anchor END FROM w JOIN s ON s.user_id = w.user_id AND s.r = w.r + 1)
SELECT user_id, anchor, CAST(count(*) AS BIGINT) AS n, max(event_id) AS last_event FROM w GROUP BY user_id, anchor""")
def q49_anchored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.changes import anchored_windows

    return anchored_windows(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 6 * 3600 * 1000)
