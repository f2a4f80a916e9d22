"""Questions about git outputs. The tables hold none, so each order is written out as a commit of its line items and read back.

The SQL is what the keys say, without the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import git_texts as git
from .base import Registry, table

R = Registry()

_AT = "(1600000000 + l_orderkey) * 1000"
_PATH = "'src/' || l_partkey || '.py'"
_LETTER = "CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'R' THEN 'R' ELSE 'M' END"


def _join(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _path(item: Column, folder: str = "src") -> Column:
    return _join(folder + "/", item["l_partkey"], ".py")


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, items) with an order's line items, a handful, in a fixed order."""
    items = table(spark, sf_dir, "lineitem").withColumn("n", F.floor("l_quantity").cast("long"))
    return items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "n", "l_returnflag", "l_linestatus"))).alias("items"))


def _lines(line) -> Column:
    return F.array_join(F.transform("items", line), "\n")


def _name_status(i: Column) -> Column:
    return F.when(i["l_returnflag"] == "R", _join("R090\t", _path(i, "old"), "\t", _path(i))).otherwise(_join(F.when(i["l_returnflag"] == "A", "A").otherwise("M"), "\t", _path(i)))


def _rev(key: str | Column) -> Column:
    return F.md5((F.col(key) if isinstance(key, str) else key).cast("string"))


@R.add(f"SELECT l_orderkey, md5(CAST(l_orderkey AS VARCHAR)) AS rev, CAST({_AT} AS BIGINT) AS at, {_LETTER} AS status, {_PATH} AS path FROM lineitem")
def q70_commit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _join(_rev("l_orderkey"), "\x02", F.col("l_orderkey") + 1600000000, "\x02someone\x02order ", F.col("l_orderkey"), "\n", _lines(_name_status), "\n\n")
    found = git.history(_commits(spark, sf_dir).select("l_orderkey", text.alias("text")), ["l_orderkey"])
    return found.select("l_orderkey", "rev", "at", "status", "path")


@R.add(f"""SELECT l_orderkey, {_LETTER} AS status, {_PATH} AS path, CASE WHEN l_returnflag = 'R' THEN 'old/' || l_partkey || '.py' END AS "from", CASE WHEN l_linestatus <> 'F' THEN CAST(floor(l_quantity) AS BIGINT) END AS added, CASE WHEN l_linestatus <> 'F' THEN CAST(l_linenumber AS BIGINT) END AS removed, l_linestatus = 'F' AS "binary" FROM lineitem""")
def q71_commit_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda i: F.when(i["l_linestatus"] == "F", _join("-\t-\t", _path(i))).otherwise(_join(i["n"], "\t", i["l_linenumber"], "\t", _path(i)))
    texts = _commits(spark, sf_dir).select("l_orderkey", _lines(_name_status).alias("names"), _lines(count).alias("counts"))
    return git.commit_changes(texts, ["l_orderkey"]).drop("pos")


@R.add("""WITH c AS (SELECT o_custkey, min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders GROUP BY 1) SELECT o_custkey, md5(CAST(o_orderkey AS VARCHAR)) AS rev, substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 7) AS short_rev, CAST((1600000000 + o_orderkey) * 1000 AS BIGINT) AS at, o_orderpriority AS author,
CAST(CASE WHEN o_orderkey = a THEN 0 ELSE 1 END AS INTEGER) AS parents, concat_ws(' ', CASE WHEN o_orderkey = b THEN 'main:branch:true' END, CASE WHEN o_orderkey = a THEN 'v1:tag:false' END) AS refs FROM orders JOIN c USING (o_custkey)""")
def q72_log_with_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    ends = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"))
    parents = F.when(F.col("o_orderkey") == F.col("a"), "").otherwise(_rev(F.col("o_orderkey") - 1))
    line = _join(_rev("o_orderkey"), "\x02", F.substring(_rev("o_orderkey"), 1, 7), "\x02", parents, "\x02", F.col("o_orderkey") + 1600000000, "\x02", F.col("o_orderpriority"), "\x02an order")
    commits = git.log(orders.join(ends, "o_custkey").select("o_custkey", line.alias("text")), ["o_custkey"])
    text = _join(_rev("b"), "\x02refs/heads/main\n", _rev("a"), "\x02refs/tags/v1\n", _rev("a"), "\x02refs/stash\n")
    named = git.refs(ends.select("o_custkey", F.lit("main").alias("head"), text.alias("text")), ["o_custkey"])
    found = git.log_with_refs(commits, named, ["o_custkey"])
    shown = F.array_join(F.transform("refs", lambda r: F.concat_ws(":", r["name"], r["type"], r["is_head"].cast("string"))), " ")
    return found.select("o_custkey", "rev", "short_rev", "at", "author", F.size("parent_ids").alias("parents"), shown.alias("refs"))


@R.add("""SELECT l_orderkey, 'src/' || l_partkey || '.py' AS file, CASE WHEN max(l_returnflag) = 'R' THEN 'old/' || l_partkey || '.py' END AS "from", CASE max(l_returnflag) WHEN 'A' THEN 'added' WHEN 'R' THEN 'renamed' ELSE 'modified' END AS status, CASE max(l_returnflag) WHEN 'A' THEN 'A' WHEN 'R' THEN 'A' ELSE 'M' END AS change,
CASE WHEN max(l_linestatus) = 'F' THEN CAST(count(*) AS BIGINT) END AS added, CASE WHEN max(l_linestatus) = 'F' THEN CAST(7 AS BIGINT) END AS removed, CASE WHEN max(l_linestatus) = 'F' THEN FALSE END AS "binary" FROM lineitem GROUP BY l_orderkey, l_partkey""")
def q73_status_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("state"), F.count("*").alias("n"))
    grouped = files.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", "flag", "state", "n"))).alias("items"))
    state = lambda i: F.when(i["flag"] == "R", _join("R  ", _path(i, "old"), " -> ", _path(i))).when(i["flag"] == "A", _join('?? "', _path(i), '"')).otherwise(_join(" M ", _path(i)))
    count = lambda i: _join(i["n"], "\t7\t", F.when(i["flag"] == "R", _join("{old => src}/", i["l_partkey"], ".py")).otherwise(_path(i)))
    counted = F.array_join(F.transform(F.filter("items", lambda i: i["state"] == "F"), count), "\n")
    changed = git.status(grouped.select("l_orderkey", _lines(state).alias("text")), ["l_orderkey"])
    return git.status_with_counts(changed, git.numstat(grouped.select("l_orderkey", counted.alias("text")), ["l_orderkey"]), ["l_orderkey"]).drop("pos")


@R.add("""SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS INTEGER) AS line, md5(CAST(l_partkey AS VARCHAR)) AS rev, 'Part ' || l_partkey AS author, l_partkey || '@example.org' AS email, CAST(l_partkey * 1000 AS BIGINT) AS at, 'made' AS summary FROM lineitem""")
def q74_blame(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = lambda i, k: _join(_rev(i["l_partkey"]), " 1 ", k + 1, " 1\nauthor Part ", i["l_partkey"], "\nauthor-mail <", i["l_partkey"], "@example.org>\nauthor-time ", i["l_partkey"], "\nauthor-tz +0000\nsummary made\nfilename a.py\n\tcode author x")
    return git.blame(_commits(spark, sf_dir).select("l_orderkey", _lines(record).alias("text")), ["l_orderkey"])


@R.add(f"SELECT l_orderkey, CAST({_AT} AS BIGINT) AS at, 'order ' || l_orderkey AS label, CAST(count(*) AS INTEGER) AS files FROM lineitem GROUP BY l_orderkey")
def q75_commit_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _join("\x01", F.col("l_orderkey") + 1600000000, "\x02order ", F.col("l_orderkey"), "\n", _lines(lambda i: _path(i)), "\n\n")
    return git.batches(_commits(spark, sf_dir).select("l_orderkey", text.alias("text")), ["l_orderkey"]).select("l_orderkey", "at", "label", F.size("files").alias("files"))


@R.add("""SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS old_start, CAST(floor(l_quantity) AS INTEGER) AS old_count, CAST(l_partkey AS INTEGER) AS new_start, CAST(1 AS INTEGER) AS new_count, 'def f():' AS heading FROM lineitem""")
def q76_diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    hunk = lambda i: _join("@@ -", i["l_linenumber"], ",", i["n"], " +", i["l_partkey"], " @@ def f():\n-a\n+@@ b")
    text = _join("--- a/x\n+++ b/x\n", _lines(hunk))
    return git.hunks(_commits(spark, sf_dir).select("l_orderkey", text.alias("text")), ["l_orderkey"]).drop("line")
