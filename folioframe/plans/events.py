"""Queries over events: progress, logs, sessions; star-schema extensions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import progress
from .registry import query, table

_AT = "epoch(ts)::DOUBLE"


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("at", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts) / 1e6"))


@query("SELECT event_type, round(w / sum(w) OVER (), 6) AS weight FROM (SELECT event_type, count(*) * 1.5 AS w FROM events WHERE event_type <> 'error' GROUP BY ALL)")
def q_stages(spark, sf):
    """ST-STAGES."""
    each = table(spark, sf, "events").groupBy("event_type").agg((F.count(F.lit(1)) * 1.5).cast("double").alias("weight"))
    return progress.weights(each, F.col("event_type") != "error").select("event_type", F.round("weight", 6).alias("weight"))


@query("""WITH w AS (SELECT event_type, count(*)::DOUBLE / sum(count(*)) OVER () AS weight FROM events GROUP BY ALL) SELECT user_id, round(sum(weight * done) * 100 / 4 + (user_id % 4) * 100.0 / 4, 6) AS overall FROM (SELECT user_id, event_type, count(*)::DOUBLE / (count(*) + 5) AS done FROM events GROUP BY ALL) JOIN w USING (event_type) GROUP BY user_id""")
def q_progress(spark, sf):
    """A-PROGRESS, ST-PARTS."""
    e = table(spark, sf, "events")
    w = progress.weights(e.groupBy("event_type").agg(F.count(F.lit(1)).cast("double").alias("weight")), F.lit(True))
    done = e.groupBy("user_id", "event_type").agg((F.count(F.lit(1)).cast("double") / (F.count(F.lit(1)) + 5)).alias("done")).join(w, "event_type")
    return progress.overall(done.withColumns({"part": F.col("user_id") % 4, "parts": F.lit(4)}), ["user_id"]).select("user_id", F.round("overall", 6).alias("overall"))


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, {_AT} AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), r AS (SELECT user_id, event_id, k, tm AS last, true AS out FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN e.tm - r.last >= 36000 THEN e.tm ELSE r.last END, e.tm - r.last >= 36000 FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) SELECT user_id, event_id FROM r WHERE out""")
def q_throttle(spark, sf):
    """ST-THROTTLE, with ten hours for the interval."""
    return progress.throttle(_events(spark, sf), ["user_id"], "event_id", F.col("at"), 36_000.0)


@query("SELECT event_id, event_type FROM events WHERE event_id > (SELECT quantile_disc(event_id, 0.5) FROM events WHERE event_id % 1 = 0) AND event_id >= 10")
def q_replay(spark, sf):
    """ST-REPLAY, ST-LOG."""
    e = table(spark, sf, "events").withColumn("sequence", F.col("event_id"))
    cursor = e.agg(F.expr("percentile_disc(0.5) within group (order by event_id)")).first()[0]
    return progress.replay(e, int(cursor), 10).select("event_id", "event_type")


@query("""SELECT user_id, event_id FROM (SELECT *, coalesce(max((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM events) WHERE done = 0""")
def q_terminal(spark, sf):
    """ST-TERMINAL."""
    return progress.until_terminal(table(spark, sf, "events"), ["user_id"], "event_id", F.col("event_type") == "purchase").select("user_id", "event_id")


@query("SELECT CASE WHEN sum((length(text) < 600)::INT) >= greatest(0.8 * count(*), 1) THEN true ELSE false END AS scanned, lang FROM documents GROUP BY lang")
def q_scanned(spark, sf):
    """A-SCANNED: the order-free verdict."""
    few = F.sum((F.length("text") < 600).cast("int"))
    return table(spark, sf, "documents").groupBy("lang").agg((few >= F.greatest(0.8 * F.count(F.lit(1)), F.lit(1))).alias("scanned"))


@query("SELECT user_id, sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END)::BIGINT AS prompt, sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END)::BIGINT AS completion, sum(value)::BIGINT AS total FROM (SELECT user_id, event_type, floor(value) AS value FROM events) GROUP BY user_id")
def q_token_totals(spark, sf):
    """A-TOKENS."""
    e = table(spark, sf, "events").withColumn("value", F.floor("value"))
    some = lambda k: F.sum(F.when(F.col("event_type") == k, F.col("value")).otherwise(0))
    return e.groupBy("user_id").agg(some("view").alias("prompt"), some("click").alias("completion"), F.sum("value").alias("total"))


@query("""SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 3 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def x_session(spark, sf):
    """Extension: sessions of a user by gaps of three hours."""
    from ..operators.ordered import runs

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _events(spark, sf)
    new = F.coalesce(F.col("at") - F.lag("at").over(w) > 10_800, F.lit(True))
    ranked = e.withColumns({"new": new, "k": F.row_number().over(w)})
    return runs(ranked, ["user_id"], "k", F.col("new"), "s").groupBy("user_id", "s").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n")).drop("s")


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def x_pricing(spark, sf):
    """Extension: pricing summary; the date reaches the scan."""
    price = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return table(spark, sf, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(price, 2).alias("revenue"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count(F.lit(1)).alias("n"))


@query("""SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def x_join_revenue(spark, sf):
    """Extension: five tables joined."""
    t = lambda n: table(spark, sf, n)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def x_cube(spark, sf):
    """Extension: cube."""
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS rank, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dense FROM orders")
def x_rank(spark, sf):
    """Extension: ranking windows."""
    w = Window.partitionBy("o_custkey")
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.rank().over(w.orderBy(F.desc("o_totalprice"))).cast("long").alias("rank"), F.dense_rank().over(w.orderBy("o_orderpriority")).cast("long").alias("dense"))


@query("SELECT c_mktsegment, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k <= 10")
def x_topk(spark, sf):
    """Extension: the ten largest of each group."""
    at = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return table(spark, sf, "customer").withColumn("k", at).where("k <= 10").select("c_mktsegment", "c_custkey", "c_acctbal")


@query("(SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def x_setops(spark, sf):
    """Extension: intersect and except; U-PAGES-COMPLEMENT, U-ID-SET-EQ by the same operators."""
    t = lambda n: table(spark, sf, n)
    return t("customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").select("s_nationkey")).subtract(t("nation").where("n_regionkey = 0").select("n_nationkey"))
