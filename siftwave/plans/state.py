"""Queries over versioned tables, re-delivered days, progress events, long tables and spans, and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siftwave.operators import lookup as L
from siftwave.operators import compare as C
from siftwave.operators.progress import Pages, merge_progress
from siftwave.operators.spans import candidate_spans as spans_of
from siftwave.plans.registry import DAY_SQL, JOIN_SQL, daily_files, metrics_sql, query, table
from siftwave.sources.files import scratch_path
from siftwave.sources.snapshots import SnapshotTable
from siftwave.streaming import daily


def own_folder(spark, name):
    return f"{scratch_path(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS count FROM events GROUP BY 1")
def snapshot_counters(spark, d):
    """Counters of users after five updates, one of which comes twice."""
    kinds = ("click", "error", "purchase", "signup", "view")
    events = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), "event_type")
    counters = SnapshotTable(spark, own_folder(spark, "counters"), "key string, count long", "key")
    for n, kind in enumerate((*kinds[:2], kinds[1], *kinds[2:])):
        rows = events.filter(~F.col("event_type").isin(*kinds[:-1])) if kind == kinds[-1] else events.filter(F.col("event_type") == kind)
        counters.commit(rows, lambda old, new: L.count_upsert(old, new, "key"), "events", n if n < 2 else n - 1)
    return counters.read()


@query(
    """SELECT CAST(o_custkey AS VARCHAR) AS key, o_orderkey AS last_order, o_orderdate AS seen FROM
(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1"""
)
def snapshot_newest(spark, d):
    """The newest order of each customer, taken over in two halves."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").cast("long").alias("last_order"), F.col("o_orderdate").alias("seen"))
    kind = rows.schema["seen"].dataType.simpleString()
    newest = SnapshotTable(spark, own_folder(spark, "newest"), f"key string, last_order long, seen {kind}", "key")
    for n in (1, 0):
        newest.commit(rows.filter(F.col("last_order") % 2 == n), lambda old, new: L.keep_newest(old.unionByName(new), "key", "seen", "last_order"))
    return newest.read()


@query(
    f"""WITH {JOIN_SQL}, {DAY_SQL}, s AS (SELECT date, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(CASE WHEN CAST(date AS INT) % 2 = 0 THEN fp ELSE fp + 3 END) AS BIGINT) AS fp,
CAST(sum(tn) AS BIGINT) AS tn, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM g GROUP BY date), {metrics_sql('s', 'CAST(date AS VARCHAR) AS date, sources,')}"""
)
def redelivered_days(spark, d):
    """All days are delivered with three false alarms too many, then the even ones again and right."""
    files, path = daily_files(spark, d), own_folder(spark, "days")
    sent = lambda df, day: df.withColumn("delivered", F.to_timestamp(F.lit(f"2026-03-0{day} 00:00:00")))
    daily.deliver(sent(files.withColumn("fp", F.col("fp") + 3), 1), path)
    daily.deliver(sent(files.filter(F.col("date").cast("int") % 2 == 0), 2), path)
    return spark.read.parquet(f"{path}/trend").withColumn("date", F.col("date").cast("string"))


@query(
    """WITH e AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS message, CASE WHEN event_type NOT IN ('view', 'click') THEN event_type || CAST(floor(value / 10) AS INT) END AS reason FROM events),
l AS (SELECT *, sum(CASE WHEN reason IS NULL THEN 1 ELSE -1 END) OVER (PARTITION BY message ORDER BY seq) AS level FROM e),
c AS (SELECT *, reason IS NOT NULL AND level >= least(0, coalesce(min(level) OVER (PARTITION BY message ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS claims,
        row_number() OVER (PARTITION BY message, reason ORDER BY seq) AS nth FROM l),
p AS (SELECT message, seq, row_number() OVER (PARTITION BY message ORDER BY seq) AS n FROM c WHERE reason IS NULL),
r AS (SELECT message, seq, reason, row_number() OVER (PARTITION BY message ORDER BY seq) AS n FROM c WHERE claims)
SELECT p.seq AS log, p.message, r.seq AS result, r.reason FROM p LEFT JOIN r ON r.message = p.message AND r.n = p.n
UNION ALL SELECT seq, message, seq, reason FROM c WHERE reason IS NOT NULL AND NOT claims AND nth = 1"""
)
def progress_logs(spark, d):
    """Views and clicks of a user wait for a result; other events are results."""
    reason = F.when(~F.col("event_type").isin("view", "click"), F.concat("event_type", F.floor(F.col("value") / 10).cast("int").cast("string")))
    return merge_progress(table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("message"), reason.alias("reason")))


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS pos FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice, pos FROM r WHERE (pos - 1) // 40 = (SELECT count(*) // 80 FROM lineitem)"""
)
def deep_page(spark, d):
    """The page in the middle of all line items by price, forty to a page."""
    pages = Pages(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), -F.col("l_extendedprice"), "l_orderkey", "l_linenumber")
    return pages.page(pages.total // 80 + 1, 40)


@query(
    f"""WITH {JOIN_SQL}, {DAY_SQL}, s AS (SELECT date, coalesce(source, 'all') AS source, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(tn) AS BIGINT) AS tn
FROM g GROUP BY GROUPING SETS ((date, source), (date))), {metrics_sql('s', 'date, source,')}"""
)
def day_metrics(spark, d):
    """Agreement of each day by source, and of the day as a whole."""
    return C.agreement(C.day_totals(daily_files(spark, d)))


@query()
def candidate_spans(spark, d):
    """The five best candidates of every document with their original spans, through the table function."""
    return spans_of(table(spark, d, "documents"), "doc_id", "text")
