"""Registered queries over event logs and registries, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import registry as R
from ..operators import stats, windows
from .catalog import query

_STATE = "(SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous_state, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events)"


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query("registry_latest", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(ts, event_id) AS ts FROM events GROUP BY user_id")
def registry_latest(spark, sf_dir):
    return E.latest(_read(spark, sf_dir, "events"), "user_id", ["event_id"], ["event_id", "event_type", "ts"])


@query("registry_reconstruction", "SELECT r.event_id AS log_order, r.user_id AS resume_name, l.event_type AS status FROM (SELECT * FROM events WHERE event_type = 'signup') r JOIN (SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY user_id) l ON r.user_id = l.user_id")
def registry_reconstruction(spark, sf_dir):
    """Sign-ups register, purchases change status; the log's own order decides."""
    kind = F.when(F.col("event_type") == "signup", "registration").when(F.col("event_type") == "purchase", "status_change").otherwise("logged_activity")
    log = _read(spark, sf_dir, "events").select(F.col("event_id").alias("log_order"), F.col("user_id").alias("resume_name"), kind.alias("event_type"), F.col("event_type").alias("status"), F.col("event_type").alias("new_status"), F.lit("user").alias("resume_type"), F.col("event_id").alias("timestamp"))
    return E.reconstruct(log).select("log_order", "resume_name", "status")


@query("chronology_violations", "SELECT o_custkey, o_orderkey, o_orderdate, previous FROM (SELECT *, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders) WHERE o_orderdate < previous")
def chronology_violations(spark, sf_dir):
    return E.chronology_violations(_read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderdate").select("o_custkey", "o_orderkey", "o_orderdate", "previous")


@query("status_timeline", f"SELECT event_id, user_id, event_type, previous_state, place FROM {_STATE}")
def status_timeline(spark, sf_dir):
    return E.timeline(_read(spark, sf_dir, "events"), "user_id", "event_id", "event_type").select("event_id", "user_id", "event_type", "previous_state", "place")


@query("status_discontinuities", "SELECT event_id, user_id, place, expected FROM (SELECT *, lag(n) OVER (PARTITION BY user_id ORDER BY event_id) AS expected, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM (SELECT event_id, user_id, event_type AS n, CASE WHEN event_id % 3 = 0 THEN 'view' ELSE 'click' END AS o FROM events)) WHERE place > 0 AND expected IS DISTINCT FROM o")
def status_discontinuities(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("new_status"), F.when(F.col("event_id") % 3 == 0, "view").otherwise("click").alias("old_status"))
    return E.discontinuities(rows, "user_id", "event_id").select("event_id", "user_id", "place", "expected")


@query("recent_events_n", "SELECT event_id, event_type, user_id FROM events WHERE event_type = 'purchase' ORDER BY event_id DESC LIMIT 25")
def recent_events_n(spark, sf_dir):
    return E.recent(_read(spark, sf_dir, "events"), ["event_id"], 25, event_type="purchase", user_id=None).select("event_id", "event_type", "user_id")


@query("registry_counts", 'SELECT "by", value, n FROM (SELECT NULL AS "by", NULL AS value, count(*) AS n FROM orders UNION ALL SELECT \'o_orderstatus\', o_orderstatus, count(*) FROM orders GROUP BY 2 UNION ALL SELECT \'o_orderpriority\', o_orderpriority, count(*) FROM orders GROUP BY 2)')
def registry_counts(spark, sf_dir):
    return R.counts(_read(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query("most_recent_approved", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 1")
def most_recent_approved(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status")
    return R.most_recent(rows, "F", "o_orderkey", "o_orderdate").select("o_orderkey", "o_orderdate")


@query("register_new_only", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY o_custkey")
def register_new_only(spark, sf_dir):
    known = _read(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"))
    fresh, _ = R.register_new(known, _read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")
    return fresh


@query("register_summary", "SELECT (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey % 2 = 1) AS added, (SELECT count(*) FROM orders) - (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey % 2 = 1) AS skipped")
def register_summary(spark, sf_dir):
    known = _read(spark, sf_dir, "orders").filter("o_custkey % 2 = 0").select("o_custkey")
    return R.register_new(known, _read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")[1]


@query("status_update", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'approved' ELSE o_orderstatus END AS status FROM orders")
def status_update(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("last_updated"))
    updates = orders.filter("o_orderkey % 5 = 0").select("o_orderkey", F.lit("approved").alias("status"))
    return R.update_status(orders, updates, "o_orderkey", F.lit("2026-01-01").cast("timestamp"))[0].select("o_orderkey", "status")


@query("status_gate_filter", "SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE CASE o_orderpriority WHEN '1-URGENT' THEN o_orderstatus = 'F' WHEN '5-LOW' THEN o_orderstatus IN ('O', 'P') ELSE true END")
def status_gate_filter(spark, sf_dir):
    gates = {"1-URGENT": ("F",), "5-LOW": ("O", "P")}
    return R.gated(_read(spark, sf_dir, "orders"), gates, "o_orderpriority", "o_orderstatus").select("o_orderkey", "o_orderpriority", "o_orderstatus")


@query("name_search_glob", "SELECT c_custkey, c_name FROM customer WHERE regexp_full_match(lower(c_name), 'customer#.*[13]5')")
def name_search_glob(spark, sf_dir):
    return R.search_names(_read(spark, sf_dir, "customer"), "c_name", "CUSTOMER#*[13]5", ignore_case=True).select("c_custkey", "c_name")


@query("config_doc_counts", "SELECT n_nationkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_nationkey")
def config_doc_counts(spark, sf_dir):
    return stats.counts_with_zero(_read(spark, sf_dir, "nation"), "n_nationkey", _read(spark, sf_dir, "supplier"), "s_nationkey")


@query("registry_diff", "SELECT coalesce(a.p, b.p) AS o_orderpriority, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right FROM (SELECT o_orderpriority AS p, count(*) AS n_left FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT o_orderpriority AS p, count(*) AS n_right FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) b ON a.p = b.p WHERE coalesce(n_left, 0) <> coalesce(n_right, 0)")
def registry_diff(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders")
    return R.difference(orders.filter("o_orderkey % 2 = 0"), orders.filter("o_orderkey % 2 = 1"), "o_orderpriority")


@query("field_value_enumeration", "SELECT 'k' AS field, json_extract_string(props, '$.k') AS value, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 2")
def field_value_enumeration(spark, sf_dir):
    fields = F.from_json("props", "map<string,string>")
    return stats.field_values(_read(spark, sf_dir, "events"), fields)


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("percent_of_total", "SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM events GROUP BY event_type")
def percent_of_total(spark, sf_dir):
    return stats.percent_of_total(stats.distribution(_read(spark, sf_dir, "events"), "event_type"))


@query("anchored_clusters", "WITH RECURSIVE v AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS r FROM events WHERE value IS NOT NULL), c AS (SELECT user_id, r, value, value AS anchor, 0 AS cluster FROM v WHERE r = 1 UNION ALL SELECT v.user_id, v.r, v.value, CASE WHEN v.value - c.anchor > 25.0 THEN v.value ELSE c.anchor END, CASE WHEN v.value - c.anchor > 25.0 THEN c.cluster + 1 ELSE c.cluster END FROM c JOIN v ON v.user_id = c.user_id AND v.r = c.r + 1) SELECT user_id, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, min(value) AS first_value FROM c GROUP BY ALL")
def anchored_clusters(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").filter("value is not null").groupBy("user_id").agg(F.sort_array(F.collect_list("value")).alias("v"))
    zipped = F.arrays_zip(F.col("v").alias("value"), windows.anchored_clusters(F.col("v"), 25.0).alias("cluster"))
    return rows.select("user_id", F.inline(zipped)).groupBy("user_id", F.col("cluster").cast("long").alias("cluster")).agg(F.count("*").alias("n"), F.min("value").alias("first_value"))
