"""Change logs, merges and event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as H
from ..session import scratch
from ..sources import archive as A
from ..streaming import changes as SC
from ..streaming import windows as W
from .registry import Catalogue

C = Catalogue()

LOG = """c AS (SELECT event_id AS seq, 'events' AS tbl, user_id AS row_id, event_type AS col, value AS val, epoch_us(ts) // 1000 AS hlc_ts,
  coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS hlc_counter, 'site-' || (user_id % 3) AS site_id, event_id AS db_version FROM events)"""
WINNERS = "w AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY row_id, col ORDER BY hlc_ts DESC, hlc_counter DESC, site_id DESC, val DESC, seq DESC) = 1)"
CELLS = ("row_id", "col", "val", "hlc_ts", "hlc_counter")
LATEST = f"WITH {LOG}, {WINNERS} SELECT row_id, col, val, hlc_ts, hlc_counter FROM w"


@C.query("cdc_since", f"WITH {LOG} SELECT seq, row_id, col, val FROM c WHERE db_version > 500")
def cdc_since(spark, sf):
    return H.since(A.changes(spark, sf), 500).select("seq", "row_id", "col", "val")


@C.query("lww_latest", LATEST)
def lww_latest(spark, sf):
    return H.latest_cells(A.changes(spark, sf)).select(*CELLS)


@C.query("lww_merge_replicas", LATEST)
def lww_merge_replicas(spark, sf):
    """Two halves merged are the whole."""
    log = A.changes(spark, sf)
    return H.merge(log.where("seq % 2 = 0"), log.where("seq % 2 = 1")).select(*CELLS)


@C.query(
    "lww_to_apply",
    f"""WITH {LOG}, m AS (SELECT row_id, col, max((hlc_ts, hlc_counter, site_id)) AS newest FROM c WHERE seq % 2 = 0 GROUP BY row_id, col)
SELECT seq FROM c LEFT JOIN m USING (row_id, col) WHERE seq % 2 = 1 AND (newest IS NULL OR (hlc_ts, hlc_counter, site_id) > newest)""",
)
def lww_to_apply(spark, sf):
    log = A.changes(spark, sf)
    return H.to_apply(log.where("seq % 2 = 0"), log.where("seq % 2 = 1")).select("seq")


@C.query(
    "tombstone_apply",
    f"""WITH {LOG}, {WINNERS}, d AS (SELECT row_id, max((hlc_ts, hlc_counter, site_id)) AS dead FROM c WHERE col = 'error' AND row_id % 2 = 0 GROUP BY row_id),
n AS (SELECT row_id, max((hlc_ts, hlc_counter, site_id)) AS changed FROM w WHERE col <> 'error' GROUP BY row_id)
SELECT row_id, col, val, hlc_ts, hlc_counter FROM w WHERE col <> 'error' AND row_id NOT IN (SELECT row_id FROM d JOIN n USING (row_id) WHERE dead > changed)""",
)
def tombstone_apply(spark, sf):
    log = A.changes(spark, sf)
    cells = H.latest_cells(log.where("col <> 'error'"))
    return H.without_deleted(cells, log.where("col = 'error' AND row_id % 2 = 0")).select(*CELLS)


@C.query(
    "row_expand_unpivot",
    "SELECT 'customer' AS tbl, c_custkey AS row_id, col, val FROM (SELECT c_custkey, c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer) UNPIVOT (val FOR col IN (c_name, c_mktsegment, c_nationkey))",
)
def row_expand_unpivot(spark, sf):
    return H.from_rows(A.read(spark, sf, "customer"), "c_custkey", "customer", ["c_name", "c_mktsegment", "c_nationkey"])


KINDS = ["view", "click", "purchase", "signup", "error"]


@C.query(
    "pivot_from_changes",
    f"WITH {LOG}, {WINNERS} SELECT row_id, " + ", ".join(f"max(val) FILTER (col = '{k}') AS \"{k}\"" for k in KINDS) + " FROM w GROUP BY row_id",
)
def pivot_from_changes(spark, sf):
    return H.to_rows(H.latest_cells(A.changes(spark, sf)), KINDS)


@C.query(
    "snapshot_diff",
    """WITH o AS (SELECT * FROM customer WHERE c_custkey % 10 <> 1), n AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal + (CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END) AS c_acctbal,
  CASE WHEN c_custkey % 11 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 10 <> 2),
j AS (SELECT coalesce(o.c_custkey, n.c_custkey) AS row_id, o.c_custkey IS NULL AS added, n.c_custkey IS NULL AS gone,
  array_to_string(list_filter([CASE WHEN o.c_acctbal <> n.c_acctbal THEN 'c_acctbal' END, CASE WHEN o.c_mktsegment <> n.c_mktsegment THEN 'c_mktsegment' END], lambda x: x IS NOT NULL), ',') AS cols
  FROM o FULL JOIN n ON o.c_custkey = n.c_custkey)
SELECT row_id, CASE WHEN added THEN 'insert' WHEN gone THEN 'delete' ELSE 'update' END AS kind, CASE WHEN added OR gone THEN '' ELSE cols END AS columns FROM j WHERE added OR gone OR cols <> ''""",
)
def snapshot_diff(spark, sf):
    c = A.read(spark, sf, "customer")
    after = c.where("c_custkey % 10 <> 2").withColumns(
        {"c_acctbal": F.col("c_acctbal") + F.when(F.col("c_custkey") % 7 == 0, 1).otherwise(0), "c_mktsegment": F.when(F.col("c_custkey") % 11 == 0, "NEW").otherwise(F.col("c_mktsegment"))}
    )
    return H.diff(c.where("c_custkey % 10 <> 1"), after, "c_custkey", ["c_acctbal", "c_mktsegment"])


PEERS = "p AS (SELECT 'site-' || (user_id % 3) AS id, max(event_id) - 100 * (user_id % 3) AS last_db_version FROM events GROUP BY user_id % 3)"


def peers(spark, sf):
    e = A.read(spark, sf, "events").groupBy((F.col("user_id") % 3).alias("k")).agg(F.max("event_id").alias("v"))
    return e.select(F.concat(F.lit("site-"), F.col("k")).alias("id"), (F.col("v") - 100 * F.col("k")).alias("last_db_version"))


@C.query("peer_cursors", f"WITH {PEERS} SELECT id, greatest(last_db_version, CASE id WHEN 'site-1' THEN 1000000 ELSE 0 END) AS last_db_version FROM p UNION ALL SELECT 'site-9', 5")
def peer_cursors(spark, sf):
    return H.update_cursors(peers(spark, sf), spark.createDataFrame([("site-1", 1_000_000), ("site-9", 5)], "id string, last_db_version long"))


@C.query("compact_log", f"WITH {LOG}, {PEERS} SELECT seq, col FROM c WHERE db_version >= (SELECT min(last_db_version) FROM p)")
def compact_log(spark, sf):
    return H.compacted(A.changes(spark, sf), peers(spark, sf)).select("seq", "col")


@C.query("prune_tombstones", f"WITH {LOG} SELECT seq FROM c WHERE col = 'error' AND hlc_ts >= 1705000000000")
def prune_tombstones(spark, sf):
    return H.pruned(A.changes(spark, sf).where("col = 'error'"), 1_705_000_000_000).select("seq")


@C.query(
    "stream_tumbling",
    "SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def stream_tumbling(spark, sf):
    return W.drained(W.tumbling(W.event_stream(spark, sf)), "tumbling")


@C.query(
    "stream_sliding",
    "SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) - 3600 * k AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(2) r(k) GROUP BY 1, 2",
)
def stream_sliding(spark, sf):
    return W.drained(W.sliding(W.event_stream(spark, sf)), "sliding")


@C.query(
    "stream_session",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, CAST(floor(epoch(max(ts) + INTERVAL 30 MINUTE)) AS BIGINT) AS end_s, count(*) AS n FROM s GROUP BY user_id, k""",
)
def stream_session(spark, sf):
    return W.drained(W.sessions(W.event_stream(spark, sf)), "session")


@C.query("stream_lww", LATEST)
def stream_lww(spark, sf):
    """The feed followed to its end."""
    path = scratch(spark, "follow")
    log = SC.stream_of_changes(spark, sf)
    query = SC.follow(log, f"{path}/state", f"{path}/checkpoint")
    query.awaitTermination()
    return SC.state(spark, f"{path}/state", query, log.schema).select(*CELLS)
