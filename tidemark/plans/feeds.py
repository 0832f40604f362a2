"""Graph, ranking, change and quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import changes, graph, quality, ranking
from tidemark.plans.base import REGISTER_SQL, Tables, query, register


def nodes(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_partkey").alias("ord"),
        F.concat("p_name", F.lit(" "), "p_partkey").alias("title"),
        F.concat(F.lit("j"), F.col("p_size") % 9).alias("jurisdiction"),
        F.array(F.initcap("p_name"), "p_brand", "p_type").alias("tags"),
        F.when(F.col("p_partkey") % 10 == 0, F.col("p_partkey") + 7).alias("superseded_by"),
    )


NODES_SQL = """n AS (SELECT p_partkey AS id, 'j' || (p_size % 9) AS j, [lower(p_name), lower(p_brand), lower(p_type)] AS tags, p_name || ' ' || p_partkey AS title, CASE WHEN p_partkey % 10 = 0 THEN p_partkey + 7 END AS s FROM part),
e AS (SELECT * FROM (SELECT a.id AS source, b.id AS target, (a.tags[1] = b.tags[1])::INT + (a.tags[2] = b.tags[2])::INT + (a.tags[3] = b.tags[3])::INT AS weight, a.j <> b.j AS crossing FROM n a JOIN n b ON a.id < b.id) WHERE weight >= CASE WHEN crossing THEN 3 ELSE 2 END),
f AS (SELECT a.id AS source, b.id AS target FROM n a JOIN n b ON a.s = b.id),
k AS (SELECT source, target, 'thematic' AS kind, weight, crossing FROM e UNION ALL SELECT source, target, 'formal', 0, FALSE FROM f)"""


def edges_at(t: Tables, node: int) -> DataFrame:
    """Edges of both kinds at one node."""
    thematic = graph.thematic_edges_at(nodes(t), F.lit(node)).withColumn("kind", F.lit("thematic"))
    formal = graph.formal_edges(nodes(t)).where((F.col("source") == node) | (F.col("target") == node))
    return thematic.unionByName(formal.select("source", "target", F.lit(0).cast("long").alias("weight"), F.lit(False).alias("cross"), F.lit("formal").alias("kind")))


@query(f"WITH {NODES_SQL} SELECT source, target, weight::BIGINT AS weight, crossing AS \"cross\" FROM e")
def thematic_edges(t: Tables) -> DataFrame:
    return graph.thematic_edges(nodes(t))


@query(f"WITH {NODES_SQL} SELECT source, target FROM f")
def formal_edges(t: Tables) -> DataFrame:
    return graph.formal_edges(nodes(t))


@query(f"WITH {NODES_SQL}, o AS (SELECT source AS id, kind FROM k UNION ALL SELECT target, kind FROM k) SELECT n.id, count(*) FILTER (kind = 'thematic') AS thematic, count(*) FILTER (kind = 'formal') AS formal FROM n LEFT JOIN o ON n.id = o.id GROUP BY n.id")
def graph_degrees(t: Tables) -> DataFrame:
    return graph.degrees(nodes(t)).select("id", "thematic", "formal")


@query(f"WITH {NODES_SQL} SELECT tag AS key, count(DISTINCT id) AS records FROM (SELECT id, unnest(tags) AS tag FROM n) GROUP BY tag HAVING count(DISTINCT id) >= 2")
def graph_themes(t: Tables) -> DataFrame:
    return graph.themes(nodes(t)).select("key", "records")


@query(f"WITH {NODES_SQL}, o AS (SELECT target AS id, * FROM k WHERE source = 10 UNION ALL SELECT source, * FROM k WHERE target = 10) SELECT o.id, bool_or(kind = 'formal') AS formal, sum(weight)::BIGINT AS weight, bool_or(kind = 'formal' AND source = 10) AS outgoing, any_value(title) AS title FROM o JOIN n ON o.id = n.id GROUP BY o.id")
def graph_connections(t: Tables) -> DataFrame:
    return graph.connections(F.lit(10), edges_at(t, 10), nodes(t))


@query(f"""WITH {NODES_SQL}, o AS (SELECT source AS id FROM k UNION ALL SELECT target FROM k), d AS (SELECT n.id, count(o.id) AS c FROM n LEFT JOIN o ON n.id = o.id GROUP BY n.id)
SELECT count(*) AS records, count(*) FILTER (c > 0) AS connected, count(*) FILTER (c = 0) AS isolated, arg_max(id, (c, -id)) AS lead, (SELECT count(*) FROM e WHERE crossing) AS cross_links, (SELECT count(*) FROM f) AS formal_links FROM d""")
def graph_summary(t: Tables) -> DataFrame:
    return graph.summary(nodes(t))


@query(f"WITH {NODES_SQL}, g AS (SELECT target AS id FROM k WHERE source = 10 UNION SELECT source FROM k WHERE target = 10 UNION SELECT 10) SELECT id FROM g")
def graph_neighbours(t: Tables) -> DataFrame:
    near = graph.oriented(edges_at(t, 10)).where("node = 10").select(F.col("other").alias("id"))
    return near.unionByName(t.spark.range(10, 11)).distinct()


@query(f"WITH {NODES_SQL}, g AS (SELECT DISTINCT j FROM n), h AS (SELECT j, row_number() OVER (ORDER BY j) - 1 AS o, count(*) OVER () AS c FROM g) SELECT j AS key, 400 + 600 * 0.32 * cos(o * 2 * pi() / c - pi() / 2) AS x, 300 + 600 * 0.32 * sin(o * 2 * pi() / c - pi() / 2) AS y FROM h")
def jurisdiction_centroids(t: Tables) -> DataFrame:
    groups = nodes(t).select(F.col("jurisdiction").alias("key")).distinct().withColumn("ord", F.row_number().over(Window.orderBy("key")) - 1)  # a row for each jurisdiction
    return graph.centroids(groups, 800, 600)


def log(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select(F.col("user_id").alias("source"), "ts", "event_id", F.sha2((k % 3).cast("string"), 256).alias("hash"), k.alias("count"), F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "skipped").otherwise("success").alias("status"))


LOG_SQL = "log AS (SELECT user_id AS source, ts, event_id, sha256((json_extract(props, '$.k')::INT % 3)::VARCHAR) AS hash, json_extract(props, '$.k')::INT AS count, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'skipped' ELSE 'success' END AS status FROM events)"


@query(f"""WITH {LOG_SQL}, m AS (SELECT *, lag(hash) OVER w AS before, row_number() OVER (PARTITION BY source, hash ORDER BY ts, event_id) AS n FROM log WINDOW w AS (PARTITION BY source ORDER BY ts, event_id)),
c AS (SELECT *, CASE WHEN before IS NULL THEN 'first' WHEN before <> hash THEN 'changed' ELSE 'unchanged' END AS change FROM m)
SELECT event_id, change, sum((change <> 'unchanged')::INT) OVER (PARTITION BY source ORDER BY ts, event_id)::BIGINT AS sequence, change = 'changed' AND n > 1 AS reverted FROM c""")
def cdc_sequences(t: Tables) -> DataFrame:
    return changes.versions(log(t), "source", "hash", "ts", "event_id").select("event_id", "change", "sequence", "reverted")


@query(f"WITH {LOG_SQL} SELECT source, arg_max(count, (count, -event_id)) AS count, arg_max(status, (count, -event_id)) AS status FROM log GROUP BY source")
def latest_transition(t: Tables) -> DataFrame:
    return changes.latest_transition(log(t), "source", "count", "event_id", "status")


@query(f"WITH {LOG_SQL} SELECT event_id, min(ts) OVER (PARTITION BY source, hash) AS ts FROM log")
def first_discovery(t: Tables) -> DataFrame:
    return changes.first_discovery(log(t), ["source", "hash"], "ts").select("event_id", "ts")


@query(f"""WITH {LOG_SQL}, h AS (SELECT date_trunc('day', ts)::DATE AS day, status, count <> 0 AS eligible, source % 50 = 0 AS critical FROM log),
g AS (SELECT day, count(*) FILTER (eligible AND status = 'success') AS successful, count(*) FILTER (eligible AND status = 'error') AS failed, count(*) FILTER (status = 'skipped') AS skipped,
  bool_or(eligible AND status = 'error' AND critical) AS crit, bool_or(NOT eligible AND status = 'error') AS retry FROM h GROUP BY day)
SELECT day, successful, failed, skipped, successful + failed AS due, CASE WHEN successful + failed = 0 THEN 1 ELSE successful / (successful + failed) END AS rate,
  CASE WHEN crit OR CASE WHEN successful + failed = 0 THEN 1 ELSE successful / (successful + failed) END < 0.7 THEN 'failed' WHEN failed > 0 OR retry THEN 'degraded' ELSE 'healthy' END AS health FROM g""")
def run_health(t: Tables) -> DataFrame:
    """Health of each day's run."""
    rows = log(t).select(F.to_date("ts").alias("day"), "status", (F.col("count") != 0).alias("eligible"), (F.col("source") % 50 == 0).alias("critical"))
    return changes.run_health(rows, 0.7, ["day"])


@query(f"WITH {LOG_SQL}, r AS (SELECT source, max(ts) AS seen_at FROM log WHERE status <> 'error' GROUP BY source), s AS (SELECT DISTINCT user_id AS source FROM events UNION SELECT 9999) SELECT s.source, CASE WHEN s.source % 2 = 0 THEN TRUE ELSE seen_at IS NULL OR seen_at <= TIMESTAMP '2024-01-31' - INTERVAL 6 DAY END AS due FROM s LEFT JOIN r USING (source)")
def sources_due(t: Tables) -> DataFrame:
    last = log(t).where("status <> 'error'").groupBy("source").agg(F.max("ts").alias("at"))
    known = t.events.select(F.col("user_id").alias("source")).unionByName(t.spark.range(9999, 10000).toDF("source")).distinct()
    schedule = F.when(F.col("source") % 2 == 0, "daily").otherwise("weekly")
    return known.join(last, "source", "left").select("source", changes.due(schedule, F.col("at"), F.lit("2024-01-31").cast("timestamp_ntz")).alias("due"))


@query(f"""WITH {LOG_SQL}, r AS (SELECT source, max(ts) AS seen_at, arg_max(status, (ts, event_id)) AS last FROM log GROUP BY source),
s AS (SELECT c_custkey AS source FROM customer), x AS (SELECT CASE WHEN seen_at IS NULL THEN 'never' WHEN seen_at < TIMESTAMP '2024-01-31' - INTERVAL 2 DAY THEN 'overdue' WHEN last = 'error' THEN 'unavailable' ELSE 'current' END AS s FROM s LEFT JOIN r USING (source))
SELECT count(*) FILTER (s = 'current') AS "current", count(*) FILTER (s = 'unavailable') AS unavailable, count(*) FILTER (s = 'overdue') AS overdue, count(*) FILTER (s = 'never') AS never FROM x""")
def manual_coverage(t: Tables) -> DataFrame:
    last = log(t).groupBy(F.col("source").alias("source_id")).agg(F.max("ts").alias("reviewed_at"), F.max_by("status", F.struct("ts", "event_id")).alias("last"))
    told = last.withColumn("outcome", F.when(F.col("last") == "error", "unavailable").otherwise("available"))
    return changes.manual_coverage(t.customer.select(F.col("c_custkey").alias("source_id")), told, F.lit("2024-01-31").cast("timestamp_ntz"), F.lit(2))


QUEUE_SQL = f"{LOG_SQL}, q AS (SELECT source AS source_id, event_id AS key, row_number() OVER (PARTITION BY source ORDER BY count % 4, ts, event_id) AS place FROM log WHERE status = 'error')"


def queue(t: Tables) -> DataFrame:
    state = log(t).where("status = 'error'").select(F.col("source").alias("source_id"), F.col("event_id").alias("key"), F.lit("pending").alias("status"), (F.col("count") % 4).alias("attempts"), F.col("ts").alias("first_seen"), F.lit(None).cast("timestamp_ntz").alias("last_attempt"))
    return ranking.retry_queue(state)


@query(f"WITH {QUEUE_SQL} SELECT source_id, key, place::INT AS place FROM q")
def retry_queue(t: Tables) -> DataFrame:
    return queue(t).select("source_id", "key", "place")


@query(f"""WITH {QUEUE_SQL}, f AS (SELECT source AS source_id, event_id AS key, row_number() OVER (PARTITION BY source ORDER BY ts, event_id) AS place FROM log WHERE status = 'success'),
c AS (SELECT coalesce(a.source_id, b.source_id) AS source_id, coalesce(a.n, 0) AS p, coalesce(b.n, 0) AS f FROM (SELECT source_id, count(*) AS n FROM q GROUP BY 1) a FULL JOIN (SELECT source_id, count(*) AS n FROM f GROUP BY 1) b ON a.source_id = b.source_id),
l AS (SELECT *, CASE WHEN p = 0 THEN least(f, 5) ELSE least(f, 4) END AS first FROM c), m AS (SELECT *, least(p, 5 - first) AS retries FROM l)
SELECT f.source_id, f.key, 'fresh' AS origin FROM f JOIN m USING (source_id) WHERE place <= greatest(first, 5 - retries) UNION ALL SELECT q.source_id, q.key, 'pending' FROM q JOIN m USING (source_id) WHERE place <= retries""")
def select_for_run(t: Tables) -> DataFrame:
    """Five candidates of each source, a slot of them for retries."""
    w = Window.partitionBy("source_id").orderBy("ts", "event_id")
    fresh = log(t).where("status = 'success'").withColumnRenamed("source", "source_id").select("source_id", F.col("event_id").alias("key"), F.row_number().over(w).alias("place"))
    return ranking.select_for_run(queue(t), fresh, 5).select("source_id", "key", "origin")


@query(f"WITH {LOG_SQL} SELECT event_id, CASE WHEN count < max(count) OVER (PARTITION BY source) AND status = 'error' THEN 'dismissed' ELSE status END AS status FROM log")
def supersede_older(t: Tables) -> DataFrame:
    return ranking.supersede_older(log(t), "source", "count", ("error",)).select("event_id", "status")


@query("SELECT url, min(page_id) AS page_id FROM (SELECT page_id, regexp_replace(url, '[?#].*', '') AS url FROM pages) GROUP BY url")
def dedupe_first_by_url(t: Tables) -> DataFrame:
    rows = t.pages.select("page_id", F.regexp_replace("url", "[?#].*", "").alias("url"))
    return ranking.first_by(rows, "url", "page_id").select("url", "page_id")


@query("SELECT doc_id, first AS holder FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents) WHERE doc_id <> first")
def duplicate_keys(t: Tables) -> DataFrame:
    return ranking.repeats(t.documents.select("doc_id", "text"), "text", "doc_id").select("doc_id", "holder")


@query("SELECT conv_id, count(*) AS turns, max(turn) AS last, arg_max(role, (turn, role, text)) AS role FROM conversations GROUP BY conv_id")
def thread_versions(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last"), F.max_by("role", F.struct("turn", "role", "text")).alias("role"))


@query("""SELECT key, v AS value FROM (SELECT o_orderkey AS key, coalesce(l, o_orderstatus) AS v FROM orders LEFT JOIN (SELECT l_orderkey, arg_max(l_linestatus, (l_linenumber, l_partkey, l_suppkey, l_linestatus)) AS l FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) ON o_orderkey = l_orderkey)""")
def reviews_upsert(t: Tables) -> DataFrame:
    """Keyed upsert, the last update wins; of updates equal in their order the greatest value."""
    held = t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("value"), F.struct(F.col("o_orderkey").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c")).alias("_s"))
    told = t.lineitem.where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("key"), F.col("l_linestatus").alias("value"), F.struct(F.col("l_linenumber").cast("long").alias("a"), F.col("l_partkey").alias("b"), F.col("l_suppkey").alias("c")).alias("_s"))
    last = told.groupBy("key").agg(F.max_by("value", F.struct("_s", "value")).alias("new"))
    return held.join(last, "key", "left").select("key", F.coalesce("new", "value").alias("value"))


@query(f"""WITH {REGISTER_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY regexp_extract(url, 'a=(\\d+)', 1), effective ORDER BY id) AS n FROM reg)
SELECT 'register' AS relation, id::VARCHAR AS key, rule, severity FROM (
  SELECT id, 'status' AS rule, 'error' AS severity FROM reg WHERE status NOT IN ('O', 'F') UNION ALL SELECT id, 'hash', 'error' FROM reg WHERE hash IS NULL UNION ALL SELECT id, 'checker', 'error' FROM reg WHERE trim(checked_by) = ''
  UNION ALL SELECT id, 'ahead', 'error' FROM reg WHERE checked_at > TIMESTAMP '2001-03-01' UNION ALL SELECT id, 'source repeats', 'error' FROM w WHERE n > 1
  UNION ALL SELECT id, 'superseded by none', 'warning' FROM reg WHERE superseded_by IS NOT NULL AND superseded_by NOT IN (SELECT id FROM reg))""")
def quality_record_rules(t: Tables) -> DataFrame:
    """Rules, repeats and references in one report."""
    from tidemark.plans.base import now

    rows = register(t)
    rules = {
        "status": ~F.col("status").isin("O", "F"),
        "hash": F.col("hash").isNull(),
        "checker": F.trim("checked_by") == "",
        "ahead": F.col("checked_at") > now(),
    }
    again = quality.duplicates(rows, "register", "id", F.concat_ws("|", F.regexp_extract("url", r"a=(\d+)", 1), "effective"), "id", "source repeats")
    none = quality.dangling(rows, "register", "id", "superseded_by", rows.select(F.col("id").alias("target")), "target", "superseded by none", "warning")
    return quality.merged(quality.broken(rows, "register", "id", rules), again, none)


@query("SELECT 'lineitem' AS relation, concat_ws('-', l_orderkey, l_linenumber) AS key, 'part' AS rule, 'error' AS severity FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <> 7)")
def quality_foreign_keys(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return quality.dangling(rows, "lineitem", "key", "l_partkey", t.part.where("p_size <> 7"), "p_partkey", "part")


@query(f"""WITH {LOG_SQL}, a AS (SELECT count(*) FILTER (status = 'success') AS successful, count(*) FILTER (status = 'error') AS failed, count(*) FILTER (status = 'skipped') AS skipped FROM log),
s AS (SELECT count(*) FILTER (event_type NOT IN ('error', 'view')) AS successful, count(DISTINCT user_id) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type IN ('view', 'click')) AS skipped FROM events)
SELECT 'run' AS relation, 'totals' AS key, unnest(list_filter([CASE WHEN a.successful <> s.successful THEN 'successful differs' END, CASE WHEN a.failed <> s.failed THEN 'failed differs' END, CASE WHEN a.skipped <> s.skipped THEN 'skipped differs' END], lambda x: x IS NOT NULL)) AS rule, 'error' AS severity FROM a, s""")
def quality_meta_recompute(t: Tables) -> DataFrame:
    """Totals as a careless run stored them, from the events, against those computed anew from the log."""
    anew = log(t).agg(F.count_if(F.col("status") == "success").alias("successful"), F.count_if(F.col("status") == "error").alias("failed"), F.count_if(F.col("status") == "skipped").alias("skipped"))
    kind = F.col("event_type")
    stored = t.events.agg(F.count_if(~kind.isin("error", "view")).alias("successful"), F.count_distinct(F.when(kind == "error", F.col("user_id"))).alias("failed"), F.count_if(kind.isin("view", "click")).alias("skipped"))
    return quality.recomputed(stored, anew, "run", ["successful", "failed", "skipped"])


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, us + 86400000000 AS until, 1 AS c FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN e.us > r.until THEN e.us + 86400000000 ELSE r.until END, CASE WHEN e.us > r.until THEN 1 ELSE r.c + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, event_id, c <= 2 AS allowed FROM r""")
def rate_limit_fold(t: Tables) -> DataFrame:
    """Two calls in a window of a day, which opens at a key's first call."""
    return changes.fixed_windows(t.events, "user_id", "ts", "event_id", 2, 86_400.0)


@query(f"WITH {LOG_SQL}, s AS (SELECT event_id, source, hash, row_number() OVER (PARTITION BY source, hash ORDER BY ts, event_id) AS n FROM log) SELECT event_id FROM s WHERE n = 1 AND source NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def exactly_once_discovery(t: Tables) -> DataFrame:
    """Fresh candidates: not tracked, and their key not seen before."""
    tracked = t.customer.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("source"))
    return ranking.first_by(log(t).join(tracked, "source", "left_anti"), ["source", "hash"], "ts", "event_id").select("event_id")
