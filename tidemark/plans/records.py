"""Queries over JSON of any shape, patches, and state recovered from reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import json_text
from tidemark.operators import patches
from tidemark.plans.base import Tables, query
from tidemark.streaming import recovery


def payloads(t: Tables) -> DataFrame:
    """Events with a record as JSON: nested objects and arrays, addresses, fields that nothing knows."""
    site = F.concat(F.lit("https://Example.com/u/"), "user_id", F.lit("/?utm_source="), "event_type", F.lit("&b="), F.col("event_id"), F.lit("&a=1#top"))
    link = F.concat(F.lit('{"type": "'), "event_type", F.lit('", "url" : "'), site, F.lit('", "n": 1.50}'))
    text = F.concat(F.lit('{ "zeta":['), link, F.lit(', "http://x/#y", {"url":null}],  "note":"a \\"url\\": \\"http://x/#z\\", b",\n "url":"mailto:x", "props":'), "props", F.lit(',"id":'), "event_id", F.lit(', "website":"http://www.example.com:80#f"}'))
    return t.events.select("event_id", text.alias("record"))


SITE_SQL = "'https://example.com/u/' || user_id || '?a=1&b=' || event_id"


@query(f"""SELECT event_id, '{{ "zeta":[{{"type": "' || event_type || '", "url" : "' || {SITE_SQL} || '", "n": 1.50}}, "http://x/#y", {{"url":null}}],  "note":"a \\"url\\": \\"http://x/#z\\", b",' || chr(10)
  || ' "url":"mailto:x", "props":' || props || ',"id":' || event_id || ', "website":"http://www.example.com/"}}' AS record FROM events""")
def json_urls_rewritten(t: Tables) -> DataFrame:
    """Records with their addresses in canonical form and everything else as it was."""
    return payloads(t).select("event_id", json_text.rewritten(F.col("record")).alias("record"))


@query("""SELECT event_id, sha256('{"a":[{"k":' || event_id || ',"z":null},"' || event_type || '"],"id":' || event_id || ',"props":' || replace(props, ' ', '') || ',"user":{"id":' || user_id || ',"kind":"' || event_type || '"}}') AS revision, TRUE AS same FROM events""")
def json_revisions(t: Tables) -> DataFrame:
    """Revision of a record written with its keys in one order, and whether another order gives it too."""
    kind = F.col("event_type")
    one = F.concat(F.lit('{"user": {"kind":"'), kind, F.lit('","id":'), "user_id", F.lit('}, "props":'), "props", F.lit(', "id":'), "event_id", F.lit(', "a":[{"z":null,"k":'), "event_id", F.lit('},"'), kind, F.lit('"]}'))
    two = F.concat(F.lit('{"a":[{"k":'), "event_id", F.lit(',"z":null}, "'), kind, F.lit('"],"id":'), "event_id", F.lit(',"user":{"id":'), "user_id", F.lit(',"kind":"'), kind, F.lit('"},"props":'), "props", F.lit("}"))
    return t.events.select("event_id", json_text.revision(one).alias("revision"), (json_text.revision(one) == json_text.revision(two)).alias("same"))


@query("""WITH r AS (SELECT o_orderkey AS id, o_orderstatus AS s, o_orderpriority AS p, '{"rows":[{"key":' || o_orderkey || ',"note":"a ] } \\"{ b"}],"of":"' || o_custkey || '"}' AS j FROM orders)
SELECT id, CASE WHEN s <> 'P' OR p LIKE '1%' THEN j END AS json FROM r""")
def replies(t: Tables) -> DataFrame:
    """The JSON of replies: bare, fenced, amid prose with brackets of its own, or cut off."""
    json = F.concat(F.lit('{"rows":[{"key":'), "o_orderkey", F.lit(',"note":"a ] } \\"{ b"}],"of":"'), F.col("o_custkey").cast("string"), F.lit('"}'))
    fenced = F.concat(F.lit("```json\n"), json, F.lit("\n```\n"))
    prose = F.concat(F.lit('It says "so":\n'), json, F.lit(" and [more {of it]."))
    cut = F.concat(F.lit("Here: "), F.expr("left('{\"a\":[1,2}', 9)"), json)
    status, first = F.col("o_orderstatus"), F.col("o_orderpriority").startswith("1")
    reply = F.when(first, json).when(status == "F", fenced).when(status == "O", prose).otherwise(cut)
    return t.orders.select(F.col("o_orderkey").alias("id"), json_text.reply(reply).alias("json"))


PATCHED = ("status", "title", "owner", "updated_at")


def record_patches(t: Tables) -> DataFrame:
    """Lineitems as patches of the orders: which fields a patch has, and what they hold, vary by columns of their own."""
    key = F.expr("(l_orderkey * 8 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey")
    values = {
        "status": F.when(F.col("l_returnflag") == "R", "trashed").otherwise(F.lower("l_linestatus")),
        "title": F.when(F.col("l_tax") > 0.02, F.concat(F.lit("Part "), "l_partkey")),
        "owner": F.when(F.col("l_quantity") > 20, F.col("l_suppkey")),
        "updated_at": F.col("l_shipdate") + F.expr("INTERVAL 1 DAY"),
    }
    given = {"status": F.col("l_discount") < 0.06, "title": F.col("l_quantity") < 30, "owner": F.col("l_tax") < 0.05, "updated_at": F.col("l_discount") < 0.03}
    return t.lineitem.select(F.col("l_orderkey").alias("id"), key.alias("ord"), F.col("l_shipdate").alias("at"), *patches.patch(values, given))


@query("""WITH p AS (SELECT l_orderkey AS id, (l_orderkey * 8 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey AS ord, l_shipdate AS at,
    l_discount < 0.06 AS has_status, CASE WHEN l_returnflag = 'R' THEN 'trashed' ELSE lower(l_linestatus) END AS status,
    l_quantity < 30 AS has_title, CASE WHEN l_tax > 0.02 THEN 'Part ' || l_partkey END AS title, l_tax < 0.05 AS has_owner, CASE WHEN l_quantity > 20 THEN l_suppkey END AS owner,
    l_discount < 0.03 AS has_time, l_shipdate + INTERVAL 1 DAY AS updated FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS i FROM p)
, r AS (WITH RECURSIVE f AS (
    SELECT o_orderkey AS id, 0::BIGINT AS i, CASE WHEN o_orderstatus = 'P' THEN 'trashed' ELSE lower(o_orderstatus) END AS status, 'Order ' || o_orderkey AS title, o_custkey AS owner,
      o_orderdate AS updated_at, CASE WHEN o_orderstatus = 'P' THEN o_orderdate END AS trashed_at FROM orders
    UNION ALL
    SELECT f.id, n.i, CASE WHEN has_status THEN n.status ELSE f.status END, CASE WHEN has_title THEN n.title ELSE f.title END, CASE WHEN has_owner THEN n.owner ELSE f.owner END,
      CASE WHEN has_time THEN n.updated ELSE n.at END,
      CASE WHEN has_status AND n.status = 'trashed' AND f.status <> 'trashed' THEN n.at WHEN has_status AND n.status <> 'trashed' THEN NULL ELSE f.trashed_at END
    FROM f JOIN n ON n.id = f.id AND n.i = f.i + 1)
  SELECT * FROM f)
SELECT id, arg_max(status, i) AS status, (max(struct_pack(i := i, v := title))).v AS title, (max(struct_pack(i := i, v := owner))).v AS owner, arg_max(updated_at, i) AS updated_at, (max(struct_pack(i := i, v := trashed_at))).v AS trashed_at FROM r GROUP BY id""")
def records_patched(t: Tables) -> DataFrame:
    """Orders after all their patches, in one pass."""
    trashed = F.col("o_orderstatus") == "P"
    records = t.orders.select(
        F.col("o_orderkey").alias("id"), F.when(trashed, "trashed").otherwise(F.lower("o_orderstatus")).alias("status"), F.concat(F.lit("Order "), "o_orderkey").alias("title"),
        F.col("o_custkey").alias("owner"), F.col("o_orderdate").alias("updated_at"), F.when(trashed, F.col("o_orderdate")).alias("trashed_at"),
    )
    return patches.applied(records, record_patches(t), PATCHED)[0]


def version_reviews(t: Tables) -> DataFrame:
    """Lineitems as reviews of versions of customers' pages; large ones come a second time, after all others."""
    day = lambda n: F.col("l_shipdate") + F.make_dt_interval(n)
    key = F.expr("(l_orderkey * 8 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey")
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    status = F.when(F.col("l_returnflag") == "A", "approved").when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_linestatus") == "O", "pending_review").otherwise("published")
    held = rows.select(
        key.alias("ord"),
        status.alias("status"),
        F.concat(F.lit("https://www.example.com/c/"), "o_custkey", F.when(F.col("l_tax") > 0.04, "?utm_source=x").otherwise("/")).alias("url"),
        F.when(F.col("l_discount") < 0.09, F.sha2(F.expr("l_suppkey % 3").cast("string"), 256)).alias("hash"),
        F.expr("CAST(l_quantity AS INT) % 9").alias("sequence"),
        F.when(F.col("l_linenumber") > 3, F.col("o_custkey")).alias("linked_source"),
        F.col("l_shipdate").alias("discovered"),
        F.when(F.col("l_tax") < 0.06, day(F.lit(2))).alias("retrieved"),
        F.when(F.col("l_discount") > 0.02, day(F.lit(3))).alias("reviewed"),
        F.when(status == "published", day(F.col("l_linenumber"))).alias("published"),
        day(F.lit(5)).alias("updated"),
        (F.col("l_quantity") > 30).alias("twice"),
    )
    # each line and its order are read and met once, also where the review comes twice
    first, again = F.lit(0).cast("long"), F.lit(1 << 61)
    each = held.withColumn("_more", F.explode(F.when(F.col("twice"), F.array(first, again)).otherwise(F.array(first))))
    return each.withColumn("ord", F.col("ord") + F.col("_more")).drop("twice", "_more")


def recovered_state(t: Tables) -> recovery.State:
    sources = t.customer.select(F.col("c_custkey").alias("source_id"), F.concat(F.lit("https://www.example.com/c/"), "c_custkey").alias("url"), F.col("c_custkey").alias("ord"))
    held = version_reviews(t)
    # what an earlier run has kept: some candidates, and snapshots of customers in credit
    old = recovery.versions(held, sources).where("sequence < 5").groupBy("key").agg(F.min("source_id").alias("source_id"), F.min("discovered").alias("first_seen"), F.max("sequence").alias("n"))
    began = F.to_timestamp_ntz(F.lit("1990-01-01 00:00:00"))
    state = old.where("n <> 2").select("key", "source_id", F.when(F.col("n") == 1, "failed").when(F.col("n") == 3, "pending").otherwise("processed").alias("status"), "first_seen", F.col("first_seen").alias("processed_at"), F.when(F.col("n") == 1, "timed out").alias("error"))
    rich = t.customer.where("c_acctbal > 4000")
    snapshots = rich.select(F.col("c_custkey").alias("source_id"), F.sha2(F.expr("c_nationkey % 3").cast("string"), 256).alias("hash"), F.expr("c_nationkey % 9 + 1").alias("sequence"), began.alias("first_checked"), began.alias("last_checked"), began.alias("last_changed"))
    checks = rich.select(F.col("c_custkey").alias("source_id"), F.to_timestamp_ntz(F.lit("1996-06-01 00:00:00")).alias("checked"))
    return recovery.recovered(recovery.State(state, snapshots, checks), held, sources)


VERSIONS_SQL = """WITH a AS (SELECT (l_orderkey * 8 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey AS ord,
    CASE WHEN l_returnflag = 'A' THEN 'approved' WHEN l_returnflag = 'R' THEN 'rejected' WHEN l_linestatus = 'O' THEN 'pending_review' ELSE 'published' END AS status,
    'https://www.example.com/c/' || o_custkey AS url, CASE WHEN l_discount < 0.09 THEN sha256((l_suppkey % 3)::VARCHAR) END AS hash, (l_quantity::INT % 9) AS sequence, o_custkey AS source_id,
    l_shipdate AS discovered, CASE WHEN l_tax < 0.06 THEN l_shipdate + INTERVAL 2 DAY END AS retrieved, CASE WHEN l_discount > 0.02 THEN l_shipdate + INTERVAL 3 DAY END AS reviewed,
    l_shipdate + to_days(l_linenumber) AS published, l_shipdate + INTERVAL 5 DAY AS updated, l_quantity > 30 AS twice FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
b AS (SELECT * REPLACE (CASE WHEN status = 'published' THEN published END AS published) FROM a WHERE sequence >= 1 AND hash IS NOT NULL),
v AS MATERIALIZED (SELECT *, coalesce(published, reviewed, updated) AS processed, coalesce(retrieved, published, reviewed, updated) AS checked, url || '#change=' || hash || ':' || sequence AS key
  FROM (SELECT * FROM b UNION ALL SELECT * REPLACE (ord + 2305843009213693952 AS ord) FROM b WHERE twice)),
old AS (SELECT key, min(source_id) AS source_id, min(discovered) AS first_seen, max(sequence) AS n FROM v WHERE sequence < 5 GROUP BY key HAVING max(sequence) <> 2)
"""


@query(VERSIONS_SQL + """, r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) AS i FROM v),
f AS (WITH RECURSIVE g AS (
    SELECT coalesce(k.key, old.key) AS key, 0::BIGINT AS i, old.source_id, CASE n WHEN 1 THEN 'failed' WHEN 3 THEN 'pending' WHEN 4 THEN 'processed' END AS status, old.first_seen, old.first_seen AS processed_at,
      CASE WHEN n = 1 THEN 'timed out' END AS error FROM (SELECT DISTINCT key FROM v) k FULL JOIN old ON old.key = k.key
    UNION ALL
    SELECT g.key, r.i, CASE WHEN r.status = 'pending_review' AND g.status IS NOT NULL THEN g.source_id ELSE r.source_id END,
      CASE WHEN r.status = 'pending_review' AND g.status IS NULL THEN 'pending' WHEN r.status = 'pending_review' AND g.status = 'processed' THEN 'awaiting_review' WHEN r.status = 'pending_review' THEN g.status
        WHEN r.status = 'approved' THEN 'approved' WHEN r.status = 'rejected' THEN 'dismissed' ELSE 'processed' END,
      CASE WHEN g.status IS NULL THEN r.discovered ELSE g.first_seen END,
      CASE WHEN r.status = 'pending_review' AND (g.status IS NULL OR g.status = 'processed') THEN NULL WHEN r.status = 'pending_review' THEN g.processed_at WHEN r.status = 'approved' THEN NULL ELSE r.processed END,
      CASE WHEN r.status = 'pending_review' THEN g.error END
    FROM g JOIN r ON r.key = g.key AND r.i = g.i + 1)
  SELECT key, unnest(max(struct_pack(i := i, source_id := source_id, status := status, first_seen := first_seen, processed_at := processed_at, error := error))) FROM g GROUP BY key)
SELECT key, source_id, status, first_seen, processed_at, error FROM f""")
def recovered_candidates(t: Tables) -> DataFrame:
    """Candidates after all reviews, against the fold of one review after the other."""
    return recovered_state(t).seen


@query(VERSIONS_SQL + """, r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ord) AS i FROM v WHERE status IN ('approved', 'published')),
f AS (WITH RECURSIVE g AS (
    SELECT c_custkey AS source_id, 0::BIGINT AS i, CASE WHEN c_acctbal > 4000 THEN sha256((c_nationkey % 3)::VARCHAR) END AS hash, CASE WHEN c_acctbal > 4000 THEN c_nationkey % 9 + 1 END AS sequence,
      CASE WHEN c_acctbal > 4000 THEN TIMESTAMP '1990-01-01' END AS first_checked, CASE WHEN c_acctbal > 4000 THEN TIMESTAMP '1990-01-01' END AS last_checked,
      CASE WHEN c_acctbal > 4000 THEN TIMESTAMP '1990-01-01' END AS last_changed, CASE WHEN c_acctbal > 4000 THEN TIMESTAMP '1996-06-01' END AS checked FROM customer
    UNION ALL
    SELECT source_id, i, CASE WHEN ok THEN rh ELSE hash END, CASE WHEN ok THEN rs ELSE sequence END, CASE WHEN ok THEN coalesce(first_checked, rc) ELSE first_checked END,
      CASE WHEN ok THEN rc ELSE last_checked END, CASE WHEN ok THEN changed ELSE last_changed END, CASE WHEN ok THEN greatest(checked, rc) ELSE checked END
    FROM (SELECT g.source_id, r.i, g.hash, g.sequence, first_checked, last_checked, last_changed, g.checked, r.hash AS rh, r.sequence AS rs, r.checked AS rc, coalesce(r.reviewed, r.processed) AS changed,
        r.sequence > coalesce(g.sequence, 0) OR (r.sequence = g.sequence AND r.hash = g.hash) AS ok
      FROM g JOIN r ON r.source_id = g.source_id AND r.i = g.i + 1))
  SELECT source_id, unnest(max(struct_pack(i := i, hash := hash, sequence := sequence, first_checked := first_checked, last_checked := last_checked, last_changed := last_changed, checked := checked))) FROM g GROUP BY source_id)
SELECT source_id, hash, sequence, first_checked, last_checked, last_changed, checked FROM f WHERE hash IS NOT NULL""")
def recovered_snapshots(t: Tables) -> DataFrame:
    """Snapshots and last checks of sources after all reviews; none goes back to an earlier version."""
    made = recovered_state(t)
    return made.snapshots.join(made.checks, "source_id", "left")
