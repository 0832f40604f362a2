"""Queries over filtered and merged views, and over the small rules of collecting and publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import audit, batches, changes, graph, predicates, views, visibility
from tidemark.plans.base import NOW, REGISTER_SQL, REVIEWS_SQL, Tables, now, query, register
from tidemark.plans.feeds import NODES_SQL, edges_at, nodes
from tidemark.plans.registers import PUBLIC_SQL, public
from tidemark.plans.rules import plain, role

# -- filters ---------------------------------------------------------------------------------------------------


@query(f"WITH {REGISTER_SQL} SELECT id, title FROM reg WHERE (contains(lower(title), '00001') OR contains(lower(agency), '00001') OR len(list_filter(tags, lambda x: contains(lower(x), '00001'))) > 0) AND jurisdiction IN ('ASIA', 'EUROPE') AND status IN ('O', 'F')")
def register_browser(t: Tables) -> DataFrame:
    """A search over title, agency and tags, and lists of choices; an empty list lets all pass."""
    rows = register(t)
    found = views.matches(" 00001 ", F.col("title"), F.col("agency"), lists=[F.col("tags")])
    return rows.where(found & views.chosen("jurisdiction", ["ASIA", "EUROPE"]) & views.chosen("type", []) & views.chosen("status", ["O", "F"])).select("id", "title")


@query(f"WITH {REGISTER_SQL} SELECT id FROM reg WHERE v_status = 'verified' AND jurisdiction = 'ASIA' AND contains(lower(title), 'order 1')")
def developments_browser(t: Tables) -> DataFrame:
    return register(t).where((F.col("v_status") == "verified") & views.chosen("jurisdiction", ["ASIA"]) & views.matches("order 1", F.col("title"))).select("id")


@query(f"WITH {REGISTER_SQL} SELECT id FROM reg WHERE jurisdiction = 'AFRICA' AND status <> 'P'")
def map_selection(t: Tables) -> DataFrame:
    return register(t).where(views.chosen("jurisdiction", ["AFRICA"]) & (F.col("status") != "P")).select("id")


@query(f"WITH {NODES_SQL} SELECT id, title FROM n WHERE j IN ('j1', 'j2') AND list_contains(tags, 'brand#11') AND (contains(lower(title), 'a') OR len(list_filter(tags, lambda x: contains(x, 'a'))) > 0)")
def network_visible(t: Tables) -> DataFrame:
    rows = nodes(t).where(views.chosen("jurisdiction", ["j1", "j2"]) & views.has_theme(F.col("tags"), "brand#11"))
    return rows.where(views.matches("A", F.col("title"), lists=[F.col("tags")])).select("id", "title")


@query(f"WITH {NODES_SQL} SELECT source, target FROM k WHERE kind = 'formal'")
def network_relations(t: Tables) -> DataFrame:
    return graph.formal_edges(nodes(t))


@query(f"WITH {NODES_SQL} SELECT j AS jurisdiction, count(*) AS n FROM n GROUP BY j")
def network_places(t: Tables) -> DataFrame:
    return nodes(t).groupBy("jurisdiction").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "jurisdiction")


@query(f"""WITH {NODES_SQL}, o AS (SELECT source AS id FROM k UNION ALL SELECT target FROM k), d AS (SELECT n.id, title, count(o.id) AS degree FROM n LEFT JOIN o ON n.id = o.id GROUP BY ALL)
SELECT id, degree FROM d ORDER BY degree DESC, title, id LIMIT 1""")
def network_focus(t: Tables) -> DataFrame:
    """The wanted node isn't there, so the one of most edges is shown."""
    of = graph.degrees(nodes(t)).select("id", (F.col("thematic") + F.col("formal")).alias("degree"))
    return views.focus(nodes(t).select("id", "title").join(of, "id"), -1).select("id", "degree")


@query(f"WITH {NODES_SQL}, o AS (SELECT source AS id, kind FROM k UNION ALL SELECT target, kind FROM k), d AS (SELECT n.id, count(*) FILTER (kind = 'thematic') AS t, count(*) FILTER (kind = 'formal') AS f FROM n LEFT JOIN o ON n.id = o.id GROUP BY n.id), "
       "x AS (SELECT id, t, f, f || ' formal link' || CASE WHEN f = 1 THEN '' ELSE 's' END AS ft, t || ' thematic link' || CASE WHEN t = 1 THEN '' ELSE 's' END AS tt FROM d) "
       "SELECT id, CASE WHEN t = 0 AND f = 0 THEN 'No links' WHEN f = 0 THEN tt WHEN t = 0 THEN ft ELSE ft || ' and ' || tt END AS text FROM x")  # fmt: skip
def network_texts(t: Tables) -> DataFrame:
    return graph.degrees(nodes(t)).select("id", predicates.node_text(F.col("formal"), F.col("thematic")).alias("text"))


@query(f"WITH {NODES_SQL}, o AS (SELECT target AS id, * FROM k WHERE source = 10 UNION ALL SELECT source, * FROM k WHERE target = 10) SELECT o.id, bool_or(kind = 'formal') AS formal, sum(weight)::BIGINT AS weight, any_value(title) AS title FROM o JOIN n ON o.id = n.id GROUP BY o.id ORDER BY formal DESC, weight DESC, title LIMIT 3")
def strongest_connections(t: Tables) -> DataFrame:
    return views.by_strength(graph.connections(F.lit(10), edges_at(t, 10), nodes(t)).drop("outgoing")).limit(3)


@query(f"WITH {REGISTER_SQL}, n AS (SELECT * FROM reg WHERE type = '1-URGENT' AND jurisdiction <> 'ASIA') SELECT r_name AS jurisdiction, count(id) AS n, list(id ORDER BY checked_at DESC, id DESC) FILTER (id IS NOT NULL) AS ids FROM region LEFT JOIN n ON r_name = jurisdiction GROUP BY r_name")
def notes_by_place(t: Tables) -> DataFrame:
    notes = register(t).where("type = '1-URGENT' AND jurisdiction <> 'ASIA'").select("id", "jurisdiction", F.col("checked_at").alias("date"))
    return views.grouped_notes(notes, t.region.select(F.col("r_name").alias("jurisdiction")))


@query(f"WITH {REGISTER_SQL} SELECT r_name AS jurisdiction FROM region WHERE r_name NOT IN (SELECT jurisdiction FROM reg WHERE type = '1-URGENT' AND jurisdiction <> 'ASIA')")
def places_without_notes(t: Tables) -> DataFrame:
    notes = register(t).where("type = '1-URGENT' AND jurisdiction <> 'ASIA'").select("jurisdiction")
    return t.region.select(F.col("r_name").alias("jurisdiction")).join(notes.distinct(), "jurisdiction", "left_anti")


@query(f"WITH {REGISTER_SQL}, u AS (SELECT DISTINCT jurisdiction, unnest(tags) AS tag FROM reg) SELECT jurisdiction, list(tag ORDER BY tag)[1:4] AS tags FROM u GROUP BY jurisdiction")
def shared_tags_by_place(t: Tables) -> DataFrame:
    """The first four of the tags of each jurisdiction's records; distinct before they are gathered."""
    each = register(t).select("jurisdiction", F.explode("tags").alias("tag")).distinct()
    return each.groupBy("jurisdiction").agg(F.slice(F.array_sort(F.collect_list("tag")), 1, 4).alias("tags"))


@query(PUBLIC_SQL + " SELECT id, title FROM pub WHERE id = (SELECT min(id) FROM pub)")
def public_record_by_id(t: Tables) -> DataFrame:
    seen = public(t)
    return seen.join(seen.agg(F.min("id").alias("id")), "id").select("id", "title")


# -- timeline and developments -----------------------------------------------------------------------------------

EVENT_SQL = "SELECT o_orderkey AS id, 'https://www.example.org/e/' || o_orderkey AS url, CASE WHEN o_orderkey % 4 = 0 THEN 'h' || o_orderkey ELSE 'x' END AS revision FROM {orders}"
HOLD_SQL = """SELECT CASE WHEN l_linenumber < 3 THEN l_orderkey END AS event_id, 'https://www.example.org/e/' || l_orderkey || CASE WHEN l_linenumber = 2 THEN '/old' WHEN l_linenumber = 3 THEN '/' ELSE '' END AS url,
  CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'R' THEN 'rejected' ELSE 'pending_review' END AS status, l_orderkey AS draft_id, CASE WHEN l_linenumber > 4 THEN 'h' || l_orderkey END AS draft_hash, CASE WHEN l_linenumber = 4 THEN 'h' || l_orderkey END AS event_hash FROM {lineitem}"""


@query(f"""WITH e AS ({plain(EVENT_SQL)}), r AS ({plain(HOLD_SQL)}), a AS (SELECT *, coalesce(event_id, CASE WHEN event_hash IS NOT NULL OR status = 'approved' THEN draft_id END) AS id FROM r WHERE status <> 'rejected')
SELECT DISTINCT a.id FROM a JOIN e ON a.id = e.id AND rtrim(a.url, '/') = e.url WHERE event_id IS NOT NULL OR coalesce(event_hash = revision, FALSE) OR coalesce(status = 'approved' AND draft_hash = revision, FALSE)""")
def withheld_event_ids(t: Tables) -> DataFrame:
    return views.withheld_events(role(t, HOLD_SQL), role(t, EVENT_SQL))


DEV_SQL = """SELECT 'd' || o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS STRING) END AS event_id, 'Development' AS title, 'https://www.example.org/' || (o_custkey * 2) || '/' AS url, 'ASIA' AS jurisdiction,
  '2001-01-01' AS detected, CASE WHEN o_orderkey % 5 = 0 THEN 'dismissed' ELSE 'detected' END AS status FROM {orders}"""
LEGACY_SQL = "SELECT c_custkey AS id, 'Event' AS title, 'https://www.example.org/' || (c_custkey - CASE WHEN c_custkey % 10 = 1 THEN 1 ELSE 0 END) AS url, 'ASIA' AS jurisdiction, '2000-01-01' AS date, c_custkey AS _ord FROM {customer}"


@query(f"""WITH d AS ({plain(DEV_SQL)}), l AS ({plain(LEGACY_SQL)}), v AS (SELECT * FROM d WHERE status <> 'dismissed'),
m AS (SELECT 'timeline-' || id AS id, id::VARCHAR AS event_id, title, url, jurisdiction, date AS detected, 'promoted' AS status, _ord FROM l WHERE id::VARCHAR NOT IN (SELECT event_id FROM v WHERE event_id IS NOT NULL) AND url NOT IN (SELECT rtrim(url, '/') FROM v)),
n AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY _ord) AS again FROM m) SELECT * FROM d UNION ALL SELECT * EXCLUDE (_ord, again) FROM n WHERE again = 1""")
def developments_with_legacy(t: Tables) -> DataFrame:
    legacy = role(t, LEGACY_SQL)
    return views.with_legacy(role(t, DEV_SQL), views.event_as_development(legacy).join(legacy.select(F.col("id").cast("string").alias("event_id"), "_ord"), "event_id"))


MASK_SQL = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'dismissed' ELSE 'detected' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey * 3 END AS policy_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey * 7 END AS event_id,
  CASE WHEN o_orderkey % 4 < 2 THEN 'verified' ELSE 'stale' END AS v_status, CASE WHEN o_orderkey % 6 = 0 THEN 'Note.' END AS notes FROM {orders}"""


@query(f"""WITH d AS (SELECT * FROM ({plain(MASK_SQL)}) WHERE status <> 'dismissed'), p AS (SELECT o_orderkey AS id FROM orders), e AS (SELECT c_custkey AS id FROM customer),
m AS (SELECT d.*, p.id AS p, e.id AS e FROM d LEFT JOIN p ON policy_id = p.id LEFT JOIN e ON event_id = e.id)
SELECT id, status, p AS policy_id, e AS event_id, CASE WHEN lost AND v_status = 'verified' THEN 'stale' ELSE v_status END AS v_status, CASE WHEN lost AND v_status = 'verified' THEN 'Its record is withheld.' ELSE notes END AS notes
FROM (SELECT *, (policy_id IS NOT NULL AND p IS NULL) OR (event_id IS NOT NULL AND e IS NULL) AS lost FROM m)""")
def developments_masked(t: Tables) -> DataFrame:
    policies, events = t.orders.select(F.col("o_orderkey").alias("id")), t.customer.select(F.col("c_custkey").alias("id"))
    return views.masked_developments(role(t, MASK_SQL), policies, events, "Its record is withheld.")


STRIP_SQL = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS published, CAST('1999-01-01' AS DATE) AS detected, o_orderstatus AS status FROM {orders}"


@query(f"WITH d AS ({plain(STRIP_SQL).replace('o_orderdate', 'o_orderdate::DATE')}) SELECT id FROM d WHERE status <> 'P' ORDER BY coalesce(published, detected) DESC, id LIMIT 6")
def developments_newest(t: Tables) -> DataFrame:
    rows = role(t, STRIP_SQL).withColumn("published", F.col("published").cast("date"))
    return views.newest(rows.where("status <> 'P'"), "id", 6).select("id")


# -- scoring, state and publication ------------------------------------------------------------------------------

VERDICT_SQL = "SELECT doc_id AS id, CAST(quality AS DOUBLE) * 0.9 AS score FROM {labels}"


@query(f"""WITH v AS ({plain(VERDICT_SQL)}), c AS (SELECT doc_id AS id, (doc_id % 10) / 10.0 AS h FROM documents)
SELECT c.id, CASE WHEN score IS NULL THEN 'heuristic' ELSE 'ai' END AS method, coalesce(score, h)::DOUBLE AS raw, (CASE WHEN score IS NULL THEN least(h, 0.65) ELSE score END)::DOUBLE AS score, score IS NULL OR score >= 0.7 AS review FROM c LEFT JOIN v ON c.id = v.id""")
def verdicts(t: Tables) -> DataFrame:
    """Scorer's verdicts, heuristics where it gave none, and which candidates a person must see."""
    candidates = t.documents.select(F.col("doc_id").alias("id"))
    held = views.with_verdicts(candidates, role(t, VERDICT_SQL), F.col("id") % 10 / F.lit(10.0))
    return held.withColumn("review", predicates.wants_review(F.col("method"), F.col("raw")))


STATE_SQL = """SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber = 1 THEN 'pending' WHEN l_linenumber = 2 THEN 'awaiting_review' WHEN l_linenumber = 3 THEN 'processed' WHEN l_linenumber = 4 THEN 'failed' ELSE 'pending' END AS status,
  CASE WHEN l_partkey % 9 = 0 THEN 'selected' WHEN l_partkey % 9 = 1 THEN 'duplicate' WHEN l_partkey % 9 = 2 THEN 'error' WHEN l_partkey % 9 = 3 THEN 'fatal' WHEN l_partkey % 9 = 4 THEN 'scored' WHEN l_partkey % 9 = 5 THEN 'superseded' WHEN l_partkey % 9 = 6 THEN 'published' WHEN l_partkey % 9 = 7 THEN 'rejected' ELSE 'none' END AS outcome,
  CAST(l_suppkey % 8 AS INT) AS attempts, CAST(l_suppkey % 10 AS DOUBLE) / 10 AS score FROM {lineitem}"""


@query(f"""WITH c AS ({plain(STATE_SQL)}) SELECT id, CASE WHEN outcome = 'rejected' THEN 'dismissed' WHEN outcome = 'published' THEN 'processed' WHEN outcome = 'superseded' AND status IN ('pending', 'awaiting_review', 'failed') THEN 'dismissed'
  WHEN status <> 'pending' THEN status WHEN outcome = 'duplicate' THEN 'dismissed' WHEN outcome = 'fatal' THEN 'failed' WHEN outcome = 'error' AND attempts >= 5 THEN 'failed' WHEN outcome = 'scored' THEN CASE WHEN score < 0.5 THEN 'dismissed' ELSE 'processed' END ELSE 'pending' END AS status,
  (attempts + (outcome = 'selected')::INT)::INT AS attempts FROM c""")
def candidate_states(t: Tables) -> DataFrame:
    rows, c = role(t, STATE_SQL), F.col
    return rows.select("id", predicates.next_state(c("status"), c("outcome"), c("attempts"), c("score")).alias("status"), predicates.attempts_after(c("outcome"), c("attempts")).alias("attempts"))


CLAIM_SQL = "SELECT event_id AS id, CASE WHEN event_id % 7 <> 0 THEN CAST(user_id % 50 AS STRING) || ':' || event_type END AS headline, event_id % 3 = 0 AS accepted FROM {events}"


@query(f"WITH c AS ({plain(CLAIM_SQL)}) SELECT id, accepted AND (headline IS NULL OR id = min(id) FILTER (accepted) OVER (PARTITION BY headline)) AS claimed FROM c")
def headline_claims(t: Tables) -> DataFrame:
    """Of candidates with one headline in a month, the first accepted one claims it; earlier ones that weren't accepted don't."""
    return views.headline_claims(role(t, CLAIM_SQL), "headline", ["id"]).select("id", "claimed")


PRINT_SQL = "SELECT user_id AS source, repeat('ab', CAST(CASE WHEN event_id % 3 = 0 THEN 31 ELSE 32 END AS INT)) || ':' || (event_id % 20) AS fingerprint, CASE WHEN event_id % 4 = 0 THEN 'approved' WHEN event_id % 2 = 0 THEN 'processed' ELSE 'failed' END AS status FROM {events}"


@query(f"WITH c AS ({plain(PRINT_SQL)}), u AS (SELECT c_custkey AS source, (c_custkey % 4)::BIGINT AS n FROM customer UNION ALL SELECT source, split_part(fingerprint, ':', 2)::BIGINT FROM c WHERE length(fingerprint) - length(split_part(fingerprint, ':', 2)) = 65) SELECT source, max(n) AS count FROM u GROUP BY source")
def newest_versions(t: Tables) -> DataFrame:
    snapshots = t.customer.select(F.col("c_custkey").alias("source"), (F.col("c_custkey") % 4).alias("count"))
    return views.greatest_count(snapshots, role(t, PRINT_SQL))


@query(f"WITH c AS ({plain(PRINT_SQL)}) SELECT source, bool_or(status = 'approved') AS unresolved FROM c GROUP BY source")
def unresolved_sources(t: Tables) -> DataFrame:
    return views.unresolved(role(t, PRINT_SQL))


@query("""WITH r AS (SELECT s_name AS source, s_suppkey % 5 <> 0 AS reached, s_suppkey % 2 = 0 AS critical FROM supplier), a AS (SELECT count(*) FILTER (reached) AS reached, count(*) FILTER (NOT reached) AS unreached,
  coalesce(list(source ORDER BY source) FILTER (NOT reached AND critical), []) AS critical FROM r) SELECT *, reached / (reached + unreached) AS rate, reached / (reached + unreached) < 0.8 OR len(critical) > 0 AS failed FROM a""")
def source_audit(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return views.audit_summary(t.supplier.select(F.col("s_name").alias("source"), (k % 5 != 0).alias("reached"), (k % 2 == 0).alias("critical")))


def audit_rows(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Orders as records and lineitems as answers of their sources; what they say varies by columns of their own."""
    site = F.concat(F.lit("https://www.example.com/o/"), "o_orderkey")
    records = t.orders.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority").startswith("5"), "trashed").otherwise("active").alias("status"), site.alias("url"),
        F.when(F.col("o_totalprice") > 50_000, F.sha2((F.col("o_custkey") % 3).cast("string"), 256)).alias("hash"), F.when(F.col("o_orderstatus") == "F", "browser").otherwise("http").alias("method"),
    )
    code = F.when(F.col("l_quantity") > 45, 404).when(F.col("l_quantity") > 40, 410).when(F.col("l_quantity") > 35, 503).otherwise(200)
    asked = F.concat(F.lit("https://www.example.com/o/"), "l_orderkey", F.lit("/?utm_source=audit"))
    answers = t.lineitem.select(
        asked.alias("url"), (code == 200).alias("ok"), code.alias("http_status"), F.when(F.col("l_tax") == 0.08, F.concat(F.lit("https://elsewhere.example.com/"), "l_partkey")).otherwise(asked).alias("final_url"),
        F.when(code == 200, F.sha2((F.col("l_suppkey") % 3).cast("string"), 256)).alias("hash"), F.when(F.col("l_linestatus") == "F", "browser").otherwise("http").alias("method"),
        (F.col("l_shipdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("l_partkey") % 50_000 + F.col("l_linenumber") / 10 + F.col("l_suppkey") / 100_000)).alias("at"), F.when(code != 200, F.concat(F.lit("answered "), code)).alias("error"),
    )
    return records, answers


AUDIT_SQL = """WITH a AS (SELECT *, CASE WHEN l_quantity > 45 THEN 404 WHEN l_quantity > 40 THEN 410 WHEN l_quantity > 35 THEN 503 ELSE 200 END AS code,
    l_shipdate + to_microseconds(((l_partkey % 50000) * 1000000 + l_linenumber * 100000 + l_suppkey * 10)::BIGINT) AS asked FROM lineitem),
b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY asked DESC, l_tax = 0.08, l_partkey DESC) AS n FROM a),
c AS (SELECT o.*, b.*, CASE WHEN o_orderstatus = 'F' THEN 'browser' ELSE 'http' END AS how, CASE WHEN l_linestatus = 'F' THEN 'browser' ELSE 'http' END AS now_how FROM orders o LEFT JOIN b ON l_orderkey = o_orderkey AND n = 1 WHERE o_orderpriority NOT LIKE '5%'),
d AS (SELECT o_orderkey AS id, CASE WHEN code IN (404, 410) OR l_tax = 0.08 THEN 'source_missing' WHEN coalesce(code, 0) <> 200 THEN 'retrieval_failed' WHEN o_totalprice <= 50000 THEN 'baseline_missing'
    WHEN how <> now_how THEN 'incomparable' WHEN o_custkey % 3 = l_suppkey % 3 THEN 'unchanged' ELSE 'changed' END AS outcome, code AS http_status,
    CASE WHEN code IS NULL THEN 'not retrieved' WHEN l_tax = 0.08 THEN 'led to another host' WHEN code <> 200 THEN 'answered ' || code END AS error FROM c)
"""


@query(AUDIT_SQL + "SELECT id, outcome, http_status, error FROM d")
def register_audit(t: Tables) -> DataFrame:
    """What an audit of all records' sources finds."""
    return audit.audited(*audit_rows(t)).select("id", "outcome", "http_status", "error")


@query(AUDIT_SQL + "SELECT outcome AS status, count(*) AS n FROM d GROUP BY outcome")
def register_audit_counts(t: Tables) -> DataFrame:
    return audit.audited(*audit_rows(t)).groupBy(F.col("outcome").alias("status")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, length(coalesce(text, '')) AS n, coalesce(contains(left(text, 600), '###'), FALSE) AS bad FROM documents),
b AS (SELECT *, i // 20 AS batch, bool_or(bad) OVER (PARTITION BY i // 20) AS failed FROM a)
SELECT doc_id, batch, (i % 20)::INTEGER AS place, CASE WHEN NOT bad THEN least(n, 600)::DOUBLE END AS score, CASE WHEN bad THEN 'ValueError: refused' END AS error, failed AS again FROM b""")
def scored_in_batches(t: Tables) -> DataFrame:
    """Documents scored in batches of twenty by a scorer that refuses a batch for one of its texts."""

    def score(texts: list[str]) -> list[float]:
        if any("###" in x for x in texts):
            raise ValueError("refused")
        return [len(x) for x in texts]

    held = batches.numbered(t.documents.select("doc_id", "text"), "doc_id")
    told = batches.scored(held, "doc_id", "text", score)
    return held.select("doc_id", "batch", "place").join(told, "doc_id").select("doc_id", "batch", "place", "score", "error", (F.col("calls") > 1).alias("again"))


@query("SELECT l_orderkey AS page, l_linenumber::BIGINT AS url, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) <= 60 AS kept FROM lineitem")
def attachments_in_budget(t: Tables) -> DataFrame:
    """Documents of a page up to its budget of bytes, by a running sum."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("page"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("url"), F.col("l_quantity").alias("bytes"))
    return views.attached_within(rows, "page", 60).select("page", F.col("url.l_linenumber").cast("long").alias("url"), "kept")


@query("""SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, coalesce(l_partkey IN (408, 429) OR l_partkey >= 500, FALSE) AS retry,
  o_orderstatus = 'F' OR (l_returnflag = 'R' AND l_quantity > 10) AS failed FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def request_outcomes(t: Tables) -> DataFrame:
    """Requests that are tried again by their code, and runs that failed by their health, their errors and their aim."""
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    health, errors = F.when(F.col("o_orderstatus") == "F", "failed").otherwise("healthy"), F.greatest(F.col("l_quantity") - 10, F.lit(0))
    return rows.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), predicates.is_retryable(F.col("l_partkey")).alias("retry"), predicates.run_failed(health, errors, F.col("l_returnflag") == "R").alias("failed"))


@query("""SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
  CASE WHEN l_returnflag = 'A' THEN 'dev-' || l_partkey WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '3%' THEN 'dev-' || o_custkey END AS development,
  CASE WHEN l_quantity < 20 THEN l_suppkey WHEN l_tax > 0.04 THEN o_custkey END AS event FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def review_targets(t: Tables) -> DataFrame:
    """The development and the event that a review is about: what it names, what its id says, what it drafts."""
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    explicit = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("dev-"), "l_partkey")).when(F.col("l_returnflag") == "R", F.concat(F.lit("item-"), "l_partkey"))
    own = F.col("o_orderpriority").startswith("1") | F.col("o_orderpriority").startswith("3")
    review = F.concat(F.lit("source-review-"), F.when(own, "dev-").otherwise("page-"), "o_custkey")
    event = predicates.event_target(F.when(F.col("l_quantity") < 20, F.col("l_suppkey")), F.col("o_custkey"), F.when(F.col("l_tax") > 0.04, F.sha2(F.col("o_orderdate").cast("string"), 256)))
    return rows.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), predicates.linked_development(explicit, review).alias("development"), event.alias("event"))


CHANGES_SQL = """WITH l AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last,
    row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS again, event_id FROM events)"""


@query(CHANGES_SQL + """ SELECT event_id AS id, CASE WHEN n = 1 THEN 'A baseline of ' || c_name || ' was missing; the current text was recorded.' WHEN again > 1 THEN c_name || ' went back to an earlier text.' ELSE c_name || ' changed at its source.' END AS summary
FROM l JOIN customer ON c_custkey = user_id WHERE n = 1 OR event_type <> last""")
def change_summaries(t: Tables) -> DataFrame:
    """What the reviews of changed sources say: users' events as texts of their customer's page, each change in its turn."""
    log = changes.versions(t.events, "user_id", "event_type", "ts", "event_id").where("change <> 'unchanged'")
    told = log.join(t.customer, F.col("user_id") == F.col("c_custkey"))
    return told.select(F.col("event_id").alias("id"), predicates.change_summary(F.col("c_name"), F.col("change") == "first", F.col("reverted")).alias("summary"))


@query("""WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'html' ELSE 'rtf' END AS ext, CASE page_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'rtf' END AS typ, html FROM pages)
SELECT page_id, CASE WHEN ext <> 'html' AND typ IS NOT NULL AND ext <> typ THEN NULL WHEN ext <> 'html' THEN ext ELSE typ END AS kind, typ IS NULL AND regexp_matches(html, '(?i)^\\s*(<!doctype html|<html)') AS html FROM p""")
def payload_kinds(t: Tables) -> DataFrame:
    k = F.col("page_id")
    url = F.concat(F.lit("https://www.example.org/f."), F.when(k % 4 == 0, "PDF").when(k % 4 == 1, "docx").when(k % 4 == 2, "html").otherwise("rtf"))
    mime = F.when(k % 3 == 0, "application/pdf; charset=x").when(k % 3 == 1, "Application/RTF").otherwise("text/plain")
    html = predicates.is_html(mime, F.when(k % 3 == 2, F.col("html")))
    return t.pages.select("page_id", predicates.document_kind(url, mime).alias("kind"), html.alias("html"))


@query("""SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
  coalesce(date_trunc('month', l_shipdate) = date_trunc('month', o_orderdate) AND l_returnflag = 'N', FALSE) OR coalesce(l_quantity < 10 AND l_linestatus = 'O', FALSE) AS backed FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def backed_dates(t: Tables) -> DataFrame:
    """A record's month against that of its source, and against the one that a reviewer read there, at equal precision."""
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    first = lambda c: F.date_format(F.trunc(c, "month"), "yyyy-MM-dd")
    precision = F.when(F.col("l_returnflag") == "N", "month").when(F.col("l_returnflag") == "A", "year")
    read = F.when(F.col("l_quantity") < 10, first("o_orderdate"))
    found = predicates.backs_date(first("o_orderdate"), F.lit("month"), first("l_shipdate"), precision, read, F.when(F.col("l_linestatus") == "O", "month").otherwise("day"))
    return rows.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), found.alias("backed"))


@query("""SELECT o_orderkey AS id, c_mktsegment = 'BUILDING' AND length(trim(o_orderpriority || CASE WHEN o_totalprice > 100000 THEN ' ' || c_name ELSE '   ' END)) >= 20 AND o_orderdate <= TIMESTAMP '2001-03-01' AS accepted
FROM orders JOIN customer ON o_custkey = c_custkey""")
def manual_reviews_accepted(t: Tables) -> DataFrame:
    """Inspections by hand that may be recorded: of manual sources, with notes, not from the future."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    notes = F.concat("o_orderpriority", F.when(F.col("o_totalprice") > 100_000, F.concat(F.lit(" "), "c_name")).otherwise("   "))
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "manual").otherwise("automatic")
    return rows.select(F.col("o_orderkey").alias("id"), predicates.manual_review_accepted(kind, notes, F.col("o_orderdate"), now()).alias("accepted"))


@query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber % 2 = 0 THEN 'policy' ELSE 'timeline_event' END AS kind, l_orderkey AS draft, CASE WHEN l_partkey % 3 = 0 THEN 'other' ELSE 'r' || l_orderkey END AS revision FROM lineitem)
SELECT id FROM r WHERE kind = 'policy' AND revision = 'r' || draft""")
def published_reviews(t: Tables) -> DataFrame:
    """Reviews whose very revision stands in the register."""
    key = F.col("l_orderkey")
    rows = t.lineitem.select((key * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_linenumber") % 2 == 0, "policy").otherwise("timeline_event").alias("kind"), key.alias("draft_id"), F.when(F.col("l_partkey") % 3 == 0, "other").otherwise(F.concat(F.lit("r"), key)).alias("revision"))
    records = t.orders.select(F.lit("policy").alias("kind"), F.col("o_orderkey").alias("id"), F.concat(F.lit("r"), "o_orderkey").alias("revision"))
    return predicates.published_from(rows, records)


@query(PUBLIC_SQL + """, f AS (SELECT o_orderkey AS id, o_orderkey AS related, CASE WHEN o_orderpriority LIKE '1%' THEN 'stale' ELSE 'verified' END AS v_status, o_orderdate + to_days((o_custkey % 5)::INTEGER - 2) AS checked,
    CASE WHEN o_totalprice > 250000 THEN sha256('other') WHEN o_totalprice > 150000 THEN sha256(o_orderkey::VARCHAR) END AS hash FROM orders)
SELECT f.id FROM f JOIN pub ON pub.id = f.related WHERE f.v_status = 'verified' AND f.hash IS NOT NULL AND f.checked <= TIMESTAMP '2001-03-01' + INTERVAL 5 MINUTE AND f.checked >= TIMESTAMP '2001-03-01' - INTERVAL 90 DAY
  AND f.checked >= pub.checked_at AND (pub.hash IS NULL OR pub.hash = f.hash)""")
def framework_gate(t: Tables) -> DataFrame:
    """Artifacts of records that the public sees with them."""
    price, checked = F.col("o_totalprice"), F.col("o_orderdate") + F.make_dt_interval((F.col("o_custkey") % 5 - 2).cast("int"))
    digest = F.when(price > 250_000, F.sha2(F.lit("other"), 256)).when(price > 150_000, F.sha2(F.col("o_orderkey").cast("string"), 256))
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("related"), F.when(F.col("o_orderpriority").startswith("1"), "stale").otherwise("verified").alias("v_status"), checked.alias("checked_at"), digest.alias("hash"))
    current = visibility.is_current(F.col("v_status"), F.lit("manual"), F.lit("Reviewer"), F.col("checked_at"), F.col("hash"), now())
    return visibility.gated(rows, public(t), current).select("id")


@query("""SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
  CASE WHEN l_quantity > 40 THEN 'Consultation' WHEN p_type = 'ECONOMY' THEN 'New' WHEN l_returnflag = 'R' THEN 'Update' WHEN l_linestatus = 'O' THEN 'Radar' ELSE 'Development' END AS kind,
  CASE WHEN l_shipdate <= TIMESTAMP '2001-03-01' AND l_shipdate >= TIMESTAMP '2001-03-01' - INTERVAL 30 DAY THEN 'new' WHEN o_orderstatus = 'P' THEN 'proposed' WHEN l_returnflag = 'A' THEN 'amended' WHEN o_orderstatus = 'O' THEN 'active' ELSE 'other' END AS drawn
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""")
def development_kinds(t: Tables) -> DataFrame:
    """What lineitems, as developments, are by their titles, and how their dates are drawn."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    title = F.concat(F.lit("The Part "), F.when(F.col("p_type") == "ECONOMY", "RELEASED ").otherwise(""), F.when(F.col("l_returnflag") == "R", "as Amended ").otherwise(""), F.when(F.col("l_quantity") > 40, "for Consultation").otherwise(""))
    status = F.when(F.col("o_orderstatus") == "P", "proposed").when(F.col("o_orderstatus") == "O", "active").otherwise("repealed")
    kind = F.when(F.col("l_returnflag") == "A", "amended").otherwise("introduced")
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), predicates.title_kind(title, F.when(F.col("l_linestatus") == "O", "heuristic").otherwise("ai")).alias("kind"),
        predicates.point_class(status, F.col("l_shipdate"), kind, now()).alias("drawn"),
    )


@query("""WITH r AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS date, strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS shown,
    CASE WHEN l_returnflag = 'N' THEN 'month' ELSE 'day' END AS shown_precision, l_linestatus = 'O' AS may, l_quantity > 25 AS told, l_tax < 0.05 AS right_date, l_discount < 0.06 AS noted, l_partkey % 3 = 0 AS kept FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
a AS (SELECT *, CASE WHEN may AND shown = date AND shown_precision = 'month' THEN 'metadata' WHEN told THEN CASE WHEN right_date AND noted THEN 'reviewer' END WHEN kept THEN 'earlier review' END AS basis FROM r)
SELECT id, basis, CASE WHEN basis IS NOT NULL THEN date END AS date, CASE WHEN basis = 'reviewer' THEN 'Read at the foot of the page.' END AS notes,
  CASE WHEN basis IS NULL THEN CASE WHEN NOT told THEN 'no evidence' WHEN NOT right_date THEN 'reviewed date differs' ELSE 'no notes' END END AS error FROM a""")
def bound_dates(t: Tables) -> DataFrame:
    """What backs the months of records: their sources' metadata, a reviewer, or an earlier review."""
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    first = lambda c: F.date_format(F.trunc(c, "month"), "yyyy-MM-dd")
    month, date = F.lit("month"), first("o_orderdate")
    metadata = F.struct(first("l_shipdate").alias("date"), F.when(F.col("l_returnflag") == "N", "month").otherwise("day").alias("precision"))
    notes = F.when(F.col("l_discount") < 0.06, "  Read at the foot of the page. ").otherwise(" seen ")
    told = F.when(F.col("l_quantity") > 25, F.struct(F.when(F.col("l_tax") < 0.05, date).otherwise("2001-01-01").alias("date"), F.when(F.col("l_tax") < 0.05, "month").otherwise("year").alias("precision"), notes.alias("notes")))
    kept = F.when(F.col("l_partkey") % 3 == 0, F.struct(date.alias("date"), month.alias("precision")))
    found = predicates.bound_date(date, month, metadata, told, kept, F.col("l_linestatus") == "O")
    return rows.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), found.alias("f")).select("id", F.col("f.by").alias("basis"), "f.date", "f.notes", "f.error")
