"""Queries over the editorial workflow: staged sources approved, published and rejected, many requests in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.json_text import revision
from tidemark.operators import publication
from tidemark.plans.base import Tables, query
from tidemark.tables import cut

SITE = "https://www.example.com"


def records(t: Tables) -> DataFrame:
    """Parts as records."""
    content = F.concat(F.lit('{"title":"'), "p_name", F.lit('","size":'), "p_size", F.lit("}"))
    return t.part.select(F.col("p_partkey").alias("id"), F.concat(F.lit(f"{SITE}/parts/"), "p_partkey", F.lit("?utm_source=a")).alias("url"), content.alias("content"))


def lines(t: Tables) -> DataFrame:
    """Lineitems with their part, met once and written as a small table: reviews and requests are both read from it."""
    rows = t.lineitem.join(t.part.select("p_partkey", "p_name", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return cut(rows.drop("p_partkey")).withColumn("_none", F.lit(None).cast("string"))


def name() -> Column:
    """The id of a line's review, or of one that isn't there; that of an order without a key is null."""
    known = F.col("_none").isNull() | F.col("l_orderkey").isNotNull()
    return F.when(known, F.concat_ws("-", "_none", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))


def staged(rows: DataFrame, *more: str) -> DataFrame:
    """Lines as reviews of parts or of new sources; what varies depends on columns of its own."""
    flag, tax, part = F.col("l_returnflag"), F.round("l_tax", 2), F.col("l_partkey")
    target = F.when(F.col("l_quantity") > 12, part)
    status = F.when(flag == "A", "approved").when(flag == "R", "rejected").when(F.col("l_linestatus") == "O", "pending_review").otherwise("published")
    own = F.concat(F.lit(f"{SITE}/parts/"), part)
    url = F.when(target.isNotNull(), F.when(tax == 0.08, F.concat(F.lit(f"{SITE}/moved/"), part)).otherwise(own)).when(tax == 0.01, own).otherwise(F.concat(F.lit(f"{SITE}/new/"), "l_orderkey", F.lit("/")))
    size = F.when(F.col("l_linenumber") == 3, F.col("p_size")).otherwise(F.col("l_quantity").cast("int"))
    day = lambda n: F.col("l_shipdate") + F.make_dt_interval(F.lit(n))
    return rows.select(
        name().alias("id"),
        status.alias("status"),
        url.alias("url"),
        F.sha2(F.col("l_suppkey").cast("string"), 256).alias("hash"),
        F.when(F.round("l_discount", 2) < 0.1, F.col("l_linenumber")).alias("sequence"),
        F.col("l_shipdate").alias("discovered"),
        target.alias("target_id"),
        F.when(F.round("l_discount", 2) < 0.05, F.concat(own, F.lit("/#old"))).alias("previous_url"),
        F.when(target.isNotNull(), F.when(F.round("l_discount", 2) <= 0.06, revision(F.concat(F.lit('{"title":"'), "p_name", F.lit('","size":'), "p_size", F.lit("}")))).otherwise(F.sha2(F.lit("old"), 256))).alias("target_revision"),
        F.when(tax == 0.02, part).otherwise(F.col("l_orderkey") + 10_000_000).alias("proposed_id"),
        F.concat(F.lit('{"size": '), size, F.lit(', "title":"'), "p_name", F.lit('"}')).alias("proposed"),
        F.when(status.isin("approved", "published"), day(10)).alias("reviewed"),
        F.when(status == "published", day(20)).alias("published"),
        F.lit(None).cast("string").alias("reason"),
        F.struct("l_quantity", tax.alias("tax"), "l_extendedprice", "l_linenumber", "l_suppkey", "l_shipdate", *more).alias("_of"),
    )


def requests(t: Tables, rows: DataFrame) -> DataFrame:
    """A request for each review, two for the first lines of an order, and one for a review that isn't there for each order.

    The lines are dealt by the review's id before it and requests are made of them, as their columns take less room and requests
    are then where their reviews come to.
    """
    of = lambda c: F.col(f"_of.{c}")
    lost = t.orders.select(F.lit("none").alias("_none"), F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("l_shipdate"))
    dealt = rows.unionByName(lost, allowMissingColumns=True).repartition(name())
    mine = lambda c, none: F.when(of("_none").isNotNull(), none).otherwise(c)
    days = mine((of("l_extendedprice") / 500).cast("int") - 3, 0)
    asks = [F.struct(F.lit(tail).alias("tail"), F.lit(n).alias("later")) for tail, n in (("", 0), ("/a", 0), ("/b", 1))]
    each = F.when(of("_none").isNotNull(), F.array(asks[0])).when(of("l_linenumber") < 3, F.array(*asks[1:])).otherwise(F.array(asks[1]))
    held = staged(dealt, "_none").select(
        F.col("id").alias("review_id"), mine(F.when(of("l_extendedprice") > 8000, F.col("hash")).otherwise(F.sha2(F.lit("x"), 256)), "").alias("live_hash"),
        (of("l_shipdate") + F.make_dt_interval(days)).alias("at"), mine(F.when(of("tax") == 0.03, " ").otherwise("Ann"), "Ann").alias("by"),
        mine(F.when(of("l_suppkey") % 5 != 0, publication.review_revision()).otherwise("old"), "").alias("expected"), F.explode(each).alias("_ask"),
    )
    return held.select("review_id", "live_hash", (F.col("at") + F.make_dt_interval("_ask.later")).alias("at"), "by", "expected", F.concat("review_id", "_ask.tail").alias("request_id"))


ROLES_SQL = """WITH p AS (SELECT p_partkey AS id, 'https://www.example.com/parts/' || p_partkey AS url, p_name AS name, p_size AS size, sha256('{"size":' || p_size || ',"title":"' || p_name || '"}') AS revision FROM part),
l AS (SELECT *, round(l_tax, 2) AS tax, round(l_discount, 2) AS off, CASE WHEN l_quantity > 12 THEN l_partkey END AS target FROM lineitem),
v AS MATERIALIZED (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
    CASE WHEN l_returnflag = 'A' THEN 'approved' WHEN l_returnflag = 'R' THEN 'rejected' WHEN l_linestatus = 'O' THEN 'pending_review' ELSE 'published' END AS status,
    CASE WHEN target IS NOT NULL AND tax = 0.08 THEN 'https://www.example.com/moved/' || l_partkey WHEN target IS NOT NULL OR tax = 0.01 THEN 'https://www.example.com/parts/' || l_partkey ELSE 'https://www.example.com/new/' || l_orderkey END AS url,
    CASE WHEN off < 0.1 THEN l_linenumber END AS sequence, l_shipdate AS discovered, target, off < 0.05 AS had_old, off <= 0.06 AS seen_revision,
    CASE WHEN tax = 0.02 THEN l_partkey ELSE l_orderkey + 10000000 END AS proposed_id, CASE WHEN l_linenumber = 3 THEN p_size ELSE l_quantity::INT END AS size, p_name AS name,
    l_shipdate + INTERVAL 10 DAY AS reviewed, l_extendedprice > 8000 AS live, tax <> 0.03 AS signed, l_suppkey % 5 <> 0 AS expected, l_linenumber AS line,
    l_shipdate + to_days(trunc(l_extendedprice / 500)::INT - 3) AS asked FROM l JOIN part ON l_partkey = p_partkey),
o AS MATERIALIZED (SELECT url, min(id) AS first, max(id) AS last FROM v WHERE status IN ('pending_review', 'approved') GROUP BY url),
q AS (SELECT id || '/a' AS request_id, id AS review_id, asked AS tm FROM v UNION ALL SELECT id || '/b', id, asked + INTERVAL 1 DAY FROM v WHERE line < 3
  UNION ALL SELECT 'none-' || o_orderkey, 'none-' || o_orderkey, o_orderdate FROM orders),
m AS MATERIALIZED (SELECT q.*, v.* EXCLUDE (asked), t.url AS t_url, t.revision AS t_revision, t.size AS t_size, t.name AS t_name, i.url AS own_url, i.size AS own_size, i.name AS own_name, w.id AS owner, w.size AS owner_size, w.name AS owner_name, o.first, o.last,
    t.id IS NOT NULL AND t.url <> v.url AND NOT (had_old AND t.url = 'https://www.example.com/parts/' || v.target) AS target_moved
  FROM q LEFT JOIN v ON v.id = review_id LEFT JOIN p t ON t.id = target LEFT JOIN p i ON i.id = CASE WHEN target IS NULL THEN proposed_id END LEFT JOIN p w ON w.url = v.url LEFT JOIN o ON o.url = v.url)
"""
EARLIEST_SQL = "CASE WHEN outcome = 'applied' AND {key} IS NOT NULL AND row_number() OVER (PARTITION BY {key}, outcome ORDER BY tm, request_id) > 1 THEN '{late}' ELSE outcome END AS outcome"
APPROVALS_SQL = ROLES_SQL + """, a AS (SELECT *, CASE WHEN id IS NULL THEN 'missing' WHEN status IN ('published', 'rejected') THEN status WHEN NOT expected THEN 'changed' WHEN NOT live THEN 'source_changed'
    WHEN NOT signed THEN 'no_reviewer' WHEN tm < discovered THEN 'before_discovery' WHEN target_moved THEN 'target_moved' WHEN own_url <> url THEN 'id_taken'
    WHEN target IS NULL AND owner IS NOT NULL AND (owner_size, owner_name) <> (size, name) THEN 'source_taken' WHEN target IS NOT NULL AND owner <> target THEN 'source_taken'
    WHEN target IS NULL AND (first <> id OR last <> id) THEN 'source_staged' ELSE 'applied' END AS outcome FROM m)
SELECT request_id, review_id, """ + EARLIEST_SQL.format(key="id", late="late") + ", t_revision AS target_revision FROM a"
PUBLISHED_SQL = ROLES_SQL + """, n AS (SELECT target, max(struct_pack(s := coalesce(sequence, -1), d := discovered, i := id)) AS newest FROM v WHERE target IS NOT NULL AND status <> 'rejected' GROUP BY target),
b AS (SELECT m.*, id IS NOT NULL AND coalesce(CASE WHEN m.target IS NOT NULL THEN (t_size, t_name) = (size, name) WHEN own_url IS NOT NULL THEN (own_size, own_name) = (size, name) ELSE (owner_size, owner_name) = (size, name) END, FALSE) AS own,
    newest FROM m LEFT JOIN n ON n.target = m.target),
c AS (SELECT *, CASE WHEN target IS NULL THEN url END AS new_url, CASE WHEN id IS NULL THEN 'missing' WHEN status IN ('published', 'rejected') THEN status WHEN status <> 'approved' THEN 'not_approved' WHEN tm < reviewed THEN 'before_approval'
    WHEN tm > reviewed + INTERVAL 90 DAY THEN 'expired' WHEN struct_pack(s := coalesce(sequence, -1), d := discovered, i := id) < newest THEN 'newer_version' WHEN NOT live THEN 'source_changed' WHEN target_moved THEN 'target_moved'
    WHEN target IS NOT NULL AND NOT own AND NOT seen_revision THEN 'target_changed' WHEN target IS NULL AND NOT own AND (own_url IS NOT NULL OR owner IS NOT NULL) THEN 'source_taken' ELSE 'applied' END AS outcome FROM b),
d AS (SELECT * EXCLUDE (outcome), """ + EARLIEST_SQL.format(key="id", late="late") + """ FROM c),
u AS MATERIALIZED (SELECT * EXCLUDE (outcome), """ + EARLIEST_SQL.format(key="new_url", late="source_taken") + " FROM d)\n"


@query(APPROVALS_SQL)
def workflow_approvals(t: Tables) -> DataFrame:
    """What each request to approve comes to."""
    rows = lines(t)
    made = publication.approvals(requests(t, rows), staged(rows).drop("_of"), records(t))
    return made.select("request_id", "review_id", "outcome", "target_revision")


@query(PUBLISHED_SQL + "SELECT request_id, review_id, outcome, own, t_revision AS target_revision FROM u")
def workflow_publications(t: Tables) -> DataFrame:
    """What each request to publish comes to, own half-written changes marked."""
    rows = lines(t)
    made = publication.publications(requests(t, rows), staged(rows).drop("_of"), records(t))
    return made.select("request_id", "review_id", "outcome", "own", "target_revision")


@query(ROLES_SQL + """, a AS (SELECT *, CASE WHEN id IS NULL THEN 'missing' WHEN status IN ('published', 'rejected') THEN status WHEN target IS NOT NULL THEN 'tracked' WHEN tm < discovered THEN 'before_discovery' ELSE 'applied' END AS outcome FROM m),
b AS (SELECT *  EXCLUDE (outcome), """ + EARLIEST_SQL.format(key="id", late="late") + """ FROM a)
SELECT v.id, CASE WHEN b.tm IS NOT NULL THEN 'rejected' ELSE v.status END AS status, coalesce(b.tm, CASE WHEN v.status IN ('approved', 'published') THEN v.reviewed END) AS reviewed, CASE WHEN b.tm IS NOT NULL THEN 'rejected by a reviewer' END AS reason
FROM v LEFT JOIN b ON b.review_id = v.id AND b.outcome = 'applied'""")
def workflow_rejected(t: Tables) -> DataFrame:
    """Reviews after the requests to reject them."""
    rows = lines(t)
    bare = staged(rows).drop("_of")
    return publication.rejected(publication.rejections(requests(t, rows), bare, records(t)), bare).select("id", "status", "reviewed", "reason")


def _published(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = lines(t)
    bare, held = staged(rows).drop("_of"), records(t)
    # the few that pass are written, so that what decided them is done once and its shuffles go
    return publication.published(cut(publication.publications(requests(t, rows), bare, held, passing=True)), bare, held)


@query(PUBLISHED_SQL + """, x AS (SELECT target, max(struct_pack(s := coalesce(sequence, -1), d := discovered, i := id)) AS newest FROM u WHERE outcome = 'applied' AND target IS NOT NULL GROUP BY target),
y AS (SELECT v.*, u.tm, x.newest, u.tm IS NULL AND v.status IN ('pending_review', 'approved') AND coalesce(struct_pack(s := coalesce(v.sequence, -1), d := v.discovered, i := v.id) < x.newest, FALSE) AS older
  FROM v LEFT JOIN u ON u.review_id = v.id AND u.outcome = 'applied' LEFT JOIN x ON x.target = v.target)
SELECT id, CASE WHEN tm IS NOT NULL THEN 'published' WHEN older THEN 'rejected' ELSE status END AS status, coalesce(tm, CASE WHEN status = 'published' THEN discovered + INTERVAL 20 DAY END) AS published,
  CASE WHEN older THEN 'Superseded by newer source update ' || newest.i END AS reason FROM y""")
def workflow_reviews_published(t: Tables) -> DataFrame:
    """Reviews after the publications; older open ones of the same record are closed."""
    return _published(t)[0].select("id", "status", "published", "reason")


@query(PUBLISHED_SQL + """, w AS (SELECT coalesce(target, proposed_id) AS id, url, size, name FROM u WHERE outcome = 'applied')
SELECT coalesce(w.id, p.id) AS id, CASE WHEN w.id IS NULL THEN p.url || '?utm_source=a' WHEN w.url LIKE '%/new/%' THEN w.url || '/' ELSE w.url END AS url,
  CASE WHEN w.id IS NULL THEN '{"title":"' || p.name || '","size":' || p.size || '}' ELSE '{"size": ' || w.size || ', "title":"' || w.name || '"}' END AS content FROM p FULL JOIN w ON w.id = p.id""")
def workflow_records_published(t: Tables) -> DataFrame:
    """Records after the publications: targets replaced, new sources added."""
    return _published(t)[1]
