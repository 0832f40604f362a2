"""Register, visibility, timeline and facet queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dates, urls
from tidemark.operators import audit, changes, ranking, visibility
from tidemark.plans.base import REGISTER_SQL, REVIEWS_SQL, Tables, now, query, register, reviews


def current_column():
    return visibility.is_current(F.col("v_status"), F.col("method"), F.col("checked_by"), F.col("checked_at"), F.col("hash"), now())


def with_current(t: Tables) -> DataFrame:
    return register(t).withColumn("is_current", current_column())


def held_ids(t: Tables) -> DataFrame:
    records = register(t).select("id", "url", F.col("hash").alias("revision"))
    return visibility.withheld_ids(reviews(t), records)


def public(t: Tables) -> DataFrame:
    """Reviews are held against the records that are current only; whether others are withheld changes nothing."""
    current = register(t).where((F.col("status") != "trashed") & current_column())
    held = visibility.withheld_ids(reviews(t), current.select("id", "url", F.col("hash").alias("revision")))
    return visibility.public_records(current, held, F.lit(True))


PUBLIC_SQL = f"""WITH {REGISTER_SQL}, {REVIEWS_SQL},
vis AS (SELECT * FROM cur WHERE status <> 'trashed' AND is_current AND id NOT IN (SELECT id FROM held)),
pub AS (SELECT vis.* REPLACE (s.id AS superseded_by) FROM vis LEFT JOIN (SELECT DISTINCT id FROM vis) s ON vis.superseded_by = s.id)"""


@query(f"WITH {REGISTER_SQL} SELECT id, title, type, effective FROM reg WHERE jurisdiction = 'ASIA' AND status = 'O' AND (contains(lower(title), 'building') OR len(list_filter(tags, lambda x: contains(lower(x), 'building'))) > 0)")
def register_search(t: Tables) -> DataFrame:
    """Equality filters, then a search over title and tags, newest first."""
    needle = "building"
    rows = register(t).where((F.col("jurisdiction") == "ASIA") & (F.col("status") == "O"))
    found = F.contains(F.lower("title"), F.lit(needle)) | F.exists("tags", lambda x: F.contains(F.lower(x), F.lit(needle)))
    return rows.where(found).select("id", "title", "type", "effective").orderBy(F.col("effective").desc(), "id")


@query(f"WITH {REGISTER_SQL} SELECT id, title FROM reg WHERE url LIKE 'https://www.example.com/orders/77/?%'")
def register_by_url(t: Tables) -> DataFrame:
    """Lookup by the identity of a url that is written in another way."""
    asked = register(t).where("id = 77").select(urls.identity(F.regexp_replace("url", r"\?.*", "?gclid=1&b=2&a=")).alias("stem"))
    held = register(t).withColumn("identity", F.regexp_replace(urls.identity(F.col("url")), "a=[0-9]+", "a="))
    return held.join(asked, F.col("identity") == F.col("stem")).select("id", "title")


@query(f"WITH {REGISTER_SQL} SELECT id, is_current FROM cur")
def verification_current(t: Tables) -> DataFrame:
    return with_current(t).select("id", "is_current")


@query(f"""WITH {REGISTER_SQL}, r AS (SELECT *, CASE WHEN method <> 'manual' THEN 'No manual editorial verification is recorded; human re-verification is required.'
  WHEN trim(checked_by) = '' THEN 'No attributable editorial reviewer is recorded; human re-verification is required.'
  WHEN hash IS NOT NULL THEN 'Editorial review interval of 90 days expired; re-verification is required.'
  ELSE 'No reproducible source fingerprint is stored; fingerprinted re-verification is required.' END AS reason FROM cur)
SELECT id, CASE WHEN v_status = 'verified' AND NOT is_current THEN 'stale' ELSE v_status END AS status,
  CASE WHEN v_status = 'verified' AND NOT is_current THEN coalesce(notes || ' ', '') || reason ELSE notes END AS notes FROM r""")
def verification_stale_projection(t: Tables) -> DataFrame:
    shown = visibility.stale_projection(F.col("v_status"), F.col("method"), F.col("checked_by"), F.col("hash"), F.col("notes"), F.col("is_current"))
    return with_current(t).select("id", shown.alias("s")).select("id", "s.*")


@query(f"WITH {REGISTER_SQL}, {REVIEWS_SQL} SELECT id FROM held")
def withheld_ids(t: Tables) -> DataFrame:
    return held_ids(t)


@query(PUBLIC_SQL + " SELECT id, title, superseded_by FROM pub")
def register_public_view(t: Tables) -> DataFrame:
    return public(t).select("id", "title", "superseded_by")


@query(f"WITH {REGISTER_SQL} SELECT a.id, b.id AS superseded_by FROM reg a LEFT JOIN (SELECT id FROM reg WHERE status <> 'P') b ON a.superseded_by = b.id")
def supersession_masking(t: Tables) -> DataFrame:
    rows = register(t).select("id", "status", "superseded_by")
    return visibility.mask_reference(rows, "superseded_by", rows.where("status <> 'P'")).select("id", "superseded_by")


AGENCIES_SQL = """ag AS (SELECT s_suppkey AS id, s_name AS name, r_name AS jurisdiction, s_acctbal AS claim, coalesce(quality, 0) = 1 AS verified,
  CASE WHEN s_nationkey % 2 = 0 THEN 'federal' ELSE 'state' END AS level
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN labels ON s_suppkey = doc_id)"""


def agencies(t: Tables) -> DataFrame:
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).join(t.labels, F.col("s_suppkey") == F.col("doc_id"), "left")
    return rows.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("r_name").alias("jurisdiction"), F.col("s_acctbal").alias("claim"), (F.coalesce("quality", F.lit(0)) == 1).alias("verified"), F.when(F.col("s_nationkey") % 2 == 0, "federal").otherwise("state").alias("level"))


@query(PUBLIC_SQL + f""", {AGENCIES_SQL}, m AS (SELECT l_suppkey, list(DISTINCT l_orderkey ORDER BY l_orderkey) AS policies FROM lineitem WHERE l_orderkey IN (SELECT id FROM pub) GROUP BY l_suppkey)
SELECT ag.id, name, CASE WHEN verified THEN claim END AS claim, policies FROM ag LEFT JOIN m ON ag.id = l_suppkey""")
def agencies_redacted(t: Tables) -> DataFrame:
    """Claims of verified agencies only; their records cut to the public ones."""
    members = t.lineitem.groupBy(F.col("l_suppkey").alias("id")).agg(F.array_sort(F.collect_set("l_orderkey")).alias("policies"))
    rows = visibility.redacted(agencies(t).join(members, "id", "left"), F.col("verified"), ["claim"])
    return visibility.keep_public_members(rows, "id", "policies", public(t)).select("id", "name", "claim", "policies")


@query(f"WITH {AGENCIES_SQL} SELECT id, name FROM ag WHERE level = 'federal' AND jurisdiction = 'EUROPE'")
def agencies_filter(t: Tables) -> DataFrame:
    return agencies(t).where("level = 'federal' AND jurisdiction = 'EUROPE'").select("id", "name").orderBy(F.collate("name", "UNICODE"), "id")


@query(f"WITH {AGENCIES_SQL} SELECT count(*) AS total, count(*) FILTER (verified) AS with_statement, count(*) FILTER (NOT verified) AS without_statement, count(*) FILTER (claim < 0) AS awaiting FROM ag")
def agency_stats(t: Tables) -> DataFrame:
    return agencies(t).agg(F.count("*").alias("total"), F.count_if("verified").alias("with_statement"), F.count_if(~F.col("verified")).alias("without_statement"), F.count_if(F.col("claim") < 0).alias("awaiting"))


DATES_SQL = """d AS (SELECT l_orderkey AS id, list({'n': l_linenumber, 'date': strftime(l_shipdate, '%Y-%m-%d'), 'flag': l_returnflag} ORDER BY l_linenumber, l_shipdate, l_returnflag) AS dates FROM lineitem GROUP BY l_orderkey)"""


def dated(t: Tables) -> DataFrame:
    each = F.struct(F.col("l_linenumber").alias("n"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.col("l_returnflag").alias("flag"))
    return t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(each)).alias("dates"))


@query(f"WITH {REGISTER_SQL}, {DATES_SQL} SELECT reg.id, coalesce(list_filter(dates, lambda x: x.flag = 'R')[1].date, dates[1].date, effective) AS date FROM reg LEFT JOIN d USING (id)")
def primary_date(t: Tables) -> DataFrame:
    """The first primary date, else the first, else the effective one."""
    rows = register(t).join(dated(t), "id", "left")
    shaped = F.transform("dates", lambda x: F.struct(x["flag"].alias("type"), x["date"].alias("date"), F.lit("day").alias("precision"), (x["flag"] == "R").alias("primary")))
    return rows.select("id", dates.primary(shaped, F.col("effective"))["date"].alias("date"))


@query(f"""WITH {REGISTER_SQL}, {DATES_SQL}, e AS (SELECT reg.id, status, list_filter(dates, lambda x: x.flag = 'R')[1].date AS repealed, list_filter(dates, lambda x: x.flag = 'A')[1].date AS amended, dates[1].date AS first, dates FROM reg LEFT JOIN d USING (id))
SELECT id, CASE WHEN dates IS NULL THEN 'introduced' WHEN status = 'F' AND repealed IS NOT NULL THEN 'repealed' WHEN status = 'P' AND amended IS NOT NULL THEN 'amended' ELSE 'introduced' END AS type,
  CASE WHEN dates IS NULL THEN NULL WHEN status = 'F' AND repealed IS NOT NULL THEN repealed WHEN status = 'P' AND amended IS NOT NULL THEN amended ELSE first END AS date FROM e""")
def timeline_generated(t: Tables) -> DataFrame:
    """One event for each record, by its status and dates."""
    of = lambda flag: F.try_element_at(F.filter("dates", lambda x: x["flag"] == flag), F.lit(1))["date"]
    none, repealed, amended = F.col("dates").isNull(), (F.col("status") == "F") & of("R").isNotNull(), (F.col("status") == "P") & of("A").isNotNull()
    rows = register(t).join(dated(t), "id", "left")
    return rows.select(
        "id",
        F.when(none, "introduced").when(repealed, "repealed").when(amended, "amended").otherwise("introduced").alias("type"),
        F.when(none, F.lit(None)).when(repealed, of("R")).when(amended, of("A")).otherwise(F.try_element_at("dates", F.lit(1))["date"]).alias("date"),
    )


@query(PUBLIC_SQL + """, ev AS (SELECT DISTINCT l_orderkey AS related, l_linenumber AS n, strftime(l_shipdate, '%Y-%m-%d') AS date FROM lineitem WHERE l_returnflag <> 'N' AND l_orderkey IN (SELECT id FROM pub))
SELECT related AS id, n::BIGINT AS n, date, 'manual' AS origin FROM ev UNION ALL SELECT id, 0, effective, 'generated' FROM pub WHERE id NOT IN (SELECT related FROM ev)""")
def timeline_register_scope(t: Tables) -> DataFrame:
    """Manual events of public records, and a generated one for each public record without any."""
    seen = public(t).select("id", "effective")
    events = t.lineitem.where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("n"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date")).distinct().join(seen.select("id"), "id", "left_semi")
    generated = seen.join(events.select("id"), "id", "left_anti").select("id", F.lit(0).cast("long").alias("n"), F.col("effective").alias("date"))
    return events.withColumn("origin", F.lit("manual")).unionByName(generated.withColumn("origin", F.lit("generated"))).orderBy("date", "id", "n")


@query(f"WITH {REGISTER_SQL} SELECT count(*) AS n_events, count(DISTINCT left(effective, 4)) AS years, count(DISTINCT jurisdiction) AS jurisdictions, count(*) FILTER (v_status = 'verified') AS verified FROM reg")
def timeline_stats(t: Tables) -> DataFrame:
    return register(t).agg(F.count("*").alias("n_events"), F.count_distinct(F.left("effective", F.lit(4))).alias("years"), F.count_distinct("jurisdiction").alias("jurisdictions"), F.count_if(F.col("v_status") == "verified").alias("verified"))


@query(f"WITH {REGISTER_SQL} SELECT 'jurisdiction' AS facet, jurisdiction AS value, count(*) AS n FROM reg GROUP BY ALL UNION ALL SELECT 'type', type, count(*) FROM reg GROUP BY ALL UNION ALL SELECT 'status', status, count(*) FROM reg GROUP BY ALL")
def facet_counts(t: Tables) -> DataFrame:
    """Three facets in one pass, as grouping sets."""
    rows = register(t).select("jurisdiction", "type", "status")
    sets = rows.groupingSets([["jurisdiction"], ["type"], ["status"]], "jurisdiction", "type", "status").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    facet = F.when(F.col("g") == 3, "jurisdiction").when(F.col("g") == 5, "type").otherwise("status")
    return sets.select(facet.alias("facet"), F.coalesce("jurisdiction", "type", "status").alias("value"), "n")


@query(f"WITH {REGISTER_SQL}, g AS (SELECT r_name AS jurisdiction, count(id) AS n, count(id) FILTER (status = 'O') AS active FROM region LEFT JOIN reg ON r_name = jurisdiction GROUP BY r_name) SELECT *, CASE WHEN n = 0 THEN 0 ELSE ceil(4 * n / greatest(max(n) OVER (), 1))::BIGINT END AS class FROM g")
def jurisdiction_stats(t: Tables) -> DataFrame:
    """Counts for all jurisdictions, 0 included, and the class of each against the largest."""
    counts = register(t).groupBy("jurisdiction").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "O").alias("active"))
    every = t.region.select(F.col("r_name").alias("jurisdiction")).join(counts, "jurisdiction", "left").na.fill(0, ["n", "active"])
    most = every.agg(F.greatest(F.max("n"), F.lit(1)).alias("most"))
    return every.crossJoin(most).withColumn("class", F.when(F.col("n") == 0, 0).otherwise(F.ceil(F.col("n") * 4 / F.col("most"))).cast("long")).drop("most")  # one row


@query(f"WITH {REGISTER_SQL} SELECT year, n, sum(n) OVER (ORDER BY year DESC)::BIGINT AS running FROM (SELECT left(effective, 4) AS year, count(*) AS n FROM reg GROUP BY 1)")
def year_groups(t: Tables) -> DataFrame:
    counts = register(t).groupBy(F.left("effective", F.lit(4)).alias("year")).agg(F.count("*").alias("n"))
    return counts.withColumn("running", F.sum("n").over(Window.orderBy(F.col("year").desc())))  # a row for each year


@query(f"WITH {REGISTER_SQL} SELECT upper(strftime(checked_at, '%B %Y')) AS month, count(*) AS n, min(id) AS first FROM reg GROUP BY 1")
def month_groups(t: Tables) -> DataFrame:
    return register(t).groupBy(F.upper(F.date_format("checked_at", "MMMM yyyy")).alias("month")).agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query(f"WITH {REGISTER_SQL} SELECT count(*) AS n FROM reg WHERE checked_at >= TIMESTAMP '2001-03-01' - INTERVAL 7 DAY")
def weekly_count(t: Tables) -> DataFrame:
    return register(t).where(F.col("checked_at") >= now() - F.expr("INTERVAL 7 DAYS")).agg(F.count("*").alias("n"))


@query(f"WITH {REGISTER_SQL} SELECT id, title FROM reg ORDER BY title DESC, id LIMIT 20 OFFSET 40")
def page_of_register(t: Tables) -> DataFrame:
    """The third page of twenty, by title downwards."""
    return register(t).select("id", "title").orderBy(F.col("title").desc(), "id").offset(40).limit(20)


@query(f"WITH {REGISTER_SQL} SELECT id, title, effective FROM reg WHERE v_status = 'verified' ORDER BY effective DESC, id LIMIT 6")
def latest_verified(t: Tables) -> DataFrame:
    return register(t).where("v_status = 'verified'").select("id", "title", "effective").orderBy(F.col("effective").desc(), "id").limit(6)


@query(f"WITH {REGISTER_SQL} SELECT min(effective) AS first, max(effective) AS last, greatest(date_diff('day', min(effective)::DATE, max(effective)::DATE), 1) AS days FROM reg")
def register_extent(t: Tables) -> DataFrame:
    return register(t).agg(F.min("effective").alias("first"), F.max("effective").alias("last"), F.greatest(F.date_diff(F.max("effective").cast("date"), F.min("effective").cast("date")), F.lit(1)).cast("long").alias("days"))


@query(f"""WITH {REGISTER_SQL}, p AS (SELECT id, jurisdiction, row_number() OVER (PARTITION BY jurisdiction ORDER BY effective, id) - 1 AS i, date_diff('day', DATE '1995-01-01', effective::DATE) AS day FROM reg)
SELECT id, (i % 3)::BIGINT AS row, least(greatest(day / 2500.0 * 100, 0.6), 99.4)::DOUBLE AS x FROM p""")
def timeline_positions(t: Tables) -> DataFrame:
    w = Window.partitionBy("jurisdiction").orderBy("effective", "id")
    x = F.date_diff(F.col("effective").cast("date"), F.lit("1995-01-01").cast("date")) / F.lit(2500.0) * 100
    return register(t).select("id", ((F.row_number().over(w) - 1) % 3).cast("long").alias("row"), F.least(F.greatest(x, F.lit(0.6)), F.lit(99.4)).alias("x"))


@query(f"WITH {REGISTER_SQL}, {REVIEWS_SQL} SELECT target_id, review_id, (sequence, discovered, review_id) < max((sequence, discovered, review_id)) OVER (PARTITION BY target_id) AS superseded FROM rev WHERE target_id IS NOT NULL")
def newer_versions(t: Tables) -> DataFrame:
    rows = reviews(t).where("target_id IS NOT NULL")
    return visibility.has_newer_version(rows, "target_id", "sequence", "discovered", "review_id").select("target_id", "review_id", "superseded")


@query(f"WITH {REGISTER_SQL}, {REVIEWS_SQL} SELECT target_id AS id, arg_max(status, (sequence, discovered, review_id)) AS status FROM rev WHERE target_id IS NOT NULL GROUP BY target_id")
def latest_review(t: Tables) -> DataFrame:
    rows = reviews(t).where("target_id IS NOT NULL").withColumn("order", F.struct("sequence", "discovered", "review_id"))
    return ranking.last_value_by(rows, "target_id", "status", "order").withColumnRenamed("target_id", "id")


@query(f"WITH {REGISTER_SQL}, {REVIEWS_SQL}, a AS (SELECT DISTINCT target_id AS id, url AS alias FROM rev WHERE target_id IS NOT NULL UNION SELECT id, identity FROM uid UNION SELECT id, 'https://www.example.com/orders/' || superseded_by FROM reg WHERE superseded_by IS NOT NULL), s AS (SELECT alias FROM a GROUP BY alias HAVING min(id) <> max(id)) SELECT id, alias FROM a JOIN s USING (alias)")
def identity_alias_collisions(t: Tables) -> DataFrame:
    """Records that share an alias of their sources."""
    own = register(t).select("id", urls.identity(F.col("url")).alias("alias"))
    told = reviews(t).where("target_id IS NOT NULL").select(F.col("target_id").alias("id"), urls.identity(F.col("url")).alias("alias"))
    moved = register(t).where("superseded_by IS NOT NULL").select("id", urls.identity(F.concat(F.lit("https://www.example.com/orders/"), "superseded_by", F.lit("/"))).alias("alias"))
    held = own.unionByName(told).unionByName(moved).groupBy("id").agg(F.collect_set("alias").alias("aliases"))
    return audit.collisions(held)


@query(f"""WITH {REGISTER_SQL}, n AS (SELECT id, 'https://www.example.com/orders/' || (id + CASE WHEN id % 50 = 0 THEN 1 ELSE 0 END) AS stem, lower(title) AS title, tags FROM reg)
SELECT id, 'url' AS found FROM n WHERE stem = 'https://www.example.com/orders/51' UNION SELECT id, 'text' FROM n WHERE contains(title, '#000000051') OR len(list_filter(tags, lambda x: contains(lower(x), '#000000051'))) > 0""")
def coverage_lookup(t: Tables) -> DataFrame:
    """Records that cover a url, or a text in their title or tags."""
    rows = register(t).select("id", F.lower("title").alias("title"), "tags", F.concat(F.lit("https://www.example.com/orders/"), F.col("id") + F.when(F.col("id") % 50 == 0, 1).otherwise(0)).alias("stem"))
    by_url = rows.where(urls.identity(F.col("stem")) == "https://www.example.com/orders/51").select("id", F.lit("url").alias("found"))
    text = F.contains("title", F.lit("#000000051")) | F.exists("tags", lambda x: F.contains(F.lower(x), F.lit("#000000051")))
    return by_url.unionByName(rows.where(text).select("id", F.lit("text").alias("found")))


@query(f"""WITH {REGISTER_SQL}, x AS (SELECT reg.id, jurisdiction, tags FROM reg WHERE id = 10), c AS (SELECT r.id FROM reg r, x WHERE r.id <> x.id AND (r.jurisdiction = x.jurisdiction OR list_has_any(r.tags, x.tags)) ORDER BY r.id LIMIT 3) SELECT id FROM c""")
def related_records(t: Tables) -> DataFrame:
    """Up to three others of the same jurisdiction or with a common tag: two equi-joins, not one with OR."""
    rows = register(t).select("id", "jurisdiction", "tags")
    one = rows.where("id = 10")
    near = rows.join(one.select("jurisdiction"), "jurisdiction").select("id")
    tagged = rows.select("id", F.explode("tags").alias("tag")).join(one.select(F.explode("tags").alias("tag")), "tag").select("id")
    return near.unionByName(tagged).where("id <> 10").distinct().orderBy("id").limit(3)


@query(f"WITH {REGISTER_SQL}, r AS (SELECT id, v_status, CASE WHEN id % 4 = 0 THEN 'changed' WHEN id % 4 = 1 THEN 'unavailable' WHEN id % 4 = 2 THEN 'unchanged' END AS outcome FROM reg) SELECT id, CASE outcome WHEN 'changed' THEN 'stale' WHEN 'unavailable' THEN 'unreachable' ELSE v_status END AS status, CASE WHEN outcome IS NOT NULL THEN '2001-03-01' END AS last_audit FROM r")
def audit_apply(t: Tables) -> DataFrame:
    records = register(t).select("id", F.col("v_status").alias("status"), F.lit(None).cast("string").alias("last_audit"))
    outcome = F.when(F.col("id") % 4 == 0, "changed").when(F.col("id") % 4 == 1, "unavailable").when(F.col("id") % 4 == 2, "unchanged")
    results = register(t).select("id", outcome.alias("outcome")).where("outcome IS NOT NULL")
    return audit.applied(records, results, F.lit("2001-03-01"))


@query("""WITH d AS (SELECT l_orderkey AS id, l_partkey AS k, l_linenumber AS o, l_suppkey AS h FROM lineitem),
a AS (SELECT id, k, arg_max(h, (o, h)) AS old FROM d WHERE o <= 4 GROUP BY id, k), b AS (SELECT id, k, arg_max(h, (o, h)) AS new FROM d WHERE o >= 3 GROUP BY id, k),
f AS (SELECT coalesce(a.id, b.id) AS id, old, new FROM a FULL JOIN b ON a.id = b.id AND a.k = b.k)
SELECT id, bool_and(old IS NOT NULL AND new IS NOT NULL) AS same_set, bool_and(coalesce(old = new, FALSE)) AS same_content FROM f GROUP BY id""")
def audit_compare(t: Tables) -> DataFrame:
    """Linked documents before and now: the same set, the same content."""
    docs = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("identity"), F.col("l_suppkey").alias("hash"), F.struct("l_linenumber", "l_suppkey").alias("ord"), "l_linenumber")
    return audit.linked_documents(docs.where("l_linenumber <= 4").drop("l_linenumber"), docs.where("l_linenumber >= 3").drop("l_linenumber"))


@query(f"""WITH {REGISTER_SQL}, {REVIEWS_SQL}, last AS (SELECT target_id AS id, arg_max(status, (sequence, review_id, status)) AS review FROM rev WHERE target_id IS NOT NULL GROUP BY target_id),
d AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'dismissed' ELSE 'detected' END AS status FROM reg WHERE jurisdiction <> 'ASIA')
SELECT id, s AS status FROM (SELECT coalesce(d.id, last.id) AS id, CASE WHEN review = 'rejected' AND status IS NOT NULL THEN 'dismissed' WHEN review = 'published' AND status = 'detected' THEN 'promoted'
  WHEN status IS NULL AND review IN ('pending_review', 'approved') THEN 'detected' ELSE status END AS s FROM d FULL JOIN last ON d.id = last.id) WHERE s IS NOT NULL""")
def reconcile_developments(t: Tables) -> DataFrame:
    from tidemark.operators.workflow import reconciled

    held = register(t).where("jurisdiction <> 'ASIA'").select("id", F.when(F.col("id") % 3 == 0, "dismissed").otherwise("detected").alias("status"))
    told = reviews(t).where("target_id IS NOT NULL").select(F.col("target_id").alias("development_id"), "status", F.struct("sequence", "review_id", "status").alias("ord"))
    return reconciled(held, told)


@query(f"""WITH {REGISTER_SQL}, p AS (SELECT * FROM reg WHERE status = 'O'), a AS (SELECT o_orderkey AS id, o_orderdate FROM orders)
SELECT p.id, 'https://www.example.com/records/' || p.id AS loc, strftime(o_orderdate, '%Y-%m-%d') AS modified FROM p JOIN a USING (id) UNION ALL SELECT NULL, 'https://www.example.com/' || x, NULL FROM (VALUES (''), ('register'), ('timeline'), ('network'), ('about')) v(x)""")
def sitemap(t: Tables) -> DataFrame:
    """Fixed pages and a row for each open record."""
    base = "https://www.example.com/"
    fixed = t.spark.createDataFrame([(None, base + x, None) for x in ("", "register", "timeline", "network", "about")], "id long, loc string, modified string")
    rows = register(t).where("status = 'O'").select("id", F.concat(F.lit(base + "records/"), "id").alias("loc"), F.date_format("checked_at", "yyyy-MM-dd").alias("modified"))
    return rows.unionByName(fixed)


@query(f"WITH {REGISTER_SQL} SELECT count(*) AS records, max(effective) AS latest, floor(100.0 * count(*) FILTER (is_current) / count(*) + 0.5)::BIGINT AS current_percent FROM cur")
def status_summary(t: Tables) -> DataFrame:
    return with_current(t).agg(F.count("*").alias("records"), F.max("effective").alias("latest"), changes.percent(F.count_if("is_current"), F.count("*")).alias("current_percent"))
