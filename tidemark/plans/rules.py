"""Validators over roles of the tables. The roles are written once, in SQL that both engines read; the rules are not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import validators
from tidemark.plans.base import NOW, Tables, now, query

PLACES = ("AFRICA", "AMERICA", "ASIA", "EUROPE")
EVENTS = ("introduced", "amended", "repealed")


def scope() -> validators.Scope:
    return validators.Scope([".example.org"], PLACES, now(), EVENTS)


def role(t: Tables, sql: str) -> DataFrame:
    """A role's rows from its SQL, in which tables are in braces."""
    import string

    names = {name for _, name, _, _ in string.Formatter().parse(sql) if name}
    return t.spark.sql(sql, **{name: getattr(t, name) for name in names})


def plain(sql: str) -> str:
    return sql.replace("{", "").replace("}", "")


def listed(relation: str, key: str, rows: str, rules: dict[str, str], severity: str = "error") -> str:
    """SQL for the report of a rule table."""
    cases = ", ".join(f"CASE WHEN {bad} THEN '{name.replace(chr(39), chr(39) * 2)}' END" for name, bad in rules.items())
    return f"SELECT '{relation}' AS relation, ({key})::VARCHAR AS key, unnest(list_filter([{cases}], lambda x: x IS NOT NULL)) AS rule, '{severity}' AS severity FROM {rows}"


def repeated(relation: str, key: str, rows: str, by: str, rule: str, where: str = "TRUE", order: str = "_ord") -> str:
    rule = rule.replace("'", "''")
    return f"SELECT '{relation}', ({key})::VARCHAR, '{rule}', 'error' FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS again FROM {rows} WHERE {where} AND ({by}) IS NOT NULL) WHERE again > 1"


def missing(relation: str, key: str, rows: str, column: str, targets: str, rule: str, where: str = "TRUE", target: str = "id") -> str:
    rule = rule.replace("'", "''")
    return f"SELECT '{relation}', ({key})::VARCHAR, '{rule}', 'error' FROM {rows} WHERE {where} AND {column} IS NOT NULL AND {column} NOT IN (SELECT {target} FROM {targets})"


HASHED = "'^[a-f0-9]{{64}}$'".replace("{{", "{").replace("}}", "}")
V_COLUMNS = """CASE k % 6 WHEN 1 THEN 'stale' WHEN 2 THEN 'unverified' WHEN 3 THEN 'odd' WHEN 4 THEN NULL ELSE 'verified' END AS v_status,
  CASE WHEN k % 12 = 4 THEN NULL WHEN k % 7 = 0 THEN '' WHEN k % 7 = 1 THEN url || '/' WHEN k % 7 = 2 THEN 'https://www.other.com/x' ELSE url END AS v_url,
  CASE WHEN k % 5 = 0 THEN 'https://www.other.com/y' WHEN k % 5 = 1 THEN url || '#top' END AS v_final_url,
  CASE WHEN k % 4 = 0 THEN 'zz' WHEN k % 4 = 1 THEN NULL ELSE repeat('ab', 32) END AS v_hash,
  CASE WHEN k % 5 = 0 THEN 'yesterday' WHEN k % 5 = 1 THEN '2001-02-20T10:00:00Z' WHEN k % 5 = 2 THEN NULL ELSE '2001-01-05T00:00:00Z' END AS v_retrieved,
  CASE WHEN k % 9 = 0 THEN NULL WHEN k % 9 = 1 THEN 'soon' WHEN k % 9 = 2 THEN '2001-04-01T00:00:00Z' ELSE '2001-01-10T00:00:00Z' END AS v_checked_at,
  CASE WHEN k % 8 = 0 THEN '  ' ELSE 'Reviewer' END AS v_checked_by, CASE WHEN k % 10 = 0 THEN 'automatic' ELSE 'manual' END AS v_method,
  CASE WHEN k % 11 = 0 THEN 'never' WHEN k % 11 = 1 THEN '2001-02-21T00:00:00Z' END AS v_audit,
  CASE WHEN k % 13 = 0 THEN '2001-02-30' WHEN k % 13 = 1 THEN NULL ELSE '2001-01-01' END AS v_published,
  CASE WHEN k % 26 = 14 THEN 'month' WHEN k % 14 = 0 THEN 'week' WHEN k % 3 = 0 THEN 'day' END AS v_precision"""


def bad_time(column: str) -> str:
    return f"({column} <> '' AND NOT regexp_matches({column}, '^\\d{{4}}-\\d\\d-\\d\\dT'))"


def no_time(column: str) -> str:
    return f"NOT coalesce(regexp_matches({column}, '^\\d{{4}}-\\d\\d-\\d\\dT'), FALSE)"


def bad_date(column: str) -> str:
    return f"({column} <> '' AND try_cast({column} AS DATE) IS NULL)"


def bad_hash(column: str) -> str:
    return f"({column} <> '' AND NOT regexp_matches({column}, {HASHED}))"


def v_rules(url: str = "url") -> dict[str, str]:
    there, verified, precisions = "(v_status IS NOT NULL OR v_url IS NOT NULL)", "v_status = 'verified'", "('day', 'month', 'year')"
    rules = {
        "verification status": "v_status IS NULL OR v_status NOT IN ('unverified', 'verified', 'stale', 'unreachable')",
        "verification source": "coalesce(v_url, '') = ''",
        "verification source form": "v_url LIKE '%/'",
        "verification source differs": f"v_url <> '' AND rtrim(v_url, '/') <> rtrim(coalesce({url}, ''), '/')",
        "verification source host": "v_url LIKE '%other.com%'",
        "verification final host": "v_final_url LIKE '%other.com%'",
        "verification final form": "v_final_url LIKE '%#%'",
        "verification hash": bad_hash("v_hash"),
        **{f"verification {x}": bad_time(f"v_{x}") for x in ("retrieved", "checked_at", "audit")},
        "verification published": bad_date("v_published"),
        "verification precision": f"v_precision NOT IN {precisions}",
        "verification precision alone": "v_precision <> '' AND coalesce(v_published, '') = ''",
        "verified without hash": f"{verified} AND NOT coalesce(regexp_matches(v_hash, {HASHED}), FALSE)",
        "verified without time": f"{verified} AND {no_time('v_checked_at')}",
        "verified without person": f"{verified} AND coalesce(trim(v_checked_by), '') = ''",
        "verified not by hand": f"{verified} AND v_method <> 'manual'",
        "verified ahead": f"{verified} AND v_checked_at LIKE '2%' AND v_checked_at > '{NOW[:10]}T00:05:00Z'",
        "retrieved after check": f"{verified} AND v_retrieved LIKE '2%' AND v_checked_at LIKE '2%' AND v_retrieved > v_checked_at AND NOT coalesce(v_audit LIKE '2%' AND v_audit >= v_retrieved, FALSE)",
    }
    return {"verification missing": f"NOT {there}", **{name: f"{there} AND ({bad})" for name, bad in rules.items()}}


PLACE = "CASE WHEN k % 17 = 0 THEN 'MARS' ELSE 'ASIA' END"
NO_ID = {"no id": "coalesce(trim(id), '') = ''"}
HELD_ID = "nullif(trim(id), '')"
AWAIT = "SELECT '{0}', count(*)::VARCHAR, 'await review', 'warning' FROM {1} WHERE v_status IS DISTINCT FROM 'verified' HAVING count(*) > 0"

AGENCY_ROWS = f"""SELECT *, {V_COLUMNS} FROM (SELECT c_custkey AS k, c_custkey AS _ord, CASE WHEN c_custkey % 50 = 0 THEN ' ' WHEN c_custkey % 60 = 7 THEN 'a' || (c_custkey - 1) ELSE 'a' || c_custkey END AS id,
  CASE WHEN c_custkey % 19 = 0 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 17 = 0 THEN 'MARS' ELSE 'ASIA' END AS jurisdiction, CASE WHEN c_nationkey % 3 = 0 THEN 'federal' WHEN c_nationkey % 3 = 1 THEN 'state' ELSE 'local' END AS level,
  CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 4 = 1 END AS published, 'https://www.example.' || CASE WHEN c_custkey % 21 = 0 THEN 'com' ELSE 'org' END || '/site/' || c_custkey AS website,
  CASE WHEN c_custkey % 2 = 0 THEN 'https://www.example.org/c/' || c_custkey ELSE '' END AS statement_url,
  CASE WHEN c_custkey % 2 = 0 THEN 'https://www.example.org/c/' || c_custkey ELSE 'https://www.example.' || CASE WHEN c_custkey % 21 = 0 THEN 'com' ELSE 'org' END || '/site/' || c_custkey END AS url FROM {{customer}})"""
AGENCY_RULES = {
    "name": "coalesce(name, '') = ''",
    "jurisdiction": "jurisdiction = 'MARS'",
    "level": "level = 'local'",
    "published flag": "published IS NULL",
    "website host": "website LIKE '%.com/%'",
    **v_rules(),
    "verification source host": "(v_status IS NOT NULL OR v_url IS NOT NULL) AND v_url <> '' AND v_url NOT LIKE '%example.org%'",
    "verification final host": "(v_status IS NOT NULL OR v_url IS NOT NULL) AND v_final_url <> '' AND v_final_url NOT LIKE '%example.org%'",
    "verification final form": "(v_status IS NOT NULL OR v_url IS NOT NULL) AND v_final_url LIKE '%example.org%#%'",
}


@query(f"WITH a AS ({plain(AGENCY_ROWS)}) {listed('agencies', 'id', 'a', NO_ID)} UNION ALL {repeated('agencies', 'id', 'a', HELD_ID, 'id repeats')} UNION ALL {listed('agencies', 'id', 'a', AGENCY_RULES)} UNION ALL {AWAIT.format('agencies', 'a')}")
def validate_agencies(t: Tables) -> DataFrame:
    return validators.agencies(role(t, AGENCY_ROWS), scope())


EVENT_ROWS = f"""SELECT *, {V_COLUMNS} FROM (SELECT o_orderkey AS k, o_orderkey AS _ord, CASE WHEN o_orderkey % 64 = 0 THEN NULL WHEN o_orderkey % 96 = 1 THEN 't7' ELSE 't' || o_orderkey END AS id, CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE 'Event' END AS title,
  CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE 'Text' END AS description, CASE WHEN o_orderkey % 41 = 0 THEN '2001-13-01' WHEN o_orderkey % 3 = 0 THEN '2001-01-01' WHEN o_orderkey % 3 = 1 THEN '2001-05-01' ELSE '2001-05-17' END AS date,
  CASE WHEN o_orderkey % 5 = 0 THEN 'year' WHEN o_orderkey % 5 = 1 THEN 'month' WHEN o_orderkey % 5 = 2 THEN 'day' WHEN o_orderkey % 25 = 3 THEN 'hour' END AS precision, CASE o_orderstatus WHEN 'F' THEN 'repealed' WHEN 'O' THEN 'introduced' ELSE 'odd' END AS type,
  CASE WHEN o_orderkey % 17 = 0 THEN 'MARS' ELSE 'ASIA' END AS jurisdiction, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey * 3 END AS related,
  CASE WHEN o_orderkey % 43 = 0 THEN '' WHEN o_orderkey % 43 = 1 THEN 'https://www.other.com/e' WHEN o_orderkey % 43 = 2 THEN 'https://www.example.org/e/#x' ELSE 'https://www.example.org/e/' || o_orderkey END AS url FROM {{orders}})"""
EVENT_RULES = {
    "title": "coalesce(title, '') = ''",
    "description": "coalesce(description, '') = ''",
    "date": "try_cast(date AS DATE) IS NULL",
    "verified without precision": "v_status = 'verified' AND precision IS NULL",
    "precision": "precision = 'hour'",
    "year not on its first day": "precision = 'year' AND try_cast(date AS DATE) IS NOT NULL AND date NOT LIKE '%-01-01'",
    "month not on its first day": "precision = 'month' AND try_cast(date AS DATE) IS NOT NULL AND date NOT LIKE '%-01'",
    "date not backed": "v_status = 'verified' AND try_cast(date AS DATE) IS NOT NULL AND precision IN ('day', 'month', 'year') AND NOT coalesce(v_published = date AND coalesce(v_precision, 'day') = precision, FALSE)",
    "type": "type = 'odd'",
    "jurisdiction": "jurisdiction = 'MARS'",
    "no source": "url = ''",
    "source host": "url LIKE '%other.com%'",
    "source form": "url LIKE '%#x'",
    **v_rules(),
    # in these rows a source may itself be one of the odd forms, and forms are built on it
    "verification source form": "v_url IS NOT NULL AND v_url <> '' AND v_url <> 'https://www.other.com/x' AND (v_url LIKE '%/' OR v_url LIKE '%#%')",
    "verification source differs": "v_url = '/' OR v_url <> '' AND rtrim(regexp_replace(v_url, '#.*', ''), '/') <> rtrim(regexp_replace(url, '#.*', ''), '/')",
    "verification source host": "v_url <> '' AND v_url NOT LIKE '%example.org%'",
    "verification final host": "(v_status IS NOT NULL OR v_url IS NOT NULL) AND v_final_url <> '' AND v_final_url NOT LIKE '%example.org%'",
    "verification final form": "(v_status IS NOT NULL OR v_url IS NOT NULL) AND v_final_url LIKE '%example.org%#%'",
}


@query(f"WITH a AS ({plain(EVENT_ROWS)}) {listed('timeline', 'id', 'a', NO_ID)} UNION ALL {repeated('timeline', 'id', 'a', HELD_ID, 'id repeats')} UNION ALL {listed('timeline', 'id', 'a', EVENT_RULES)} UNION ALL {missing('timeline', 'id', 'a', 'related', 'orders', 'related to none', target='o_orderkey')} UNION ALL {AWAIT.format('timeline', 'a')}")
def validate_timeline(t: Tables) -> DataFrame:
    return validators.timeline(role(t, EVENT_ROWS), t.orders.select(F.col("o_orderkey").alias("id")), scope())


DEVELOPMENT_ROWS = f"""SELECT *, {V_COLUMNS} FROM (SELECT o_orderkey AS k, o_orderkey AS _ord, CASE WHEN o_orderkey % 96 = 1 THEN 'd7' ELSE 'd' || o_orderkey END AS id, CASE WHEN o_orderkey % 31 = 0 THEN ' ' ELSE 'Title' END AS title,
  'https://www.example.org/d/' || o_orderkey AS url, CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE 's' END AS source_id, CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE 'S' END AS source_name, CASE WHEN o_orderkey % 17 = 0 THEN 'MARS' ELSE 'ASIA' END AS jurisdiction,
  CASE o_orderstatus WHEN 'F' THEN 'detected' WHEN 'O' THEN 'dismissed' ELSE 'odd' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'known' END AS reason, o_custkey * 3 AS policy, o_custkey AS event,
  CASE WHEN o_orderkey % 4 = 0 THEN 'ai' WHEN o_orderkey % 4 = 1 THEN 'curated' WHEN o_orderkey % 4 = 2 THEN 'heuristic' ELSE 'guess' END AS classification, CAST(o_orderkey % 13 AS DOUBLE) / 10 AS score,
  CASE WHEN o_orderkey % 19 = 0 THEN 'now' ELSE '2001-02-01T00:00:00Z' END AS detected, CASE WHEN o_orderkey % 27 = 0 THEN '2001-02-31' WHEN o_orderkey % 2 = 0 THEN '2001-01-01' END AS published, CASE WHEN o_orderkey % 33 = 0 THEN 'hour' WHEN o_orderkey % 5 = 0 THEN 'day' END AS precision,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN 'editorial' WHEN o_orderkey % 7 = 2 THEN 'magic' WHEN o_orderkey % 7 < 5 THEN 'ai' ELSE 'heuristic' END AS a_method,
  CASE WHEN o_orderkey % 14 = 0 THEN NULL WHEN o_orderkey % 22 = 0 THEN 'then' ELSE '2001-02-01T00:00:00Z' END AS a_time, CASE WHEN o_orderkey % 39 = 0 THEN '' ELSE 'v1' END AS a_prompt FROM {{orders}})"""
ASSESSED = "(a_method IS NOT NULL OR a_time IS NOT NULL)"
DEVELOPMENT_RULES = {
    **{x: f"coalesce(trim({x}), '') = ''" for x in ("title", "source_id", "source_name")},
    "jurisdiction": "jurisdiction = 'MARS'",
    "status": "status = 'odd'",
    "dismissed without reason": "status = 'dismissed' AND reason IS NULL",
    "classification": "classification = 'guess'",
    "score": "score > 1",
    "detected": no_time("detected"),
    "published": bad_date("published"),
    "precision": "precision = 'hour'",
    "precision alone": "precision IS NOT NULL AND published IS NULL",
    "no assessment": f"NOT {ASSESSED}",
    "assessment method": f"{ASSESSED} AND (a_method IS NULL OR a_method = 'magic')",
    "assessment time": f"{ASSESSED} AND {no_time('a_time')}",
    "assessment prompt": f"{ASSESSED} AND a_prompt = ''",
    "assessed otherwise": f"{ASSESSED} AND classification <> 'curated' AND a_method IS DISTINCT FROM classification",
    "curated, not editorial": f"{ASSESSED} AND classification = 'curated' AND a_method IS DISTINCT FROM 'editorial'",
    **v_rules(),
}


@query(f"WITH a AS ({plain(DEVELOPMENT_ROWS)}) {listed('developments', 'id', 'a', DEVELOPMENT_RULES)} UNION ALL {repeated('developments', 'id', 'a', HELD_ID, 'id repeats')} UNION ALL {missing('developments', 'id', 'a', 'policy', 'orders', 'policy is none', target='o_orderkey')}")
def validate_developments(t: Tables) -> DataFrame:
    none = t.orders.where("o_orderkey < 0").select(F.col("o_orderkey").alias("id"))
    return validators.developments(role(t, DEVELOPMENT_ROWS), t.orders.select(F.col("o_orderkey").alias("id")), none, scope())


SOURCE_ROWS = """SELECT p_partkey AS _ord, CASE WHEN p_partkey % 40 = 0 THEN '' WHEN p_partkey % 40 = 1 THEN 's' || (p_partkey + 1) ELSE 's' || p_partkey END AS id,
  'https://www.' || CASE WHEN p_partkey % 30 = 0 THEN 'other.com' ELSE 'example.org' END || '/s/' || (p_partkey - CASE WHEN p_partkey % 20 = 3 THEN 1 ELSE 0 END) || CASE WHEN p_partkey % 25 = 0 THEN '/' ELSE '' END AS url,
  CASE WHEN p_size % 4 = 0 THEN 'rss' WHEN p_size % 4 = 1 THEN 'document' WHEN p_size % 4 = 2 THEN 'html-index' ELSE 'odd' END AS kind, CASE WHEN p_size % 3 = 0 THEN 'daily' WHEN p_size % 3 = 1 THEN 'weekly' ELSE 'hourly' END AS schedule,
  CASE WHEN p_partkey % 3 = 0 THEN 'manual' WHEN p_partkey % 3 = 1 THEN 'automatic' ELSE 'half' END AS automation, CASE WHEN p_partkey % 6 = 0 THEN -1 WHEN p_partkey % 6 = 1 THEN 3 END AS least, p_partkey % 2 = 0 AS enabled FROM {part}"""
SOURCE_RULES = {
    "url host": "url LIKE '%other.com%'",
    "url form": "url LIKE '%example.org%/'",
    "kind": "kind = 'odd'",
    "schedule": "schedule = 'hourly'",
    "automation": "automation = 'half'",
    "least items": "least < 0",
    "least items of a document": "least IS NOT NULL AND kind = 'document'",
}


@query(f"WITH a AS ({plain(SOURCE_ROWS)}) {listed('sources', 'id', 'a', NO_ID)} UNION ALL {repeated('sources', 'id', 'a', HELD_ID, 'id repeats')} UNION ALL {listed('sources', 'id', 'a', SOURCE_RULES)} UNION ALL " + repeated("sources", "id", "a", "rtrim(url, '/')", "url repeats", "url LIKE '%example.org%'"))
def validate_watch_sources(t: Tables) -> DataFrame:
    return validators.watch_sources(role(t, SOURCE_ROWS), scope())


STATE_ROWS = """SELECT c_custkey AS k, 'https://www.' || CASE WHEN c_custkey % 30 = 0 THEN 'other.com' ELSE 'example.org' END || '/c/' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '#change=' || repeat('ab', 3) ELSE '' END AS key,
  CASE WHEN c_custkey % 11 = 0 THEN 'once' ELSE '2001-01-01T00:00:00Z' END AS first_seen, CASE WHEN c_custkey % 5 = 0 THEN 'pending' WHEN c_custkey % 5 = 1 THEN 'failed' WHEN c_custkey % 5 = 2 THEN 'odd' WHEN c_custkey % 5 = 3 THEN 'approved' END AS status,
  CASE WHEN c_custkey % 4 <> 0 THEN 'https://www.' || CASE WHEN c_custkey % 30 = 0 THEN 'other.com' ELSE 'example.org' END || '/c/' || c_custkey || CASE WHEN c_custkey % 13 = 0 THEN '/' ELSE '' END END AS candidate_url,
  CASE WHEN c_custkey % 6 = 0 THEN repeat('ab', 3) END AS fingerprint, CAST(c_custkey % 4 AS BIGINT) - 1 AS attempts, CASE WHEN c_custkey % 2 = 0 THEN 'timeout' END AS error FROM {customer}"""
CHECK_ROWS = "SELECT CASE WHEN n_nationkey = 3 THEN '' ELSE n_name END AS source, CASE WHEN n_nationkey % 5 = 0 THEN 'today' ELSE '2001-01-01T00:00:00Z' END AS at FROM {nation}"
SNAPSHOT_ROWS = "SELECT s_name AS source, CASE WHEN s_suppkey % 3 = 0 THEN 'AB' ELSE repeat('ab', 32) END AS hash, '2001-01-01T00:00:00Z' AS first, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE '2001-01-01T00:00:00Z' END AS last, CAST(s_suppkey % 5 AS BIGINT) - 1 AS count FROM {supplier}"
STATE_RULES = {
    "host": "key LIKE '%other.com%'",
    "first seen": no_time("first_seen"),
    "status": "status = 'odd'",
    "unresolved without candidate": "status IN ('pending', 'approved') AND candidate_url IS NULL",
    "failed without error": "status = 'failed' AND error IS NULL",
    "attempts": "attempts < 0",
    "candidate form": "candidate_url LIKE '%/'",
    "key isn't the candidate's": "candidate_url IS NOT NULL AND rtrim(candidate_url, '/') || coalesce('#change=' || fingerprint, '') <> key",
}


@query(f"""WITH a AS ({plain(STATE_ROWS)}), b AS ({plain(CHECK_ROWS)}), c AS ({plain(SNAPSHOT_ROWS)}) {listed('state', 'key', 'a', STATE_RULES)}
UNION ALL {listed('checks', 'source', 'b', {'last check': f"source = '' OR {no_time('"at"')}"})} UNION ALL {listed('snapshots', 'source', 'c', {'snapshot hash': "hash = 'AB'", 'snapshot last': '"last" IS NULL', 'snapshot count': '"count" < 0'})}""")
def validate_watch_state(t: Tables) -> DataFrame:
    return validators.watch_state(role(t, STATE_ROWS), role(t, CHECK_ROWS), role(t, SNAPSHOT_ROWS), scope())


MONITOR_ROWS = """SELECT ps_key AS _ord, CASE WHEN ps_key % 9 = 0 THEN 'gone' || ps_key WHEN ps_key % 9 = 1 THEN 's' || (ps_key + 2) ELSE 's' || ps_key END AS source, CASE WHEN ps_key % 4 = 0 THEN 'odd' ELSE 'seen' END AS status,
  CASE WHEN ps_key % 5 = 0 THEN 'today' WHEN ps_key % 5 = 1 THEN '2001-05-01T00:00:00Z' ELSE '2001-01-01T00:00:00Z' END AS reviewed, CASE WHEN ps_key % 6 = 0 THEN '' ELSE 'R' END AS reviewer, CASE WHEN ps_key % 7 = 0 THEN 'short' ELSE 'Read the page from top to end.' END AS notes,
  CASE WHEN ps_key % 8 = 0 THEN '' WHEN ps_key % 8 = 1 THEN 'https://www.example.org/s/' || ps_key || '/' ELSE 'https://www.example.org/s/' || ps_key END AS url, CASE WHEN ps_key % 10 = 0 THEN 'https://www.other.com/' WHEN ps_key % 10 = 1 THEN 'https://www.example.org/f#x' END AS final_url,
  CASE WHEN ps_key % 11 = 0 THEN 'late' END AS retrieved, CASE WHEN ps_key % 12 = 0 THEN 'zz' END AS hash, CASE WHEN ps_key % 13 = 0 THEN '2001-02-30' END AS published, CASE WHEN ps_key % 14 = 0 THEN 'day' WHEN ps_key % 14 = 1 THEN 'hour' END AS precision, CASE WHEN ps_key % 15 = 0 THEN ' ' END AS title
  FROM (SELECT p_partkey AS ps_key FROM {part} WHERE p_size <= 25)"""
MONITOR_RULES = {
    "unknown source": "_by IS NULL",
    "not by hand": "_by <> 'manual'",
    "status": "status = 'odd'",
    "reviewed": no_time("reviewed"),
    "reviewed ahead": "reviewed = '2001-05-01T00:00:00Z'",
    "reviewer": "reviewer = ''",
    "notes": "notes = 'short'",
    "no evidence": "url = ''",
    "evidence differs": "url <> '' AND _by IS NOT NULL AND rtrim(url, '/') <> rtrim(_url, '/')",
    "evidence form": "url LIKE '%/'",
    "final host": "final_url LIKE '%other.com%'",
    "final form": "final_url LIKE '%#x'",
    "retrieved": "retrieved IS NOT NULL",
    "hash": "hash IS NOT NULL",
    "published": "published IS NOT NULL",
    "precision": "precision = 'hour'",
    "precision alone": "precision IS NOT NULL AND published IS NULL",
    "title": "title IS NOT NULL",
}


def catalogue(t: Tables) -> DataFrame:
    """Watch sources whose ids are their own."""
    return role(t, SOURCE_ROWS).withColumn("id", F.concat(F.lit("s"), "_ord"))


@query(f"""WITH a AS ({plain(MONITOR_ROWS)}), s AS (SELECT * REPLACE ('s' || _ord AS id) FROM ({plain(SOURCE_ROWS)})), f AS (SELECT a.*, s.url AS _url, s.automation AS _by FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY _ord) AS n FROM a) a LEFT JOIN s ON source = s.id WHERE n = 1)
{listed('monitoring', 'source', 'f', MONITOR_RULES)} UNION ALL {repeated('monitoring', 'source', 'a', 'source', 'review repeats')} UNION ALL SELECT 'monitoring', id, 'never reviewed', 'warning' FROM s WHERE enabled AND automation = 'manual' AND id NOT IN (SELECT source FROM a)""")
def validate_monitoring(t: Tables) -> DataFrame:
    return validators.monitoring(role(t, MONITOR_ROWS), catalogue(t), ("seen", "unavailable"), scope())


REVIEW_ROWS = """SELECT l_orderkey * 10 + l_linenumber AS _ord, l_orderkey AS k, CASE WHEN l_linenumber = 7 THEN 'r' || (l_orderkey * 10 + 1) ELSE 'r' || (l_orderkey * 10 + l_linenumber) END AS id, CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'R' THEN 'rejected' ELSE CASE WHEN l_linestatus = 'O' THEN 'pending_review' ELSE 'published' END END AS status,
  CASE WHEN l_linenumber = 5 AND l_orderkey % 9 = 0 THEN 'http://www.example.org/o/1' WHEN l_linenumber = 6 THEN 'https://www.other.com/o/' || l_orderkey WHEN l_linenumber = 4 AND l_orderkey % 2 = 0 THEN 'https://www.example.org/o/' || l_orderkey || '/new' ELSE 'https://www.example.org/o/' || l_orderkey END AS url,
  CASE WHEN l_linenumber < 4 OR l_linenumber = 4 THEN 'policy' WHEN l_linenumber = 5 THEN 'timeline_event' ELSE CASE WHEN l_orderkey % 3 = 0 THEN 'odd' ELSE 'policy' END END AS kind,
  CASE WHEN l_linenumber IN (1, 2, 4) THEN CASE WHEN l_orderkey % 25 = 0 THEN -1 ELSE l_orderkey END END AS policy, CASE WHEN l_linenumber = 5 AND l_orderkey % 2 = 1 THEN l_orderkey END AS event,
  CASE WHEN l_linenumber = 4 THEN 'https://www.example.org/o/' || l_orderkey WHEN l_linenumber = 3 AND l_orderkey % 5 = 0 THEN 'https://www.example.org/x' END AS previous_url, CASE WHEN l_orderkey % 4 = 0 THEN 'zz' WHEN l_orderkey % 4 = 1 THEN NULL ELSE repeat('cd', 32) END AS base_hash,
  CASE WHEN l_orderkey % 7 = 0 THEN 'yy' WHEN l_orderkey % 7 < 4 THEN repeat('ef', 32) END AS policy_hash, CASE WHEN l_linenumber = 5 AND l_orderkey % 3 = 0 THEN repeat('ab', 32) WHEN l_linenumber = 3 AND l_orderkey % 11 = 0 THEN 'xx' END AS event_hash,
  CASE WHEN l_orderkey % 6 = 0 THEN -5 ELSE l_orderkey END AS draft_id, CASE WHEN l_linenumber = 4 AND l_orderkey % 2 = 0 AND l_orderkey % 8 <> 0 THEN 'https://www.example.org/o/' || l_orderkey || '/new' ELSE 'https://www.example.org/o/' || l_orderkey END AS draft_url, CASE WHEN l_suppkey % 4 = 0 THEN '2001-02-15T00:00:00Z' ELSE '2001-01-01T00:00:00Z' END AS draft_created,
  CASE WHEN l_orderkey % 8 = 1 THEN CAST(l_linenumber AS BIGINT) - 2 END AS sequence, CASE WHEN l_partkey % 13 = 0 THEN 'first' WHEN l_partkey % 13 = 1 THEN '2001-02-20T00:00:00Z' ELSE '2001-01-02T00:00:00Z' END AS discovered, CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE '2001-01-02T00:00:00Z' END AS updated,
  CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE '2001-02-01T00:00:00Z' END AS reviewed, CASE WHEN l_partkey % 23 = 0 THEN ' ' ELSE 'R' END AS reviewer,
  CASE WHEN l_partkey % 9 = 0 THEN '' WHEN l_partkey % 9 = 1 THEN 'https://www.example.org/o/0' WHEN l_linenumber < 4 AND l_partkey % 9 = 2 THEN 'https://www.example.org/o/' || l_orderkey || '#e' WHEN l_linenumber < 4 THEN 'https://www.example.org/o/' || l_orderkey ELSE 'https://www.example.org/z' END AS e_url,
  CASE WHEN l_partkey % 10 = 0 THEN 'soon' WHEN l_partkey % 10 = 1 THEN '2001-02-21T00:00:00Z' END AS e_retrieved, CASE WHEN l_partkey % 14 = 0 THEN '2001-02-29' END AS e_published, CASE WHEN l_partkey % 15 = 0 THEN 'hour' WHEN l_partkey % 15 = 1 THEN 'day' END AS e_precision FROM {lineitem}"""
WEB, FINAL, OK_HASH = "url LIKE 'https://%'", "status IN ('approved', 'published')", f"coalesce(regexp_matches({{0}}, {HASHED.replace('{', '{{').replace('}', '}}')}), FALSE)"
CUT_URL = "rtrim(regexp_replace({0}, '#.*', ''), '/')"
AFTER = "({0} LIKE '2%' AND reviewed LIKE '2%' AND {0} > reviewed)"
REVIEW_RULES = {
    "url": f"NOT ({WEB})",
    "final without official source": f"url LIKE '%other.com%' AND {FINAL}",
    "kind": "kind = 'odd'",
    "policy target of another kind": "policy IS NOT NULL AND kind <> 'policy'",
    "draft isn't the policy target": "policy IS NOT NULL AND draft_id <> policy",
    "no base revision": f"policy IS NOT NULL AND NOT {OK_HASH.format('base_hash')}",
    "final without revision": f"policy IS NOT NULL AND {FINAL} AND NOT {OK_HASH.format('policy_hash')}",
    "previous source without target": "policy IS NULL AND previous_url IS NOT NULL",
    "base revision without target": "policy IS NULL AND base_hash IS NOT NULL",
    "revision without target": "policy IS NULL AND policy_hash IS NOT NULL",
    "sequence": "sequence < 1",
    "sequence without target": "sequence IS NOT NULL AND policy IS NULL AND event IS NULL",
    "base revision": bad_hash("base_hash"),
    "revision": bad_hash("policy_hash"),
    "event revision of another kind": "event_hash IS NOT NULL AND kind <> 'timeline_event'",
    "event revision": bad_hash("event_hash"),
    "event revision without target": "event_hash IS NOT NULL AND event IS NULL",
    "event target of another kind": "event IS NOT NULL AND kind <> 'timeline_event'",
    "draft isn't the event target": "event IS NOT NULL AND draft_id <> event",
    "event target without revision": "event IS NOT NULL AND event_hash IS NULL",
    "discovered": no_time("discovered"),
    "updated": no_time("updated"),
    "no evidence": "e_url = ''",
    "evidence differs": f"e_url <> '' AND {CUT_URL.format('e_url')} <> url",
    "evidence form": "e_url LIKE '%#e'",
    "evidence retrieved": bad_time("e_retrieved"),
    "evidence published": bad_date("e_published"),
    "evidence precision": "e_precision = 'hour'",
    "final without time": f"{FINAL} AND reviewed IS NULL",
    "final without person": f"{FINAL} AND trim(reviewer) = ''",
    "reviewed before discovery": f"{FINAL} AND {AFTER.format('discovered')}",
    "reviewed before retrieval": f"{FINAL} AND {AFTER.format('e_retrieved')}",
    "reviewed before creation": f"{FINAL} AND kind = 'policy' AND {AFTER.format('draft_created')}",
    "final draft differs": f"{FINAL} AND draft_url <> url",
}
TARGET_ROWS = "SELECT o_orderkey AS id, 'https://www.example.org/o/' || o_orderkey || CASE WHEN o_orderkey % 12 = 4 THEN '/new' WHEN o_orderkey % 15 = 5 THEN '/else' ELSE '' END AS url FROM {orders}"


@query(f"""WITH a AS ({plain(REVIEW_ROWS)}), p AS ({plain(TARGET_ROWS)}),
m AS (SELECT a.*, p.url AS held FROM a JOIN p ON a.policy = p.id),
w AS (SELECT * FROM m WHERE CASE WHEN previous_url IS NOT NULL THEN draft_url <> url OR NOT ((held = previous_url AND held <> url) OR ({FINAL} AND held = url AND held <> previous_url)) ELSE held <> url END
  AND NOT (status = 'published' AND previous_url IS NULL AND EXISTS (SELECT 1 FROM a x WHERE x.status = 'published' AND x.previous_url = m.url AND x.url = m.held AND x.policy = m.policy AND x.id <> m.id)))
{listed('reviews', 'id', 'a', REVIEW_RULES)} UNION ALL {listed('reviews', 'id', 'a', {"source isn't official": f"url LIKE '%other.com%' AND NOT ({FINAL})"}, 'warning')}
UNION ALL {repeated('reviews', 'id', 'a', HELD_ID, 'id repeats')} UNION ALL {repeated('reviews', 'id', 'a', 'url', 'source repeats', f"{WEB} AND status <> 'rejected' AND policy IS NULL AND event IS NULL AND event_hash IS NULL")}
UNION ALL {missing('reviews', 'id', 'a', 'policy', 'p', 'policy target is none')} UNION ALL {missing('reviews', 'id', 'a', 'event', 'p', 'event target is none')}
UNION ALL SELECT 'reviews', id, 'source isn''t the policy target''s', 'error' FROM w UNION ALL SELECT 'reviews', a.id, 'source isn''t the event target''s', 'error' FROM a JOIN p ON a.event = p.id WHERE a.url <> p.url""")
def validate_source_reviews(t: Tables) -> DataFrame:
    targets = role(t, TARGET_ROWS)
    return validators.source_reviews(role(t, REVIEW_ROWS), targets, targets, scope())


DATE_TYPES, POLICY_TYPES, POLICY_STATES = ("published", "introduced", "amended"), ("law", "guide"), ("active", "repealed")
POLICY_ROWS = f"""SELECT *, {V_COLUMNS} FROM (SELECT l_orderkey * 8 + l_linenumber AS k, (l_orderkey * 8 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey AS _ord, CASE WHEN l_tax = 0.03 AND l_quantity < 9 THEN ' ' ELSE 'p' || l_orderkey || '-' || l_linenumber END AS id,
  CASE WHEN l_quantity = 7 THEN '' ELSE 'Title' END AS title, CASE WHEN l_quantity = 8 THEN NULL ELSE 'Text' END AS description, CASE WHEN l_quantity = 9 THEN '' ELSE 'Content' END AS content, CASE WHEN l_quantity = 10 THEN ' ' ELSE 'Summary' END AS summary,
  CASE WHEN l_suppkey % 7 = 3 THEN 'MARS' ELSE 'ASIA' END AS jurisdiction, CASE WHEN l_returnflag = 'R' THEN 'law' WHEN l_partkey % 5 = 0 THEN 'odd' ELSE 'guide' END AS type, CASE WHEN l_linestatus = 'O' THEN 'active' WHEN l_partkey % 4 = 0 THEN 'gone' ELSE 'repealed' END AS status,
  CASE WHEN l_quantity = 11 THEN '2001-02-30' ELSE '2001-0' || (1 + l_linenumber) || '-01' END AS effective,
  CASE WHEN l_quantity = 12 THEN NULL WHEN l_quantity = 13 THEN array('a', '') ELSE array('a', 'b') END AS tags, CASE WHEN l_quantity = 14 THEN NULL WHEN l_quantity = 15 THEN array(' ') ELSE array('x') END AS agencies,
  CASE WHEN l_quantity = 16 THEN 'once' ELSE '2001-01-0' || (1 + l_linenumber) || 'T00:00:00Z' END AS created, CASE WHEN l_quantity = 17 THEN NULL WHEN l_tax = 0.05 THEN '2001-01-03T00:00:00Z' ELSE '2001-02-01T00:00:00Z' END AS updated,
  CASE WHEN l_quantity = 18 THEN 'never' WHEN l_quantity > 30 THEN '2001-01-05' END AS last_review,
  CASE WHEN l_quantity = 19 THEN '' WHEN l_quantity = 20 THEN 'https://www.other.com/p' WHEN l_quantity = 21 THEN 'https://www.example.org/p/#x' ELSE 'https://www.example.org/p/' || l_partkey || '/' || (l_orderkey % 50) END AS url,
  CASE WHEN l_quantity = 22 THEN '' WHEN l_quantity > 40 THEN 'p' || (l_orderkey - 1) || '-' || l_linenumber END AS superseded_by,
  l_discount, l_linenumber, l_tax, l_partkey, l_suppkey, l_quantity FROM {{lineitem}})"""
DATE_ROWS = [  # type, date, precision, primary, s_url, s_published, s_precision, r_date, r_precision
    ("CASE WHEN l_discount = 0.05 THEN 'odd' ELSE 'published' END", "CASE WHEN l_discount = 0.06 THEN 'soon' ELSE '2001-0' || (1 + l_linenumber) || '-01' END", "CASE WHEN l_tax = 0.01 THEN 'year' WHEN l_tax = 0.02 THEN 'month' ELSE 'day' END", "TRUE",
     "CASE WHEN l_suppkey % 3 = 0 THEN 'https://www.other.com/d' WHEN l_suppkey % 3 = 1 THEN 'https://www.example.org/d' END", "CASE WHEN l_partkey % 2 = 0 THEN '2001-0' || (1 + l_linenumber) || '-01' END", "CASE WHEN l_partkey % 3 = 0 THEN 'day' END",
     "CASE WHEN l_partkey % 7 = 1 THEN '2001-0' || (1 + l_linenumber) || '-01' WHEN l_partkey % 7 = 2 THEN 'bad' END", "CASE WHEN l_partkey % 5 = 2 THEN 'hour' ELSE 'day' END"),
    ("CASE WHEN l_linenumber = 2 THEN 'published' ELSE 'amended' END", "'2001-06-05'", "CASE WHEN l_discount = 0.07 THEN 'month' WHEN l_discount = 0.08 THEN NULL ELSE 'day' END", "l_quantity = 23", "NULL", "NULL", "NULL", "NULL", "NULL"),
]
DATE_FIELDS = ("type", "date", "precision", "primary", "s_url", "s_published", "s_precision", "r_date", "r_precision")
DATE_KINDS = ("string", "string", "string", "boolean", "string", "string", "string", "string", "string")
P_OK = "try_cast({0} AS DATE) IS NOT NULL"
P_RULES = {
    "title": "coalesce(title, '') = ''", "description": "coalesce(description, '') = ''", "content": "content = ''", "summary": "trim(summary) = ''", "jurisdiction": "jurisdiction = 'MARS'", "type": "type = 'odd'", "status": "status = 'gone'",
    "effective": "try_cast(effective AS DATE) IS NULL", "no dates": "l_quantity = 24", "not one primary date": "l_quantity = 23",
    "effective isn't the primary date": f"l_quantity <> 24 AND {P_OK.format('d0')} AND {P_OK.format('effective')} AND d0 <> effective",
    "primary date not backed": f"l_quantity <> 24 AND v_status = 'verified' AND {P_OK.format('d0')} AND NOT coalesce(sp0 = d0 AND coalesce(ss0, 'day') = pr0, FALSE) AND NOT coalesce(rd0 = d0 AND coalesce(rp0, 'day') = pr0, FALSE)",
    "no tags": "tags IS NULL", "empty tag": "list_contains(tags, '')", "no agencies": "agencies IS NULL", "empty agency": "list_contains(agencies, ' ')", "created": "created = 'once'", "updated": "updated IS NULL", "last review": "last_review = 'never'",
    "created after update": "created <> 'once' AND created > updated", "no source": "url = ''", "source host": "url LIKE '%other.com%'", "source form": "url LIKE '%#x'", "superseded by no id": "superseded_by = ''",
    **v_rules(),
    "verification source form": "v_url IS NOT NULL AND v_url <> '' AND v_url <> 'https://www.other.com/x' AND (v_url LIKE '%/' OR v_url LIKE '%#%')",
    "verification source host": "v_url <> '' AND v_url NOT LIKE '%example.org%'",
    "verification final host": "(v_status IS NOT NULL OR v_url IS NOT NULL) AND v_final_url <> '' AND v_final_url NOT LIKE '%example.org%'",
    "verification final form": "(v_status IS NOT NULL OR v_url IS NOT NULL) AND v_final_url LIKE '%example.org%#%'",
    "verification source differs": f"v_url <> '' AND (v_url = '/' OR {CUT_URL.format('v_url')} <> {CUT_URL.format('url')})",
}


def date_sql(i: int) -> str:
    return "SELECT k, id, l_quantity, " + f"{i} AS place, {DATE_ROWS[0][0]} AS first_type, " + ", ".join(f"{x} AS {n}" for x, n in zip(DATE_ROWS[i], ("type", "date", "precision", "prim", "s_url", "s_published", "s_precision", "r_date", "r_precision"))) + " FROM a"


D_RULES = {
    "date type": "type = 'odd'", "date type repeats": "place = 1 AND type = first_type", "date": "try_cast(date AS DATE) IS NULL", "date precision": "precision IS NULL",
    "date year not on its first day": f"precision = 'year' AND {P_OK.format('date')} AND date NOT LIKE '%-01-01'", "date month not on its first day": f"precision = 'month' AND {P_OK.format('date')} AND date NOT LIKE '%-01'",
    "date source host": "(s_url IS NOT NULL OR r_date IS NOT NULL) AND coalesce(s_url NOT LIKE '%example.org%', TRUE)", "reviewed date": "s_url LIKE '%example.org%' AND (r_date = 'bad' OR (r_date IS NOT NULL AND r_precision = 'hour'))",
    "reviewed date differs": f"s_url LIKE '%example.org%' AND r_date IS NOT NULL AND {P_OK.format('date')} AND (r_date <> date OR r_precision <> precision)",
}


@query(f"""WITH r AS ({plain(POLICY_ROWS).replace("array(", "list_value(")}),
a AS (SELECT *, {DATE_ROWS[0][1]} AS d0, {DATE_ROWS[0][2]} AS pr0, {DATE_ROWS[0][5]} AS sp0, {DATE_ROWS[0][6]} AS ss0, {DATE_ROWS[0][7]} AS rd0, {DATE_ROWS[0][8]} AS rp0 FROM r),
d AS (SELECT * FROM ({date_sql(0)} UNION ALL {date_sql(1)}) WHERE l_quantity <> 24)
{listed('policies', 'id', 'a', NO_ID)} UNION ALL {repeated('policies', 'id', 'a', HELD_ID, 'id repeats')} UNION ALL {listed('policies', 'id', 'a', P_RULES)} UNION ALL {listed('policies', "concat_ws('/', id, place)", 'd', D_RULES)}
UNION ALL {repeated('policies', 'id', 'a', "CASE WHEN url <> '' THEN " + CUT_URL.format('url') + ' END', 'source repeats')} UNION ALL {missing('policies', 'id', 'a', 'superseded_by', 'a', 'superseded by none').replace("'error'", "'warning'")} UNION ALL {AWAIT.format('policies', 'a')}""")
def validate_policies(t: Tables) -> DataFrame:
    rows = role(t, POLICY_ROWS)
    held = [F.struct(*(F.expr(x).cast(k).alias(n) for x, n, k in zip(of, DATE_FIELDS, DATE_KINDS))) for of in DATE_ROWS]
    rows = rows.withColumn("dates", F.when(F.col("l_quantity") != 24, F.array(*held)))
    return validators.policies(rows, scope(), POLICY_TYPES, POLICY_STATES, DATE_TYPES)


FRAMEWORK_SQL = """WITH a AS (SELECT s_suppkey AS k, 'f' || s_suppkey AS id, CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE 'Order ' || s_suppkey END AS title, CASE WHEN s_suppkey % 8 = 0 THEN '2001-13-01' ELSE '2001-01-01' END AS effective, CASE WHEN s_suppkey % 11 = 0 THEN -1 WHEN s_suppkey % 12 = 0 THEN NULL ELSE s_suppkey END AS related FROM supplier),
p AS (SELECT k, id || '/' || i AS key, CASE WHEN k % 7 = 0 AND i > 0 THEN 'p0' ELSE 'p' || i END AS pid, i, k % 5 = 0 AS hollow FROM a, range(0, 4) r(i) WHERE i < k % 4),
q AS (SELECT *, key || '/' || n AS nkey, CASE WHEN n = 2 THEN 'q0' ELSE 'q' || n END AS qid, CASE (k + n) % 4 WHEN 0 THEN 'mandatory' WHEN 1 THEN 'recommended' WHEN 2 THEN 'odd' ELSE 'consideration' END AS type FROM p, range(0, 3) r(n) WHERE NOT hollow),
o AS (SELECT o_orderkey AS id, 'Order ' || o_orderkey AS title FROM orders)
SELECT 'framework' AS relation, id AS key, unnest(list_filter([CASE WHEN title = '' THEN 'title' END, CASE WHEN effective = '2001-13-01' THEN 'effective' END, CASE WHEN k % 4 = 0 THEN 'no pillars' END, CASE WHEN k % 6 = 0 THEN 'risks' END, CASE WHEN related IS NULL THEN 'related to none' END], lambda x: x IS NOT NULL)) AS rule, 'error' AS severity FROM a
UNION ALL SELECT 'framework', key, 'pillar without requirements', 'error' FROM p WHERE hollow
UNION ALL SELECT 'framework', key, 'pillar repeats', 'error' FROM p WHERE k % 7 = 0 AND i > 0
UNION ALL SELECT 'framework', nkey, 'requirement repeats', 'error' FROM q WHERE n = 2
UNION ALL SELECT 'framework', nkey, unnest(list_filter([CASE WHEN type = 'odd' THEN 'requirement type' END, CASE WHEN n = 1 THEN 'requirement deadline' END, CASE WHEN n = 0 THEN 'requirement details' END], lambda x: x IS NOT NULL)), 'error' FROM q
UNION ALL SELECT 'framework', id, 'related to none', 'error' FROM a WHERE related IS NOT NULL AND related NOT IN (SELECT id FROM o)
UNION ALL SELECT 'framework', a.id, unnest(list_filter([CASE WHEN a.title <> o.title THEN 'title isn''t the policy''s' END, CASE WHEN effective <> '2001-01-01' THEN 'effective isn''t the policy''s' END], lambda x: x IS NOT NULL)), 'error' FROM a JOIN o ON a.related = o.id"""


@query(FRAMEWORK_SQL)
def validate_framework(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    text = lambda *xs: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in xs))

    def need(i, n):
        kind = F.element_at(F.array(*map(F.lit, ("mandatory", "recommended", "odd", "consideration"))), ((k + n) % 4 + 1).cast("int"))
        return F.struct(F.when(n == 2, "q0").otherwise(text("q", n)).alias("id"), F.lit("Need").alias("title"), kind.alias("type"), F.when(n == 1, " ").alias("deadline"), F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("d"))).alias("details"))

    def pillar(i):
        needs = F.when(k % 5 == 0, F.array().cast("array<struct<id:string,title:string,type:string,deadline:string,details:array<string>>>")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda n: need(i, n)))
        return F.struct(F.when((k % 7 == 0) & (i > 0), "p0").otherwise(text("p", i)).alias("id"), F.lit("Pillar").alias("title"), F.array(F.lit("x")).alias("principles"), needs.alias("requirements"))

    artifacts = t.supplier.select(
        text("f", k).alias("id"), F.when(k % 9 == 0, "").otherwise(text("Order ", k)).alias("title"), F.lit("1").alias("version"), F.lit("A").alias("authority"), F.lit("https://www.example.org/").alias("url"),
        F.when(k % 8 == 0, "2001-13-01").otherwise("2001-01-01").alias("effective"), F.lit("2001-01-01").alias("updated"), F.when(k % 11 == 0, -1).when(k % 12 == 0, F.lit(None)).otherwise(k).alias("related"), F.lit(None).cast("string").alias("hash"),
        F.when(k % 6 != 0, F.array(F.lit("risk"))).alias("risks"), F.transform(F.slice(F.sequence(F.lit(0), F.lit(3)), F.lit(1), (k % 4).cast("int")), pillar).alias("pillars"),
    )
    policies = t.orders.select(F.col("o_orderkey").alias("id"), text("Order ", F.col("o_orderkey")).alias("title"), F.lit("https://www.example.org/").alias("url"), F.lit("2001-01-01").alias("effective"), F.lit(None).cast("string").alias("hash"))
    return validators.framework(artifacts, policies)
