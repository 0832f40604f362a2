"""The queries over the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, jaccard, lloyd, maxent, packing, pieces, pii, quality, spans, suffixes, urls, variants
from tidemark.llm.common import documents

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.ledger(documents(spark, sf_dir).select("doc_id", "text"))
    base = quality.fails("base")
    return judged.select(
        "doc_id",
        *(F.col(f"ledger.{x}").alias(x) for x in quality.FIELDS),
        F.col("ledger.failed").alias("failed"),
        base.alias("base_failed"),
        (~base & ~quality.fails("v2")).alias("kept"),
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each rule of the newest policy: documents that fail it, and those that it alone rejects."""
    return quality.ablation(quality.ledger(documents(spark, sf_dir).select("doc_id", "text")), "v2")


def repeats_sql(width: int) -> str:
    """Words in windows of ``width`` that a text has twice or more, from the words table w."""
    more = range(1, width)
    return (
        f"SELECT doc_id, count(DISTINCT p + k) AS n FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w, {', '.join(f'w{i}' for i in more)}) AS c "
        f"FROM (SELECT doc_id, p, w, {', '.join(f'lead(w, {i}) OVER o AS w{i}' for i in more)} FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY p)) WHERE w{width - 1} IS NOT NULL), "
        f"(VALUES {', '.join(f'({i})' for i in range(width))}) v(k) WHERE c >= 2 GROUP BY doc_id"
    )


OP4_MEASURES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS_SQL} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
r AS ({repeats_sql(3)}), q AS ({repeats_sql(5)}),
b AS (SELECT doc_id, max(c) AS n FROM (SELECT doc_id, count(*) AS c FROM (SELECT doc_id, w, lead(w) OVER (PARTITION BY doc_id ORDER BY p) AS x FROM w) WHERE x IS NOT NULL GROUP BY doc_id, w, x) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣]')))::BIGINT AS n_bullet_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')))::BIGINT AS n_ellipsis_lines,
    len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]')))::BIGINT AS n_letter_words,
    coalesce(b.n, 0)::BIGINT AS n_top_pair, coalesce(q.n, 0)::BIGINT AS n_repeat_5,
    len(list_filter(ws, lambda x: lower(x) IN ('the', 'be', 'to', 'of', 'and', 'that', 'have', 'with')))::BIGINT AS n_stop_words
  FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN q USING (doc_id) LEFT JOIN b USING (doc_id)),
f AS (
  SELECT *, n_words < 50 AS f0, 100 * n_repeat_words > 50 * n_words AS f1, n_symbols > n_words AS f2, n_lines >= 4 AND 2 * n_dup_lines > n_lines AS f3,
    word_chars > 24 * n_words AS f4, n_lines >= 4 AND 10 * n_bullet_lines > 9 * n_lines AS f5, n_lines >= 4 AND 10 * n_ellipsis_lines > 3 * n_lines AS f6,
    n_words > 0 AND 10 * n_letter_words < 4 * n_words AS f7, n_words > 1 AND 10 * n_top_pair > 2 * n_words AS f8, 100 * n_repeat_5 > 40 * n_words AS f9,
    n_words >= 50 AND n_stop_words < 2 AS f10 FROM m)
"""
OP4_SQL = OP4_MEASURES + """
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_bullet_lines, n_ellipsis_lines, n_letter_words, n_top_pair, n_repeat_5, n_stop_words,
  (f0::INT + 2 * f1::INT + 4 * f2::INT + 8 * f3::INT + 16 * f4::INT + 32 * f5::INT + 64 * f6::INT + 128 * f7::INT + 256 * f8::INT + 512 * f9::INT + 1024 * f10::INT)::INT AS failed,
  f0 OR f1 AS base_failed, NOT (f0 OR f1 OR f2 OR f3 OR f4 OR f5 OR f6 OR f7 OR f8 OR f9) AS kept
FROM f
"""
ABLATION_SQL = OP4_MEASURES + """,
g AS (SELECT unnest(['few_words', 'repeated_words', 'symbol_heavy', 'repeated_lines', 'word_length', 'bullet_lines', 'ellipsis_lines', 'few_letters', 'top_pair', 'long_repeats']) AS rule,
  unnest([f0, f1, f2, f3, f4, f5, f6, f7, f8, f9]) AS bad, f0::INT + f1::INT + f2::INT + f3::INT + f4::INT + f5::INT + f6::INT + f7::INT + f8::INT + f9::INT AS n FROM f)
SELECT rule, count(*) FILTER (bad) AS n_failed, count(*) FILTER (bad AND n = 1) AS n_only FROM g GROUP BY rule
"""


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = spans.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select("doc_id", "n_sentences", "n_removed", F.char_length("text").cast("long").alias("kept_chars"), "text")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.code(documents(spark, sf_dir).select("doc_id", "text"), vocabulary(), keep=["doc_id"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir).select("doc_id", "text"))


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT d.b, r.m FROM r JOIN d ON d.a = r.doc_id WHERE r.m < d.b)
SELECT documents.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(m) AS component_id FROM documents LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY ALL
"""


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(documents(spark, sf_dir).select("doc_id", "text"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", both), (-7, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    made = chat.windows(rows)
    read = made.select(
        "conv_id",
        "window",
        chat.turns(F.col("formatted"), F.col("n_repeated")).alias("turns"),
        chat.under_mask(F.col("formatted"), F.col("loss")).alias("loss"),
        F.char_length("formatted").alias("chars"),
    )
    whole = read.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss", "chars"))).alias("w"))
    turns, loss = F.flatten(F.col("w.turns")), F.array_join(F.flatten(F.col("w.loss")), "")
    return whole.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.aggregate("w", F.lit(0).cast("long"), lambda n, x: n + x["chars"]).alias("formatted_chars"),
    )


OP3_SQL = r"""
WITH own AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM own),
b AS (SELECT *, row_number() OVER o AS pos, max((role <> 'system')::INT) OVER o = 0 AS lead,
    len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) + 4 AS n
  FROM a WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, sum(CASE WHEN lead THEN 0 ELSE n END) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS s,
    sum(CASE WHEN lead THEN n ELSE 0 END) OVER (PARTITION BY conv_id) AS kept FROM b),
d AS (SELECT *, CASE WHEN NOT lead THEN floor((s - 1) / greatest(1, floor((512 - 128 - kept) / 2))) END AS raw FROM c),
e AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY coalesce(raw, first_raw)) - 1 AS span
  FROM (SELECT *, coalesce(min(raw) OVER (PARTITION BY conv_id), 0) AS first_raw FROM d)),
f AS (SELECT *, max(span) OVER (PARTITION BY conv_id) AS last, max(s) OVER (PARTITION BY conv_id, span) AS until FROM e),
g AS (SELECT *, CASE WHEN lead THEN last - span WHEN span < last AND until - s + n <= 128 THEN 1 ELSE 0 END AS copies,
    length(role) + length(regexp_replace(role, '[^\\<>]+', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\<>]+', '', 'g')) + 15 AS chars FROM f)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars * (1 + copies))::BIGINT AS formatted_chars
FROM g GROUP BY conv_id
"""

def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    return found.select(
        "doc_id",
        *((F.size(base) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in pii.BASE),
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_added"),
    )


#: Fixed values of the query: host, path, action.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return urls.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = r"""
WITH r(host, path, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p AS (SELECT page_id, row_number() OVER () AS n, coalesce(translate(regexp_extract(url, '(?s)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
f AS (SELECT n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.action, length(r.host || r.path)) AS action
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN f USING (n)
"""


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    flagged = decontaminate.flag(documents(spark, sf_dir).select("doc_id", "text"), items)
    return flagged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP7_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
i AS (SELECT item_id, ws[s:s + least(13, len(ws)) - 1] AS win FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS s FROM b WHERE len(ws) > 0)),
l AS (SELECT DISTINCT len(win) AS n FROM i),
t AS (SELECT doc_id, w, p, lead(w) OVER (PARTITION BY doc_id ORDER BY p) AS w2 FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d)),
first AS (SELECT DISTINCT win[1] AS w, win[2] AS w2, win, len(win) AS n FROM i),
j AS (SELECT t.doc_id, t.p, f.win, f.n FROM t JOIN first f ON t.w = f.w AND (f.n = 1 OR t.w2 = f.w2)),
c AS (SELECT j.* FROM j JOIN d ON d.doc_id = j.doc_id AND d.ws[j.p:j.p + j.n - 1] = j.win),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM c) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT c.doc_id, i.item_id::VARCHAR AS id FROM c JOIN i USING (win)) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(documents(spark, sf_dir).select("doc_id", "text"))


def byte_vocabulary() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(documents(spark, sf_dir).select("doc_id", "text"), byte_vocabulary())
    small = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.place(small).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lloyd.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op13_sql(rounds: int = 10) -> str:
    """The rounds one after another, as tables c0, c1, ... of centroids."""
    gap = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i])))"
    lines = [
        "WITH e AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS k, v AS m FROM e ORDER BY sha256('3:' || vec_id), v LIMIT 8)",
    ]
    for i in range(rounds + 1):
        lines.append(f"a{i} AS MATERIALIZED (SELECT row, vec_id, v, min(struct_pack(d := d, k := k)) AS n FROM (SELECT row, vec_id, v, k, {gap} AS d FROM e, c{i}) GROUP BY ALL)")
        if i < rounds:
            lines.append(
                f"c{i + 1} AS MATERIALIZED (SELECT k, coalesce(f, m) AS m FROM c{i} LEFT JOIN (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS f FROM "
                f"(SELECT n.k AS k, i, sum(v[i]) AS s, count(*) AS n FROM a{i}, range(1, 65) r(i) GROUP BY ALL) GROUP BY k) USING (k))"
            )
    return (
        ",\n".join(lines) + f" SELECT vec_id, n.k::INTEGER AS cluster, n.d::BIGINT AS distance, sum(n.d) OVER (PARTITION BY n.k)::BIGINT AS cluster_inertia, "
        f"sum(n.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c{rounds}.k = n.k"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard": op1_ngram_jaccard,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_chat_formatting": op3_chat_formatting,
        "op5_personal_data": op5_personal_data,
        "op6_url_filters": op6_url_filters,
        "op7_decontamination": op7_decontamination,
        "op4_quality_rules": op4_quality_rules,
        "op8_suffix_array_dedup": op8_suffix_array_dedup,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_best_fit_packing": op12_best_fit_packing,
        "op13_centroid_clustering": op13_centroid_clustering,
        "quality_ablation": quality_ablation,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard": OP1_SQL,
        "op3_chat_formatting": OP3_SQL,
        "op4_quality_rules": OP4_SQL,
        "op6_url_filters": OP6_SQL,
        "op7_decontamination": OP7_SQL,
        "op13_centroid_clustering": op13_sql(),
        "quality_ablation": ABLATION_SQL,
    }
