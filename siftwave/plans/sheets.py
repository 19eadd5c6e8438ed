"""Queries of review sheets, output tables, comparison summaries, filters and scoring, with SQL twins.

Results are made from what the tables hold: labels give the verdict, pages the URL, documents the rest."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from siftwave.functions import reports as R
from siftwave.functions import text as T
from siftwave.functions import urls as U
from siftwave.operators import compare as C
from siftwave.operators import filters as X
from siftwave.operators import lookup as L
from siftwave.operators import scoring as K
from siftwave.operators import screening as S
from siftwave.operators import sheets as H
from siftwave.operators import signature_fit as G
from siftwave.operators import similar as N
from siftwave.operators import windows as W
from siftwave.plans.registry import APPROX, HOST_SQL, JOIN_SQL, SPACES, joined, query, table, verdict_log

SIGN_SQL = "CASE WHEN n_chars % 2 = 0 THEN regexp_extract(text, '[A-Za-z]{9,}', 0) ELSE regexp_extract(text, '[a-z]+ [a-z]+ [a-z]+ [a-z]+ [a-z]+', 0) END"
RES_SQL = rf"""k AS (SELECT count(*) AS k FROM pages),
r0 AS (SELECT d.doc_id AS id, coalesce(d.text, '') AS message, d.lang, d.source, d.n_chars, p.url, l.toxic = 1 AS is_spam, l.quality, coalesce(l.toxic = 1, false) AND coalesce(contains(p.url, '.net/'), false) AS red_group,
  CASE WHEN l.toxic = 1 AND d.lang = 'en' THEN 'Type_B (' || d.source || ')' WHEN l.toxic = 1 THEN 'Type_A' WHEN l.toxic = 0 THEN 'Ham' ELSE '' END AS semantic_class,
  CASE WHEN l.doc_id IS NOT NULL THEN d.source END AS code, (d.n_chars % 101) / 100.0 AS p, split_part(coalesce(d.text, ''), chr(10), 1) AS reason, coalesce(contains(p.url, 'blog.'), false) AS malicious_url, 'URL-' || d.source AS url_spam_code,
  d.lang = 'fr' AS is_trap, {SIGN_SQL} AS signature
  FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN pages p ON p.page_id = d.doc_id % (SELECT k FROM k)),
res AS (SELECT *, CAST({APPROX.format('signature')} AS INT) AS bytes, CASE WHEN {APPROX.format('signature')} <= 20 THEN 'string' ELSE 'sentence' END AS kind FROM r0)"""


def results(spark, d):
    n = table(spark, d, "pages").count()
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    rows = docs.join(labels, "doc_id", "left").withColumn("page_id", F.col("doc_id") % n).join(table(spark, d, "pages").select("page_id", "url"), "page_id", "left")
    toxic, text, has = F.col("toxic") == 1, F.coalesce("text", F.lit("")), lambda s: F.coalesce(F.contains("url", F.lit(s)), F.lit(False))
    cls = F.when(toxic & (F.col("lang") == "en"), F.concat(F.lit("Type_B ("), "source", F.lit(")"))).when(toxic, "Type_A").when(F.col("toxic") == 0, "Ham").otherwise("")
    sign = F.when(F.col("n_chars") % 2 == 0, F.regexp_extract("text", "[A-Za-z]{9,}", 0)).otherwise(F.regexp_extract("text", "[a-z]+ [a-z]+ [a-z]+ [a-z]+ [a-z]+", 0))
    rows = rows.select(
        F.col("doc_id").alias("id"), text.alias("message"), "lang", "source", "n_chars", "url", toxic.alias("is_spam"), "quality", (F.coalesce(toxic, F.lit(False)) & has(".net/")).alias("red_group"), cls.alias("semantic_class"),
        F.when(F.col("toxic").isNotNull(), F.col("source")).alias("code"), (F.col("n_chars") % 101 / 100.0).alias("p"), F.substring_index(text, "\n", 1).alias("reason"), has("blog.").alias("malicious_url"),
        F.concat(F.lit("URL-"), "source").alias("url_spam_code"), (F.col("lang") == "fr").alias("is_trap"), sign.alias("signature"),
    )
    size = T.approx_bytes(F.col("signature"))
    return rows.withColumns({"bytes": size, "kind": F.when(size <= 20, "string").otherwise("sentence")})


SHEET_SQL = rf"""{RES_SQL}, sheet AS (SELECT *, CASE WHEN red_group THEN '' WHEN starts_with(semantic_class, 'Type_B') OR coalesce(is_spam, false) THEN 'o' WHEN is_spam IS NULL THEN 'UNKNOWN' ELSE '' END AS mark,
  CASE WHEN is_spam = false AND NOT red_group THEN '' ELSE coalesce(nullif(regexp_extract(coalesce(code, ''), '[0-9]+', 0), ''), coalesce(code, '')) END AS sheet_code, CASE WHEN malicious_url THEN regexp_extract(source, '[0-9]+', 0) ELSE '' END AS url_code,
  CASE WHEN red_group THEN 'O' ELSE '' END AS red, coalesce(is_spam, false) AS counted FROM res)"""


@query(f"WITH {SHEET_SQL} SELECT id, mark, sheet_code, TRY_CAST(nullif(sheet_code, '') AS INT) AS code_int, url_code, red, counted, sheet_code = '3' AS finance FROM sheet")
def sheet_rows(spark, d):
    sheet = H.sheet_row(results(spark, d))
    found = H.finance_rows(sheet).select("id", F.lit(True).alias("finance"))
    return sheet.join(found, "id", "left").select("id", "mark", "sheet_code", "code_int", "url_code", "red", "counted", F.coalesce("finance", F.lit(False)).alias("finance"))


@query(
    f"""WITH {SHEET_SQL}, g AS (SELECT id, url, message, CASE WHEN red = 'O' THEN 1 WHEN starts_with(semantic_class, 'Type_') OR mark = 'o' THEN 0 WHEN semantic_class = 'Ham' THEN 2 ELSE 3 END AS rank FROM sheet)
SELECT id, rank, row_number() OVER (ORDER BY rank, CASE WHEN coalesce(url, '') = '' THEN 1 ELSE 0 END, trim(message), id) AS place FROM g"""
)
def review_sheet(spark, d):
    return H.review_sheet(H.sheet_row(results(spark, d)), "id").select("id", "rank", "place")


@query(f"WITH {RES_SQL} SELECT sha256(CASE WHEN left(message, 1) IN ('=', '+', '-', '@') THEN '''' || message ELSE message END) AS message, coalesce(url, '') AS url, '' AS mark, CAST({APPROX.format('message')} AS INT) AS message_len, CAST({APPROX.format('url')} AS INT) AS url_len FROM res")
def all_results(spark, d):
    return H.all_results(results(spark, d), T.approx_bytes).withColumn("message", F.sha2("message", 256))


@query(f"WITH u AS (SELECT DISTINCT url, CAST({APPROX.format('url')} AS INT) AS bytes FROM pages) SELECT url, bytes, row_number() OVER (ORDER BY bytes, url) AS place FROM u")
def url_sheet(spark, d):
    return H.url_sheet(table(spark, d, "pages").select("url", T.approx_bytes(F.col("url")).alias("bytes")).distinct())


@query(f"WITH {RES_SQL}, o AS (SELECT DISTINCT coalesce(is_trap, false) AS is_trap, kind, bytes, signature FROM res WHERE signature <> '') SELECT *, row_number() OVER (PARTITION BY is_trap, kind ORDER BY CASE kind WHEN 'string' THEN bytes ELSE -bytes END, signature) AS place FROM o")
def signature_sheets(spark, d):
    once = results(spark, d).filter("signature <> ''").select(F.coalesce("is_trap", F.lit(False)).alias("is_trap"), "kind", "bytes", "signature").distinct()
    return H.signature_sheets(once, "is_trap")


@query(
    f"""WITH {RES_SQL}, c AS (SELECT id, md5(reason) AS cluster, coalesce(is_spam, false) AS spam FROM res), s AS (SELECT cluster, count(*) AS size, count(*) FILTER (spam) AS spam_cnt FROM c GROUP BY cluster HAVING count(*) > 1)
SELECT id, cluster, size, spam_cnt, row_number() OVER (ORDER BY spam_cnt DESC, size DESC, cluster, id) AS place FROM c JOIN s USING (cluster)"""
)
def cluster_view(spark, d):
    rows = results(spark, d)
    logs = rows.select("id", F.coalesce("is_spam", F.lit(False)).alias("spam"))
    return H.cluster_view(rows.select("id", F.md5("reason").alias("cluster")), logs, "id", "cluster", "spam").select("id", "cluster", "size", "spam_cnt", "place")


VALID_SQL = rf"""{RES_SQL}, l AS (SELECT *, md5(translate(message, {SPACES}, '')) AS key FROM res),
sh AS (SELECT key, arg_max({{'spam': quality = 0, 'sig': CASE WHEN n_chars % 3 = 0 THEN '' ELSE signature END, 'url': CASE WHEN n_chars % 5 = 0 THEN '' ELSE url END, 'red': coalesce(contains(url, '.net/'), false)}}, id) AS s FROM l WHERE quality IS NOT NULL GROUP BY key),
e AS (SELECT l.*, CASE WHEN s IS NULL THEN 'unmatched' END AS e1, CASE WHEN coalesce(is_spam, false) AND signature = '' AND coalesce(url, '') = '' THEN 'signature_missing' END AS e2,
  CASE WHEN signature <> '' AND NOT (bytes BETWEEN 9 AND 20 OR bytes BETWEEN 39 AND 40) THEN 'signature_length' END AS e3, CASE WHEN regexp_matches({HOST_SQL}, '^[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}$') THEN 'url_ip' END AS e4, CASE WHEN s IS NOT NULL AND coalesce(url, '') <> coalesce(s.url, '') THEN 'url' END AS e5,
  CASE WHEN s IS NOT NULL AND coalesce(is_spam, false) <> s.spam THEN 'verdict' END AS e6, CASE WHEN s IS NOT NULL AND signature <> s.sig THEN 'signature' END AS e7, CASE WHEN s IS NOT NULL AND red_group <> s.red THEN 'red' END AS e8, CASE WHEN red_group AND malicious_url THEN 'red_dropped' ELSE '' END AS warnings
  FROM l LEFT JOIN sh USING (key)),
v AS (SELECT *, concat_ws(',', e1, e2, e3, e4, e5, e6, e7, e8) AS errors FROM e)"""


def validated(spark, d):
    rows = results(spark, d).withColumn("key", F.md5(T.strip_ascii_space(F.col("message"))))
    logs = rows.select("id", "key", "is_spam", F.col("signature").alias("sig"), "bytes", "url", F.col("red_group").alias("red"), F.col("malicious_url").alias("drop_url"))
    sheet = rows.filter("quality is not null").select(
        "key", F.col("id").alias("pos"), (F.col("quality") == 0).alias("sheet_spam"), F.when(F.col("n_chars") % 3 == 0, "").otherwise(F.col("signature")).alias("sheet_sig"),
        F.when(F.col("n_chars") % 5 == 0, "").otherwise(F.col("url")).alias("sheet_url"), F.coalesce(F.contains("url", F.lit(".net/")), F.lit(False)).alias("sheet_red"),
    )
    return C.validate_report(logs, sheet)


@query(f"WITH {VALID_SQL} SELECT id, errors, warnings FROM v")
def report_validation(spark, d):
    return validated(spark, d).drop("sig")


@query(f"WITH {VALID_SQL} SELECT count(*) FILTER (e1 IS NULL) AS checked, count(*) FILTER (e1 IS NULL AND (e6 IS NOT NULL OR e7 IS NOT NULL)) AS mismatches, count(*) FILTER (errors <> '') AS errors, count(*) FILTER (errors = '' AND warnings <> '') AS warnings, count(*) FILTER (coalesce(signature, '') = '') AS no_signature FROM v")
def validation_counts(spark, d):
    return C.validation_counts(validated(spark, d))


@query(
    f"""WITH {VALID_SQL}, c AS (SELECT source, count(*) FILTER (coalesce(is_spam, false)) AS n FROM v GROUP BY source)
SELECT id, row_number() OVER (ORDER BY n DESC, source, CASE WHEN errors <> '' THEN 0 WHEN warnings <> '' THEN 1 ELSE 2 END, id) AS place FROM v JOIN c USING (source)"""
)
def validation_order(spark, d):
    rows = validated(spark, d).join(results(spark, d).select("id", "source", F.coalesce("is_spam", F.lit(False)).alias("spam")), "id")
    return H.validation_order(rows, "source", "id").select("id", "place")


@query("SELECT doc_id AS id, row_number() OVER (ORDER BY left(regexp_replace(text, '[^a-zA-Z]', '', 'g'), 30) NULLS FIRST, doc_id) AS place FROM documents")
def similarity_order(spark, d):
    return H.similarity_order(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "text", "id").select("id", "place")


@query("SELECT event_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT 30")
def recent_hits(spark, d):
    return H.most_recent(table(spark, d, "events").filter("event_type = 'error'").select("event_id", "ts"), "ts", "event_id")


@query("SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS newest, row_number() OVER (ORDER BY ts, event_id) AS oldest, row_number() OVER (ORDER BY lower(props), event_id) AS message FROM events")
def example_orders(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts", "props")
    one = lambda by: H.example_order(rows, by, "ts", "props", "event_id").select("event_id", F.col("place").alias(by))
    return one("newest").join(one("oldest"), "event_id").join(one("message"), "event_id")


@query("WITH c AS (SELECT * FROM customer WHERE contains(lower(c_mktsegment), 'build')) SELECT c_custkey, c_acctbal, (SELECT count(*) FROM c) AS total FROM c ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 10")
def searched_page(spark, d):
    rows = table(spark, d, "customer")
    return H.page_with_total(rows, 2, 10, "c_acctbal", ["c_acctbal", "c_name"], "c_name", "c_custkey", "BUILD", ("c_mktsegment",)).select("c_custkey", "c_acctbal", "total")


@query("WITH n AS (SELECT event_type, count(*) AS hits, count(DISTINCT user_id) AS users FROM events GROUP BY event_type), o AS (SELECT event_type, count(*) FILTER (value > 990) AS hits, 0 AS users FROM events WHERE event_type <> 'error' GROUP BY event_type) SELECT event_type, CASE WHEN coalesce(o.hits, 0) <> 0 THEN o.hits ELSE n.hits END AS hits, n.users FROM n LEFT JOIN o USING (event_type)")
def kept_summary(spark, d):
    e = table(spark, d, "events")
    new = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("user_id").alias("users"))
    old = e.filter("event_type <> 'error'").groupBy("event_type").agg(F.count_if(F.col("value") > 990).alias("hits"), F.lit(0).cast("long").alias("users"))
    return H.kept_counts(old, new, "event_type")


@query("WITH g AS (SELECT user_id, count(*) AS rows, arg_max(event_id, {'t': ts, 'i': event_id}) AS kept, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY user_id HAVING count(*) > 1) SELECT user_id, rows, kept, array_to_string(list_filter(ids, lambda x: x <> kept), ' ') AS gone FROM g")
def duplicate_report(spark, d):
    return H.duplicate_report(table(spark, d, "events"), "user_id", "ts", "event_id").withColumn("gone", F.array_join("gone", " "))


_COUNTED = "sheet WHERE counted AND coalesce(is_trap, false) = {}"
_ROWS = "SELECT '{}' AS name, count(*) AS rows FROM {}"


def _tables_sql() -> str:
    parts = []
    for trap, names in (("false", H.TABLES[:6]), ("true", [*H.TABLES[6:8], *H.TABLES[9:13]])):
        signed = f"({'SELECT * FROM ' + _COUNTED.format(trap)} AND lower(coalesce(signature, '')) NOT IN ('', 'none', 'unextractable'))"
        url = rf"(SELECT DISTINCT {HOST_SQL}, regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM {_COUNTED.format(trap)} AND coalesce(url, '') <> '')"
        every = f"sheet WHERE coalesce(is_trap, false) = {trap}"
        sources = [every, every, url, signed, f"(SELECT DISTINCT signature FROM {signed} WHERE kind = 'string')", f"(SELECT DISTINCT signature FROM {signed} WHERE kind = 'sentence')"]
        parts += [_ROWS.format(n, s) for n, s in zip(names, sources, strict=True)]
    parts += [_ROWS.format(H.TABLES[8], _COUNTED.format("true")), _ROWS.format(H.TABLES[13], "sheet WHERE sheet_code = '3'")]
    return f"WITH {SHEET_SQL} " + " UNION ALL ".join(parts)


@query(_tables_sql())
def output_table_rows(spark, d):
    """Rows of each of the named output tables."""
    rows = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in H.output_tables(results(spark, d), T.approx_bytes).items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


DIFF_SQL = f"{JOIN_SQL}, dif AS (SELECT human_id AS id, human_spam, machine_spam, machine_id, split_part(coalesce(text, ''), chr(10), 1) AS message, side FROM j JOIN documents ON doc_id = human_id WHERE side <> 'right')"


def diffs(spark, d):
    j = joined(spark, d).filter("side <> 'right'")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("human_id"), F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("message"))
    return j.join(docs, "human_id")


@query(
    f"""WITH {DIFF_SQL} SELECT id, CASE WHEN left(message, 1) IN ('=', '+', '-', '@') THEN '''' || message ELSE message END AS message, CASE WHEN human_spam THEN 'SPAM' ELSE 'HAM' END AS human,
  CASE WHEN machine_spam IS NULL THEN '누락' WHEN machine_spam THEN 'SPAM' ELSE 'HAM' END AS machine, CASE WHEN machine_id IS NULL THEN 'MISSING_IN_LLM' WHEN human_spam = coalesce(machine_spam, false) THEN 'MATCH' WHEN human_spam THEN 'FN (미탐)' ELSE 'FP (오탐)' END AS status,
  CASE WHEN left(message, 1) IN ('=', '+', '-', '@') THEN '''' || message ELSE message END AS reason FROM dif"""
)
def exported_diffs(spark, d):
    rows = C.human_rows(diffs(spark, d)).select(F.col("human_id").alias("id"), "message", F.col("message").alias("reason"), "human_spam", "machine_spam", F.col("match_status").alias("status"))
    return H.export_diffs(rows)


@query(f"WITH {JOIN_SQL} SELECT human_id, CASE WHEN machine_id IS NULL THEN 'MISSING_IN_LLM' WHEN human_spam = coalesce(machine_spam, false) THEN 'MATCH' WHEN human_spam THEN 'FN' ELSE 'FP' END AS match_status, row_number() OVER (ORDER BY human_id) AS place FROM j WHERE side <> 'right'")
def human_rows(spark, d):
    return C.human_rows(joined(spark, d)).select("human_id", "match_status", "place")


@query(
    f"""WITH {JOIN_SQL}, a AS (SELECT count(*) AS total_human, count(*) FILTER (is_spam) AS human_spam FROM h0), b AS (SELECT count(*) AS total_machine, count(*) FILTER (is_spam) AS machine_spam FROM m0),
c AS (SELECT count(*) AS matched, count(*) FILTER (coalesce(human_spam, false) = coalesce(machine_spam, false)) AS same FROM j WHERE side = 'both')
SELECT a.*, b.*, matched, human_spam * 1.0 / total_human AS human_spam_rate, machine_spam * 1.0 / total_machine AS machine_spam_rate, matched * 1.0 / total_human AS match_rate, CASE WHEN matched > 0 THEN same * 1.0 / matched ELSE 0.0 END AS agreement_rate FROM a, b, c"""
)
def comparison_summary(spark, d):
    human = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select((F.col("toxic") == 1).alias("is_spam"))
    return C.comparison_summary(human, verdict_log(spark, d), joined(spark, d))


@query(
    rf"""WITH {RES_SQL}, x AS (SELECT *, coalesce(lang = 'de' AND quality IS NULL, false) AS skip, CASE WHEN message IS NULL OR message = '' THEN 0 ELSE len(regexp_extract_all(message, 'https?://[^ \t\r\n\f\v]+')) END AS n FROM res)
SELECT count(*) AS total, count(*) FILTER (skip) AS skip, count(*) FILTER (NOT skip AND coalesce(is_spam, false)) AS spam, count(*) FILTER (NOT skip AND NOT coalesce(is_spam, false)) AS ham, count(*) FILTER (NOT skip AND (contains(reason, 'Override') OR starts_with(semantic_class, 'Type_B'))) AS overrides,
  count(*) FILTER (NOT skip AND malicious_url) AS url_spam, CAST(coalesce(sum(n) FILTER (NOT skip), 0) AS BIGINT) AS model_urls FROM x"""
)
def report_stats(spark, d):
    code = F.when((F.col("lang") == "de") & F.col("quality").isNull(), "SKIP").otherwise(F.col("code"))
    return C.report_stats(results(spark, d).withColumns({"code": code, "class": F.col("semantic_class"), "url_spam": F.col("malicious_url"), "model_urls": F.regexp_extract_all("message", F.lit(r"https?://[^ \t\r\n\f\x0b]+"), F.lit(0))}))


@query(
    f"""WITH {RES_SQL}, x AS (SELECT *, coalesce(is_spam, false) AS s, quality = 0 AS flagged, CASE WHEN is_spam AND p < 0.5 THEN 'LOW' END AS category, coalesce(is_trap, false) AS t FROM res)
SELECT 'SPAM' AS status, id FROM x WHERE s AND NOT red_group UNION ALL SELECT 'HAM', id FROM x WHERE NOT s AND NOT red_group UNION ALL SELECT 'RED_GROUP', id FROM x WHERE red_group UNION ALL SELECT 'FLAGGED', id FROM x WHERE flagged
UNION ALL SELECT 'REVIEW', id FROM x WHERE category IS NOT NULL UNION ALL SELECT 'LOW', id FROM x WHERE category = 'LOW' UNION ALL SELECT 'TRAP', id FROM x WHERE t UNION ALL SELECT 'MAIN', id FROM x WHERE NOT t UNION ALL SELECT 'ALL', id FROM x"""
)
def status_filters(spark, d):
    rows = results(spark, d).withColumns({"flagged": F.col("quality") == 0, "category": F.when(F.col("is_spam") & (F.col("p") < 0.5), "LOW")})
    parts = {s: X.by_status(rows, s) for s in ("SPAM", "HAM", "RED_GROUP", "FLAGGED", "REVIEW")} | {"LOW": X.by_status(rows, "REVIEW", "LOW")} | {t: X.by_family(rows, t) for t in ("TRAP", "MAIN", "ALL")}
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("status"), "id")
        out = one if out is None else out.union(one)
    return out


@query(
    f"""WITH {RES_SQL} SELECT 'all' AS test, id FROM res WHERE {APPROX.format('message')} BETWEEN 300 AND 4000 AND code IN ('src1', 'src2', 'src3', 'src4') AND coalesce(url, '') <> '' AND signature <> '' AND p BETWEEN 0.1 AND 0.8
UNION ALL SELECT 'unsigned', id FROM res WHERE lower(trim(signature)) IN ('', 'none', 'unextractable') UNION ALL SELECT 'tagged', id FROM res WHERE contains(reason, 'the')
UNION ALL SELECT 'search', id FROM res WHERE contains(lower(message), 'water') OR contains(lower(source), 'src7') UNION ALL SELECT 'examples', id FROM res WHERE lang = 'es' AND (contains(lower(message), 'de la') OR contains(lower(reason), 'de la'))"""
)
def advanced_filters(spark, d):
    rows = results(spark, d)
    parts = {
        "all": X.advanced(rows, T.approx_bytes, (300, 4000), ["src1", "src2", "src3", "src4"], True, True, (0.1, 0.8)), "unsigned": X.advanced(rows, signature=False), "tagged": X.advanced(rows, cache="the"),
        "search": X.search_logs(rows, "WATER", "message").unionByName(X.search_logs(rows, "SRC7", "source")).dropDuplicates(["id"]), "examples": X.examples(rows.withColumn("label", F.col("lang")), "es", "De La"),
    }
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("test"), "id")
        out = one if out is None else out.union(one)
    return out


@query("SELECT doc_id, 'license' AS family FROM documents WHERE contains(text, 'License') OR contains(text, 'rights reserved') UNION ALL SELECT doc_id, 'secret' FROM documents WHERE contains(text, 'token') OR contains(text, '@')")
def keyword_cases(spark, d):
    rows = table(spark, d, "documents").withColumnRenamed("text", "message")
    return X.keyword_cases(rows, {"license": ["License", "rights reserved"], "secret": ["token", "@"]}).select("doc_id", "family")


@query("SELECT doc_id AS seq, CASE WHEN coalesce(length(text), 0) = 0 OR contains(text, 'License') THEN NULL ELSE length(text) % 2 = 0 END AS is_spam, CASE WHEN coalesce(length(text), 0) = 0 OR contains(text, 'License') THEN 'ValueError: unreadable' ELSE 'scored' END AS reason FROM documents")
def scored_batches(spark, d):
    """A scorer that fails on some rows: they get the error, the others of their batch their score."""

    def scorer(rows: pd.DataFrame) -> pd.DataFrame:
        text = rows["message"].fillna("")
        if (text == "").any() or text.str.contains("License").any():
            raise ValueError("unreadable")
        return pd.DataFrame({"is_spam": text.str.len() % 2 == 0, "reason": "scored"})

    rows = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.col("text").alias("message"))
    return K.score_batches(rows, scorer, "is_spam boolean, reason string", batch=64)


BAND_SQL = """band AS (SELECT *, CASE WHEN is_spam AND p >= 0.6 THEN 'SPAM' WHEN is_spam AND p >= 0.4 THEN 'HITL' WHEN is_spam IS NULL THEN 'HOLD_SHORT' ELSE 'HAM' END AS verdict, printf('%.2f', p) AS shown,
  CASE WHEN code IN ('src1', 'src2') THEN right(code, 1) WHEN code IS NOT NULL THEN 'HAM-' || right(code, 1) END AS given FROM res)"""


@query(
    f"""WITH {RES_SQL}, {BAND_SQL} SELECT id, verdict, CASE verdict WHEN 'HITL' THEN '30' WHEN 'HAM' THEN CASE WHEN given IN ('0', '1', '2', '3', '10') THEN NULL ELSE given END ELSE given END AS code,
  CASE WHEN verdict = 'HITL' THEN '[HITL] Probability (' || shown || ') is ambiguous. Requesting user feedback. | ' || reason WHEN verdict = 'HAM' AND is_spam THEN '[Override] LLM output SPAM but probability is too low (' || shown || '). Forced HAM. | ' || reason ELSE reason END AS reason,
  CASE verdict WHEN 'HITL' THEN p >= 0.5 WHEN 'SPAM' THEN true WHEN 'HAM' THEN false END AS final_spam FROM band"""
)
def banded_verdicts(spark, d):
    code = F.when(F.col("code").isin("src1", "src2"), F.right("code", F.lit(1))).when(F.col("code").isNotNull(), F.concat(F.lit("HAM-"), F.right("code", F.lit(1))))
    label = F.when(F.col("is_spam"), "SPAM").when(F.col("is_spam").isNull(), "HOLD_SHORT").otherwise("HAM")
    rows = results(spark, d).withColumn("b", S.band(label, F.col("p"), code, F.col("reason")))
    # Held rows become final from 0.9; 0.5 stands for a p of 0.9 here, as held ones have at most 0.6.
    final = S.finalize_hold(F.col("b.is_spam"), F.col("b.code"), F.col("p") + 0.4)["is_spam"]
    return rows.select("id", "b.verdict", "b.code", "b.reason", final.alias("final_spam"))


@query(
    f"""WITH {RES_SQL} SELECT id, CASE WHEN malicious_url THEN 'Ham' WHEN is_spam AND (contains(message, 'the') OR contains(message, '@') OR (coalesce(contains(url, '.org/'), false) AND quality = 1)) THEN 'Type_B' WHEN is_spam THEN 'Type_A' ELSE 'Ham' END AS class,
  bytes <= 20 AND regexp_matches(signature, '(?i)[a-z0-9-]+\\.(com|net|org|kr|me|ly|gl|io|co)\\b') AS domain FROM res"""
)
def policy_classes(spark, d):
    m = F.col("message")
    rows = results(spark, d).withColumns({"confirmed_safe": F.col("malicious_url"), "final_spam": F.col("is_spam"), "impersonation": F.contains(m, F.lit("the")), "vague_cta": F.lit(None).cast("boolean"), "lure": F.lit(False), "garbage": F.contains(m, F.lit("@")), "url_spam": F.contains("url", F.lit(".org/")), "content_spam": F.col("quality") == 0})
    return rows.select("id", S.policy_class(rows).alias("class"), X.short_signature_domains(rows).alias("domain"))


@query("WITH g AS (SELECT a.vec_id AS query_id, b.vec_id AS hit_id, b.label, 1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 1 AND b.vec_id % 2 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, hit_id) AS rank FROM g QUALIFY rank <= 3), s AS (SELECT query_id, max(distance) FILTER (rank = 1) AS d1, coalesce(max(distance) FILTER (rank = 2), max(distance) FILTER (rank = 1)) AS d2, count(*) FILTER (label > 0) AS spam_count, count(*) FILTER (distance <= 0.95) AS near, count(*) FILTER (distance < 0.05) AS copies FROM r GROUP BY query_id) SELECT query_id, round(d1, 5) AS d1, round(d2, 5) AS d2, round(d2 - d1, 5) AS gap, spam_count, near, copies FROM s")
def neighbour_gaps(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    hits = N.knn(e.filter("id % 2 = 1").select("id", "v"), e.filter("id % 2 = 0").select("id", "v")).join(e.select(F.col("id").alias("hit_id"), "label"), "hit_id")
    close = X.within_distance(hits).groupBy("query_id").agg(F.count(F.lit(1)).alias("near"), F.count_if("near_copy").alias("copies"))
    out = N.gap_stats(hits).join(close, "query_id", "left")
    return out.select("query_id", *[F.round(c, 5).alias(c) for c in ("d1", "d2", "gap")], "spam_count", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("near", "copies")])


@query(
    f"""WITH {RES_SQL}, x AS (SELECT *, CASE WHEN is_spam AND NOT coalesce(quality = 0, false) THEN 'FN' WHEN NOT is_spam AND quality = 0 THEN 'FP' END AS way FROM res)
SELECT 'FN' AS filter, id FROM x WHERE way = 'FN' UNION ALL SELECT 'FP src3', id FROM x WHERE way = 'FP' AND source = 'src3' UNION ALL SELECT 'text', id FROM x WHERE way IS NOT NULL AND (contains(lower(message), 'the') OR contains(lower(reason), 'the')) UNION ALL SELECT 'kept', id FROM x WHERE NOT coalesce(lang = 'es', false)"""
)
def filtered_diffs(spark, d):
    rows = results(spark, d)
    kind = F.when(F.col("is_spam") & ~F.coalesce(F.col("quality") == 0, F.lit(False)), "FN").when(~F.col("is_spam") & (F.col("quality") == 0), "FP")
    rows = rows.withColumns({"kind": kind, "excluded": F.col("lang") == "es"})
    known = rows.filter("kind is not null")
    parts = {"FN": X.filter_diffs(known, "FN"), "FP src3": X.filter_diffs(known, "FP", "src3"), "text": X.filter_diffs(known, q="THE"), "kept": X.drop_excluded(rows)}
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("filter"), "id")
        out = one if out is None else out.union(one)
    return out


@query(
    rf"""WITH {RES_SQL} SELECT id, regexp_replace(CASE WHEN n_chars % 2 = 0 THEN '''' || reason ELSE reason END, '^''([=+@-])', '\1') AS cell, regexp_replace(CAST(p AS VARCHAR), '\.0$', '') AS number, lower(trim(lang)) = 'en' AS marked,
  CASE WHEN coalesce(url, '') <> '' AND reason <> '' THEN '[Content_Fallback: ' || url || '] ' || reason ELSE reason END AS fallback, translate(signature, ' ' || chr(13) || chr(10), '') AS sig,
  CASE WHEN p >= 0.75 AND quality = 1 THEN 'stable' WHEN p >= 0.65 AND coalesce(quality, 0) = 1 THEN 'watch' ELSE 'improve' END AS day, printf('agreement %.1f%%, kappa %.3f, %d missed and %d false alarms', p * 100, p, n_chars, n_chars % 7) AS story,
  regexp_matches(message, '(https?://|www\.)[^ \t\r\n\f\v]|[a-zA-Z0-9.?-]\.[a-zA-Z]{{2}}') AS token, len(list_distinct(list_filter(list_transform(regexp_extract_all(message, 'https?://[^ \t\r\n<>"'']+'), lambda u: regexp_replace(u, '[.,;:!?)\]}}"'']+$', '')), lambda u: NOT regexp_matches(u, '://(www\.)?(bit\.ly|t\.me|t\.co)')))) AS plain FROM res"""
)
def display_columns(spark, d):
    reason, p, n = F.col("reason"), F.col("p"), F.col("n_chars")
    quoted = F.when(n % 2 == 0, F.concat(F.lit("'"), reason)).otherwise(reason)
    miss = F.when(F.col("quality") == 1, 0.0).otherwise(0.5)
    return results(spark, d).select(
        "id", T.unsafe_cell(quoted).alias("cell"), T.without_point_zero(p.cast("string")).alias("number"), T.is_o(F.translate("lang", "en", "o"), True).alias("marked"),
        R.with_fallback(reason, F.coalesce("url", F.lit(""))).alias("fallback"), T.signature_text(F.col("signature")).alias("sig"), R.day_verdict(p, miss).alias("day"), R.narrative(p, p, n, n % 7).alias("story"),
        T.has_url_token(F.col("message")).alias("token"), F.size(U.plain_urls(F.col("message"))).cast("long").alias("plain"),
    )


@query(
    f"""WITH {RES_SQL}, o AS (SELECT url, id, 'ordinary' AS kind FROM res WHERE coalesce(is_trap, false) = false AND url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY id) = 1),
s AS (SELECT url, id, 'short' AS kind FROM res WHERE coalesce(is_trap, false) AND url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY id) = 1)
SELECT * FROM s UNION ALL SELECT * FROM o WHERE url NOT IN (SELECT url FROM s)"""
)
def merged_url_maps(spark, d):
    main, trap = H.split_families(H.tagged_union(*H.split_families(results(spark, d).select("id", "url", "is_trap").filter("url is not null"))))
    once = lambda df, kind: L.first_wins(df, "url", "id").withColumn("kind", F.lit(kind))
    return H.merge_url_maps(once(main, "ordinary"), once(trap, "short"), "url")


@query("WITH e AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS place FROM events), t AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), g AS (SELECT day, n, row_number() OVER (ORDER BY day) AS place FROM t) SELECT 'event' AS what, CAST(event_id AS VARCHAR) AS name, place FROM e UNION ALL SELECT 'day', strftime(day, '%Y-%m-%d') || ' ' || n, place FROM g")
def restored_orders(spark, d):
    """Events that finish in any order, back in theirs, and a trend by date."""
    e = table(spark, d, "events")
    done = W.global_position(e.select("event_id", "ts").repartition(7), F.col("ts"), "event_id", name="place")
    days = W.global_position(e.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")), "day", name="place")
    return done.select(F.lit("event").alias("what"), F.col("event_id").cast("string").alias("name"), "place").union(days.select(F.lit("day"), F.concat_ws(" ", F.date_format("day", "yyyy-MM-dd"), "n"), "place"))


_CANDS = r"list_distinct(flatten([regexp_extract_all(body, '0[0-9]{1,2}[-.]?[0-9]{3,4}[-.]?[0-9]{4}'), regexp_extract_all(body, '080[-.]?[0-9]{3,4}[-.]?[0-9]{4}'), regexp_extract_all(body, '[▶◀★◆■#☎☏@]'), regexp_extract_all(body, '[A-Za-z0-9]{5,}')]))"


def _score_sql(c: str) -> str:
    phone, code, marks = (f"regexp_matches({c}, '{p}')" for p in ("0[0-9]{1,2}[-.]?[0-9]{3,4}[-.]?[0-9]{4}", "[A-Za-z0-9]{5,}", "[▶◀★◆■#☎☏@]"))
    return f"""(CASE WHEN {APPROX.format(c)} <= 8 THEN -3.0 ELSE 0.0 END + CASE WHEN regexp_matches({c}, '^[0-9]+$') THEN -2.0 ELSE 0.0 END + CASE WHEN {phone} THEN 15.0 ELSE 0.0 END
  + CASE WHEN regexp_matches({c}, '080[-.]?[0-9]{{3,4}}[-.]?[0-9]{{4}}') THEN 1.0 ELSE 0.0 END + CASE WHEN {marks} THEN 12.0 ELSE 0.0 END + CASE WHEN {code} THEN 8.0 ELSE 0.0 END)"""


@query(
    f"""WITH b AS (SELECT doc_id, translate(coalesce(text, ''), {SPACES}, '') AS body FROM documents), c AS (SELECT doc_id, unnest({_CANDS}) AS c FROM b), s AS (SELECT doc_id, c, CAST({_score_sql('c')} AS DOUBLE) AS score FROM c),
g AS (SELECT doc_id, count(*) AS n, arg_max(c, {{'s': score, 'c': c}}) AS text, max(score) AS score FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n, text, score FROM b LEFT JOIN g USING (doc_id)"""
)
def signature_scores(spark, d):
    """The best candidate among the anchors of each whole text."""
    bare = table(spark, d, "documents").select("doc_id", T.strip_ascii_space(F.coalesce("text", F.lit(""))).alias("bare"))
    return G.best_anchors(bare, "doc_id", "bare", T.approx_bytes)
