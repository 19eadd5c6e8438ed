"""Signature rules and the output tables: candidates, validation, block lists, summary, audits, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwave.functions import urls as U

#: Words that no signature may hold, and the allowed byte lengths of strings and sentences.
FORBIDDEN = ["광고", "(광고)", "[광고]", "080-", "무료거부", "수신거부", "무료수신거부"]
STRING_BYTES, SENTENCE_BYTES = (9, 20), (39, 40)


def sized(size: Column, kind: tuple[int, int]) -> Column:
    return size.between(*kind)


def candidates(df: DataFrame, key: str, body: str, size, limit: int = 20, least: int = 4) -> DataFrame:
    """All windows of a short text of `least` to `limit` bytes: key, at, candidate, bytes. About `limit` rows a character."""
    starts = df.filter(F.char_length(body) > 0).select(key, body, F.explode(F.sequence(F.lit(1), F.char_length(body))).alias("at"))
    cut = starts.select(key, "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(limit), F.char_length(body) - F.col("at") + 1))).alias("n"), body)
    rows = cut.select(key, "at", F.substring(F.col(body), F.col("at"), F.col("n")).alias("candidate"))
    return rows.withColumn("bytes", size(F.col("candidate"))).filter(F.col("bytes").between(least, limit))


def candidate_score(candidate: Column, size: Column) -> Column:
    """Short texts lose 3, texts of digits alone lose 2."""
    return F.when(size <= 8, -3.0).otherwise(0.0) + F.when(candidate.rlike("^[0-9]+$"), -2.0).otherwise(0.0)


def top_candidates(df: DataFrame, key: str, k: int) -> DataFrame:
    """The best k different candidates of each key by score, bytes, text."""
    once = df.groupBy(key, "candidate").agg(F.max("score").alias("score"), F.max("bytes").alias("bytes"))
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.desc("bytes"), "candidate")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def signature_error(body: Column, signature: Column, decision: Column, size: Column) -> Column:
    """Why a proposed signature is refused; null if it isn't."""
    # URLs lie within stretches of their characters, so only stretches that hold the signature are searched for them.
    held = F.filter(F.split(body, r"[^A-Za-z0-9@:%_+.~#?&/=-]+"), lambda s: F.contains(s, signature) & F.contains(s, F.lit(".")))
    urls = lambda s: F.regexp_extract_all(s, F.lit(r"(?:https?://|www\.)?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,6}[A-Za-z0-9@:%_+.~#?&/=-]*"), F.lit(0))
    named = signature.rlike("^[A-Za-z0-9@:%_+.~#?&/=-]+$")
    inside_url = named & F.exists(held, lambda s: F.exists(urls(s), lambda u: F.contains(u, signature)))
    holds = lambda word: F.contains(signature, F.lit(word))
    forbidden = holds(FORBIDDEN[0])
    for word in FORBIDDEN[1:]:
        forbidden = forbidden | holds(word)
    error = F.when(decision == "unextractable", None).when(~F.coalesce(decision.isin("use_string", "use_sentence"), F.lit(False)), "decision")
    error = error.when(F.coalesce(signature, F.lit("")) == "", "empty").when(~F.contains(body, signature), "absent").when(inside_url & U.is_bare(signature), "bare_domain").when(forbidden, "forbidden")
    return error.when(size < STRING_BYTES[0], "short").when((decision == "use_string") & ~sized(size, STRING_BYTES), "string_length").when((decision == "use_sentence") & ~sized(size, SENTENCE_BYTES), "sentence_length")


def signature_tables(df: DataFrame, signature: str, order: str, size: Column) -> DataFrame:
    """Each signature once, as first seen: signature, first, bytes, kind (string up to 20 bytes, else sentence)."""
    rows = df.filter(F.coalesce(F.lower(signature), F.lit("none")).isin("", "none", "unextractable") == False)  # noqa: E712
    once = rows.groupBy(signature).agg(F.min(order).alias("first")).withColumn("bytes", size)
    return once.withColumn("kind", F.when(F.col("bytes") <= STRING_BYTES[1], "string").otherwise("sentence"))


def summary(df: DataFrame, family: str, spam: Column, url: str, signature: str, size: Column) -> DataFrame:
    """Counts of a family: spam rows, different URLs, strings and sentences of spam rows."""
    once = lambda c, when=None: F.count_distinct(F.when(spam & (when if when is not None else F.lit(True)), F.nullif(F.col(c), F.lit(""))))
    return df.groupBy(family).agg(F.count_if(spam).alias("spam_cnt"), once(url).alias("url_cnt"), once(signature, size <= STRING_BYTES[1]).alias("string_cnt"), once(signature, size > STRING_BYTES[1]).alias("sentence_cnt"))


def audit(df: DataFrame, id: str, url: str, signature: str, kind: str, size: Column, marked: Column, red: Column, max_url: int = 40) -> DataFrame:
    """One row for each broken rule of an output row: id, rule."""
    rules = {
        "red_marked": red & marked,
        "url_ip": U.is_ip(F.col(url)),
        "url_long": F.char_length(url) > max_url,
        "string_length": (F.col(kind) == "string") & ~sized(size, STRING_BYTES),
        "sentence_length": (F.col(kind) == "sentence") & ~sized(size, SENTENCE_BYTES),
    }
    broken = F.filter(F.array(*[F.when(c, name) for name, c in rules.items()]), lambda r: r.isNotNull())
    return df.select(id, F.explode(broken).alias("rule"))


def reconcile(stated: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Counts of a stated summary that differ from the actual one: key, name, stated, actual (0 where a side has no row)."""
    names = [c for c in stated.columns if c != key]
    long = lambda df, as_: df.unpivot(key, names, "name", as_)
    both = long(stated, "stated").join(long(actual.select(key, *names), "actual"), [key, "name"], "full").na.fill(0, ["stated", "actual"])
    return both.filter("stated <> actual")


def cluster_report(members: DataFrame, cluster: str, spam: str, code: str, signature: str) -> DataFrame:
    """Clusters of two or more: size, spam count, what differs in them, and the order of review."""
    sig = F.nullif(F.col(signature), F.lit(""))
    g = members.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), F.count_if(spam).alias("spam_cnt"), F.count_distinct(spam).alias("verdicts"), F.count_distinct(code).alias("codes"), F.count_distinct(sig).alias("sigs"))
    differs = F.concat_ws(",", F.when(F.col("verdicts") > 1, "verdict"), F.when(F.col("codes") > 1, "code"), F.when(F.col("sigs") > 1, "signature"))
    return g.filter("size > 1").select(cluster, "size", "spam_cnt", differs.alias("differs"), (F.col("sigs") > 1).alias("fragmented"))


def bulk_history(target: DataFrame, files: DataFrame, key: str, file: str, start: int = 10) -> DataFrame:
    """Counts after loading files in turn: a new key starts at `start`, each further file adds one."""
    seen = files.groupBy(key).agg(F.count_distinct(file).alias("files"))
    both = target.join(seen, key, "full")
    added = F.coalesce("files", F.lit(0))
    return both.select(key, F.when(F.col("count").isNull(), F.lit(start - 1) + added).otherwise(F.col("count") + added).alias("count"))


def page_flags(text: Column) -> Column:
    """Whether a page is a captcha, a protection page or an error page."""
    low = F.lower(text)
    return F.struct(low.rlike("captcha|are you (a )?human").alias("captcha"), low.rlike("cloudflare|checking your browser|access denied").alias("guarded"), low.rlike("403 forbidden|404 not found|page not found").alias("missing"))


def clip(text: Column, limit: int = 5000, head: int = 3000, tail: int = 2000, mark: str = " ... ") -> Column:
    return F.when(F.char_length(text) > limit, F.concat(F.left(text, F.lit(head)), F.lit(mark), F.right(text, F.lit(tail)))).otherwise(text)
