"""URL filters: fixed rules first, then the ratio of two character language models.

Models of accepted and rejected URLs are learned from the URLs that rules decide. They are
variable-order Markov models: each character is predicted from the longest context of up to ORDER
characters seen at least `min_count` times, with counts smoothed towards the next shorter context. The
score of a URL is the mean log-likelihood difference per character. A fifth of the labelled URLs, drawn by a
hash of the URL, is held out of the models; the cut is where both classes of those err equally under a normal
approximation of their scores. Where one class has none of them, the cut is 0, where both models fit alike.

Counts and the model are keyed by the exact grams (a context and its character), so the model grows with
the different grams of the labelled URLs; counts are summed before the shuffle. What a character scores
depends on the longest gram that ends with it, so the different grams of the pages are scored once. Those
values are broadcast while they are few; beyond that only those of common grams are (at most the bound, as
the threshold rises with the total) and the rest is joined by a shuffle.

Defined cases: a null URL or one without "://" has empty host and path and no rule, and is judged by the
models; one without characters is allowed; without URLs of both classes the verdict is allow; ties allow; repeated
rows are judged alike and count again in training; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwave.llm.common import LOWER, UPPER, scratch_table, small_side

#: Fixed rules: verdict and host with path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
ORDER = 4
SMOOTH = 4.0
ALPHABET = 128.0
MAX_BROADCAST = 200_000


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule and its verdict (null where none fits)."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rest = F.expr("CASE WHEN locate('://', url) > 0 THEN substring(url, locate('://', url) + 3) ELSE '' END")
    rows = rows.select("page_id", "url", F.coalesce(rest, F.lit("")).alias("rest"))
    rows = rows.select("page_id", "url", F.translate(F.regexp_extract("rest", "^[^/?#]*", 0), UPPER, LOWER).alias("host"), F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"))
    ruled, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest is tried last and so wins
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        ruled, verdict = F.when(fits, rule).otherwise(ruled), F.when(fits, what).otherwise(verdict)
    return rows.select("page_id", "url", "host", "path", ruled.alias("rule"), verdict.alias("ruled"))


def characters(rows: DataFrame) -> DataFrame:
    """A row for each character of the URL: at (from 1) and u, the URL behind ORDER start marks."""
    u = F.concat(F.lit("\x02" * ORDER), F.coalesce("url", F.lit("")))
    marked = rows.withColumn("u", u)
    return marked.withColumn("at", F.explode_outer(F.when(F.char_length("u") > ORDER, F.sequence(F.lit(1), F.char_length("u") - ORDER))))


def gram(order: int):
    """The `order` characters that end with the one at `at`."""
    return F.expr(f"substring(u, at + {ORDER + 1 - order}, {order})")


def fit(labelled: DataFrame, min_count: int = 3) -> DataFrame:
    """o (characters of the gram), g (the gram) and llr, log p(char | context) under accepted minus rejected."""
    rows = characters(labelled.select("url", F.when(F.col("ruled") == "allow", 1).otherwise(0).alias("ok"))).filter("at is not null")
    parts = [F.struct(F.lit(o).alias("o"), gram(o).alias("g")) for o in range(1, ORDER + 2)]
    counts = rows.select("ok", F.explode(F.array(*parts)).alias("p")).groupBy("p.o", "p.g").agg(F.sum("ok").alias("na"), F.sum(1 - F.col("ok")).alias("nb"))
    grams = scratch_table(counts, "url-grams").withColumns({"c": F.expr("substring(g, 1, o - 1)"), "s": F.expr("substring(g, 2, o - 1)")})
    contexts = grams.groupBy("o", "c").agg(F.sum("na").alias("ca"), F.sum("nb").alias("cn"))
    grams = grams.join(contexts, ["o", "c"])
    smooth = lambda n, total, p: (F.col(n) + SMOOTH * p) / (F.col(total) + SMOOTH)
    level, levels = None, []
    for o in range(1, ORDER + 2):
        own = grams.filter(F.col("o") == o)
        if level is None:
            pa, pn = F.lit(1 / ALPHABET), F.lit(1 / ALPHABET)
        else:
            own = own.join(level.select(F.col("g").alias("s"), F.col("pa").alias("qa"), F.col("pn").alias("qn")), "s", "left")
            pa, pn = F.coalesce("qa", F.lit(1 / ALPHABET)), F.coalesce("qn", F.lit(1 / ALPHABET))
        level = scratch_table(own.select("o", "g", (F.col("na") + F.col("nb")).alias("n"), smooth("na", "ca", pa).alias("pa"), smooth("nb", "cn", pn).alias("pn")), f"url-model-{o}")
        levels.append(level.filter((F.col("n") >= min_count) | (F.col("o") == 1)).select("o", "g", (F.log("pa") - F.log("pn")).alias("llr")))
    return scratch_table(reduce(DataFrame.unionByName, levels), "url-model")


def score(rows: DataFrame, model: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """page_id, url, ... of each row with its score; rows of one page_id and URL are scored alike."""
    found = characters(rows.select("url").filter("url is not null")).filter("at is not null").select("url", gram(ORDER + 1).alias("g"))
    values = found.groupBy("g").agg(F.count(F.lit(1)).alias("k"))
    sizes = {r["o"]: r["count"] for r in model.groupBy("o").count().collect()}
    for o in range(1, ORDER + 2):
        own = model.filter(F.col("o") == o).select(F.col("g").alias(f"g{o}"), F.col("llr").alias(f"llr{o}"))
        values = values.withColumn(f"g{o}", F.substring("g", ORDER + 2 - o, o)).join(small_side(own, sizes.get(o, 0), max_broadcast), f"g{o}", "left")
    values = scratch_table(values.select("g", "k", F.coalesce(*[F.col(f"llr{o}") for o in range(ORDER + 1, 0, -1)], F.lit(0.0)).alias("llr")), "url-gram-values")
    grams, total = values.agg(F.count(F.lit(1)), F.sum("k")).first()
    if grams <= max_broadcast:
        scored = found.join(F.broadcast(values.drop("k")), "g")
    else:
        common = F.col("k") * F.lit(max_broadcast) >= F.lit(total)
        often, seldom = F.broadcast(values.filter(common).drop("k")), values.filter(~common).drop("k")
        scored = found.join(often, "g").unionByName(found.join(often, "g", "left_anti").join(seldom, "g"))
    # Decimal sums don't depend on the order of the rows.
    per_url = scored.groupBy("url").agg((F.sum(F.col("llr").cast("decimal(20,10)")).cast("double") / F.count(F.lit(1))).alias("score"))
    return rows.join(per_url, "url", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def calibrates() -> F.Column:
    """Whether a labelled URL is held out for the cut; a function of the URL, so that its copies go together."""
    return F.pmod(F.xxhash64(F.lit("cut"), "url"), F.lit(5)) == 0


def judge(pages: DataFrame, rules=RULES, min_count: int = 3) -> DataFrame:
    """page_id, host, path, rule, verdict, score, cut and held_out (labelled, but not learned from) of each row of `pages`."""
    rows = with_rule(pages, rules).withColumn("held_out", F.col("ruled").isNotNull() & F.coalesce(calibrates(), F.lit(False)))
    scored = scratch_table(score(rows, fit(rows.filter("ruled is not null and not held_out"), min_count)), "url-scores")
    is_a, is_b = (F.col("held_out") & (F.col("ruled") == x) for x in ("allow", "block"))
    s = lambda f, c: F.coalesce(f(F.when(c, F.col("score"))), F.lit(0.0))
    n = lambda c: F.count(F.when(c, 1))
    # Both classes err equally at the cut: (cut - mean_b) / sd_b = (mean_a - cut) / sd_a.
    learned = [n(~F.col("held_out") & (F.col("ruled") == x)) > 0 for x in ("allow", "block")]
    stats = scored.agg((learned[0] & learned[1]).alias("both"), n(is_a).alias("n_a"), n(is_b).alias("n_b"), s(F.mean, is_a).alias("ma"), s(F.mean, is_b).alias("mb"), (s(F.stddev_pop, is_a) + 1e-6).alias("sa"), (s(F.stddev_pop, is_b) + 1e-6).alias("sb"))
    even = F.when((F.col("n_a") > 0) & (F.col("n_b") > 0), F.expr("round((ma * sb + mb * sa) / (sa + sb), 9)")).otherwise(F.lit(0.0))
    cut = stats.select(F.when(F.col("both"), even).alias("cut"))
    verdict = F.coalesce("ruled", F.when(F.coalesce((F.col("score") < F.col("cut")) & (F.col("url") != ""), F.lit(False)), "block").otherwise("allow"))
    return scored.join(F.broadcast(cut)).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", "cut", "held_out")


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")
