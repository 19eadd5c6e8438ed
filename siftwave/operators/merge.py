"""What surrounds the merge of verdicts: routing, URL evidence, dropped URLs, final labels, the single-message rules.

Each step adds columns to a wide row, so steps may be used alone. Null flags count as false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwave.functions import urls as U

#: Phrases of answers about limits, of undecided URL checks, of decoy links, and of real harm.
LIMITS = "quota|exhausted|429"
INCONCLUSIVE = "error|inconclusive|insufficient|image only|no url found|no url extracted|no url to scrape"
DECOY = "위장 url|정상 도메인 위장|방패막이|decoy|safe url injection|미끼 링크|필터 회피"
HARM = "gambling|adult|phishing|malicious|fraud|scam|illegal|유해|도박|성인|피싱|사기"


def yes(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def says(c: str, phrases: str) -> Column:
    return F.coalesce(F.lower(c).rlike(phrases), F.lit(False))


def route(df: DataFrame) -> DataFrame:
    """Reads message, decoded, given_url, model_urls, content_reason, content_spam; adds halted, need_url, need_sig."""
    halted = says("content_reason", LIMITS)
    found = U.has_url(F.col("message")) | U.has_url(F.col("decoded")) | (F.coalesce("given_url", F.lit("")) != "") | (F.coalesce(F.size("model_urls"), F.lit(0)) > 0)
    return df.withColumns({"halted": halted, "need_url": ~halted & found, "need_sig": ~halted & yes("content_spam")})


def needs_late_signature(df: DataFrame) -> Column:
    """The URL alone made it spam and no usable URL was given, so a signature is asked for afterwards."""
    return ~yes("content_spam") & yes("url_spam") & ~yes("has_input_url")


def inconclusive(df: DataFrame) -> Column:
    return says("url_reason", INCONCLUSIVE)


def url_evidence(df: DataFrame) -> DataFrame:
    """Which URLs of a verdict stand in the message. Reads message, decoded, given_url, extracted (comma list), model_urls.

    Adds valid_urls (the model's always, others if they stand in the texts), rejected_urls, and drop_reason: fake_ip
    or hidden_url where no URL is left. Once a page was visited, ends of other URLs are no URLs; a given one that is
    such an end is dropped as fragment_artifact."""
    listed, model = U.split_list(F.col("extracted")), F.coalesce("model_urls", F.array().cast("array<string>"))
    stands = lambda u: U.in_message(u, F.col("message"), F.col("decoded"), F.col("given_url"))
    steps = df.withColumns({"_listed": F.filter(listed, lambda u: F.lower(u) != "none"), "_model": model})
    valid = F.array_distinct(F.concat(F.filter("_listed", lambda u: F.array_contains(F.col("_model"), u) | stands(u)), "_model"))
    steps = steps.withColumn("valid_urls", valid).withColumn("rejected_urls", F.array_distinct(F.concat("_listed", "_model")))
    none = F.size("valid_urls") == 0
    reason = F.when(none & F.exists("_listed", U.is_ip), "fake_ip").when(none & (F.size("rejected_urls") > 0), "hidden_url")
    visited = ~F.coalesce(F.lower(F.trim("extracted")), F.lit("")).isin("", "none")
    whole = F.when(visited, U.drop_fragments(F.col("valid_urls"))).otherwise(F.col("valid_urls"))
    bare = lambda u: F.regexp_replace(u, "^(?:https?://)?[w.]*|/+$", "")
    cut_off = F.exists(F.array_except("valid_urls", "_whole"), lambda u: bare(u) == bare(F.coalesce("given_url", F.lit(""))))
    reason = F.when(cut_off, "fragment_artifact").otherwise(reason)
    steps = steps.withColumn("_whole", whole).withColumn("drop_reason", reason).withColumn("valid_urls", F.col("_whole")).drop("_whole")
    return steps.withColumns({"rejected_urls": F.when(none, F.col("rejected_urls")).otherwise(F.array().cast("array<string>"))}).drop("_listed", "_model")


def kept_urls(df: DataFrame) -> Column:
    """URLs of a verdict without addresses and unconfirmed bare domains (unless they are the given host)."""
    sure = yes("url_spam") | yes("confirmed_safe")
    own = U.host(F.coalesce("given_url", F.lit("")))
    return F.filter(U.without_ips(U.split_list(F.col("extracted"))), lambda u: ~(U.is_bare(u) & ~sure & (U.host(u) != own)))


def drop_urls(df: DataFrame) -> DataFrame:
    """Which rows lose their URL, and why. Reads given_url, extracted, url_reason, url_spam, confirmed_safe, broken_short,
    short_dropped, final_spam, red_group, separated, preserve, signature, category and drop_reason (of earlier steps, or null).

    Adds urls, drop_url, drop_url_reason and the signature and category that stay: a URL that will be blocked makes
    a signature needless. The order is address, decoy, other host; then rows without a given URL; then spam whose
    given URLs are all bare or damaged."""
    given, listed = F.col("given_url"), F.col("extracted")
    has_given, has_listed = F.coalesce(given, F.lit("")) != "", F.coalesce(listed, F.lit("")) != ""
    steps = df.withColumn("urls", F.when(yes("broken_short"), U.split_list(listed)).otherwise(kept_urls(df)))
    fake = (has_given & F.coalesce(U.is_ip(given), F.lit(False))) | (has_listed & ~yes("broken_short") & (F.size("urls") == 0))
    decoy = says("url_reason", DECOY) & yes("confirmed_safe")
    plain = lambda u: U.is_bare(u) | U.is_corrupt(u)
    host = lambda u: F.regexp_extract(F.lower(u), r"^(?:https?://)?([^/?#]*)", 1)
    same = F.exists("urls", lambda u: (host(u) == host(given)) | (U.to_unicode_host(host(u)) == host(given)))
    other = has_given & ~yes("short_dropped") & (F.size("urls") > 0) & ~same & plain(given) & (yes("final_spam") | ~U.is_bare(given))
    first = F.when(fake, "empty_or_fake_ip").when(decoy, "safe_injection").when(other, "mismatched_extraction").otherwise(F.col("drop_reason"))
    steps = steps.withColumn("_first", first).withColumn("_cleared", fake | decoy | F.coalesce(other, F.lit(False)))
    rest = has_given & F.col("_first").isNull() & yes("final_spam") & ~yes("red_group") & F.forall(U.split_list(given), plain)
    reason = F.when(~has_given & ~yes("separated"), "empty_pre_parsed_url_sync").when(rest, "bare_or_corrupt_domain_sync").otherwise(F.col("_first"))
    steps = steps.withColumn("drop_url_reason", reason).withColumn("drop_url", F.col("drop_url_reason").isNotNull())
    steps = steps.withColumn("urls", F.when(F.col("_cleared"), F.array().cast("array<string>")).otherwise(F.col("urls")))
    named = F.when(F.upper(F.trim("signature")) != "NONE", F.nullif(F.col("signature"), F.lit("")))
    needless = (F.size("urls") > 0) & ~F.col("drop_url") & ~yes("preserve") & named.isNotNull()
    return steps.withColumns({"signature": F.when(~needless, named), "category": F.when(needless, "unextractable (URL Deduplication Active)").otherwise(F.col("category"))}).drop("_first", "_cleared")


def final_labels(df: DataFrame) -> DataFrame:
    """Adds label and final_code; ham loses its signature and category. Reads final_spam, code, url_code, signature, category."""
    spam = yes("final_spam")
    code = F.when(spam, F.coalesce(F.nullif("code", F.lit("")), F.nullif("url_code", F.lit("")), F.lit("0"))).otherwise(F.col("code"))
    return df.withColumns({"label": F.when(spam, "SPAM").otherwise("HAM"), "final_code": code, "signature": F.when(spam, F.col("signature")), "category": F.when(spam, F.col("category"))})


def merge_single(df: DataFrame) -> DataFrame:
    """The older rules for one message. Reads content_spam, content_p, code, content_reason, url_spam, url_p, url_code,
    url_reason, confirmed_safe, need_url; adds final_spam, final_p, final_code.

    A URL makes ham spam only for real harm, and a confirmed safe one makes spam ham."""
    content = yes("content_spam")
    open_ = yes("need_url") & ~says("content_reason", "quota exhausted|quota exceeded|429") & F.col("url_spam").isNotNull() & ~says("url_reason", "error|inconclusive|insufficient|image only")
    coded = F.coalesce(F.nullif("url_code", F.lit("")), F.lit("0")) != "0"
    up = open_ & yes("url_spam") & (content | says("url_reason", HARM) | coded)
    down = open_ & ~yes("url_spam") & content & yes("confirmed_safe")
    code = F.when(up & coded, F.col("url_code")).when(up & (F.coalesce("code", F.lit("")).startswith("HAM") | (F.coalesce("code", F.lit("")) == "")), "0").when(down, None).otherwise(F.col("code"))
    p = F.when(up, F.greatest("content_p", F.coalesce("url_p", F.lit(0.95)))).otherwise(F.col("content_p"))
    return df.withColumns({"final_spam": (content | up) & ~down, "final_p": p, "final_code": code})
