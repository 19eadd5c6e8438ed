"""Rule cascade, verdict bands, verdict merge, review categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwave.functions import text as T


def rule_check(message: Column, size: Column, min_bytes: int = 9, lookalike: float = 0.55) -> Column:
    """is_spam (null: undecided), pattern, code, excluded, decoded and decoded_urls of the ordered rules. `size`: bytes of the visible text.

    Which rule fits is found once a row; the fields are read off its number."""
    short = (F.coalesce(message, F.lit("")) == "") | (size < min_bytes)
    rule = F.when(short, 0).when(T.has_unicode_obfuscation(message), 1).when(T.spaced_hangul(message).isNotNull(), 2).when(T.lookalike_share(message) >= lookalike, 3)
    none = F.lit(None).cast("string")
    fields = lambda r: F.struct(
        F.when(r == 0, False).when(r == 3, True).alias("is_spam"),
        F.when(r == 0, "short_message").when(r == 1, "unicode_obfuscation").when(r == 2, T.spaced_hangul(message)).when(r == 3, "alphanumeric_obfuscation").alias("pattern"),
        F.when(r == 0, "SKIP").when(r == 3, "0").alias("code"),
        F.coalesce(r == 0, F.lit(False)).alias("excluded"),
        F.when(r == 1, T.deobfuscate(message)).otherwise(none).alias("decoded"),
        F.when(r == 1, T.obfuscated_urls(message)).alias("decoded_urls"),
    )
    return F.get(F.transform(F.array(rule), fields), F.lit(0))


#: Codes of spam, which ham can't have.
SPAM_CODES = ("0", "1", "2", "3", "10")


def band(label: Column, p: Column, code: Column, reason: Column | None = None) -> Column:
    """verdict (SPAM, HITL, HAM or HOLD_SHORT), is_spam, code and reason of a model's label and probability.

    Spam counts from 0.6, is undecided (code 30) from 0.4, and ham below; held short messages stay held."""
    spam, label = F.upper(label) == "SPAM", F.upper(label)
    reason = F.coalesce(reason, F.lit("")) if reason is not None else F.lit("")
    verdict = F.when(spam & (p >= 0.6), "SPAM").when(spam & (p >= 0.4), "HITL").when(label == "HOLD_SHORT", "HOLD_SHORT").otherwise("HAM")
    ham_code = F.when(~F.coalesce(code.isin(*SPAM_CODES), F.lit(False)), code)
    shown = F.format_string("%.2f", p)
    tagged = F.when((verdict == "HITL") & ~reason.startswith("[HITL]"), F.concat(F.lit("[HITL] Probability ("), shown, F.lit(") is ambiguous. Requesting user feedback. | "), reason))
    tagged = tagged.when(spam & (verdict == "HAM"), F.concat(F.lit("[Override] LLM output SPAM but probability is too low ("), shown, F.lit("). Forced HAM. | "), reason)).otherwise(reason)
    return F.struct(
        verdict.alias("verdict"),
        F.when(verdict == "SPAM", True).when(verdict == "HAM", False).alias("is_spam"),
        F.when(verdict == "HITL", "30").when(verdict == "HAM", ham_code).otherwise(code).alias("code"),
        tagged.alias("reason"),
    )


def finalize_hold(is_spam: Column, code: Column, p: Column) -> Column:
    """Undecided rows of code 30 become spam (code 2) from 0.9, else ham."""
    held = is_spam.isNull() & (code == "30")
    return F.struct(F.when(held, p >= 0.9).otherwise(is_spam).alias("is_spam"), F.when(held & (p >= 0.9), "2").otherwise(code).alias("code"))


def merge_url(df: DataFrame) -> DataFrame:
    """Content and URL verdicts into one, in order. Reads content_spam, content_p, content_code, url_spam, url_p,
    url_code, url_inconclusive, transactional, mismatched, decoy, safe_domain, has_input_url; adds final_spam,
    final_p, final_code, red_group, drop_reason. Null counts as false."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    content, url, given = yes("content_spam"), yes("url_spam"), yes("has_input_url")
    settled = ~yes("url_inconclusive") & F.col("url_spam").isNotNull()
    flip_in = settled & given & ~content & url
    red = flip_in & ~yes("transactional")
    clean = settled & ~url & content
    to_ham = clean & yes("transactional") & ~yes("mismatched")
    decoy = clean & ~to_ham & yes("decoy") & yes("safe_domain")
    spam = F.when(flip_in, ~yes("transactional")).when(settled & url, True).when(to_ham, False).otherwise(content)
    p = F.when(settled & url & ~(flip_in & yes("transactional")), F.greatest(F.coalesce("content_p", F.lit(0.0)), F.coalesce("url_p", F.lit(0.95)))).otherwise(F.col("content_p"))
    code = F.when(settled & url & (F.coalesce("url_code", F.lit("0")) != "0"), F.col("url_code")).otherwise(F.col("content_code"))
    reason = F.when(decoy, "safe_injection")
    return df.withColumns({"final_spam": spam, "final_p": p, "final_code": F.when(spam, code), "red_group": red, "drop_reason": reason})


def review_category(df: DataFrame) -> Column:
    """Ordered: ham override, decoy, spam override, then by code."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    spam, url, content = yes("final_spam"), yes("url_spam"), yes("content_spam")
    code = F.coalesce(T.code_digits(F.col("final_code")), F.lit(""))
    names = F.when(code == "1", "CODE_1").when(code == "2", "CODE_2").when(code == "3", "CODE_3").when(code == "0", "CODE_0")
    return F.when(~spam & content, "HAM_OVERRIDE").when(spam & (F.col("drop_reason") == "safe_injection"), "DECOY").when(spam & ~content & url & ~yes("red_group"), "SPAM_OVERRIDE").when(spam, names)


def policy_class(df: DataFrame) -> Column:
    """Documented ladder: confirmed safe pages are ham; spam with a soft signal, or by its URL alone on a clean text, is Type_B; other spam Type_A; the rest ham."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    soft = F.exists(F.array(*map(yes, ("impersonation", "vague_cta", "lure", "garbage"))), lambda x: x)
    return F.when(yes("confirmed_safe"), "Ham").when(yes("final_spam") & (soft | (yes("url_spam") & ~yes("content_spam"))), "Type_B").when(yes("final_spam"), "Type_A").otherwise("Ham")
