"""Columns of reports: reasons, codes, labels, signals, model payloads, spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwave.functions.text import nfkc, strip_space

#: Prefixes that carriers and senders put before messages, markers in reasons, code descriptions.
PREFIXES = "web발신|웹발신|국제발신|로밍발신|광고|fw|fwd"
SEPARATED = "[텍스트 HAM + 악성 URL 분리 감지"
MANUAL_RED = "[수동 Red Group 지정]"
CODES = {
    "0": "일반 (인터넷, 통신, 대리운전 등)",
    "1": "성인 (유흥업소, 성인용품/약품/컨텐츠 등)",
    "2": "도박 (도박, 주식, 가상자산, 스미싱 및 기타 모든 스팸)",
    "3": "금융 (대출)",
    "30": "판단 보류 (HITL)",
    "HAM-1": "응답/알림/명세서",
    "HAM-2": "명확한 사업자 광고",
    "HAM-3": "생활 밀착형 정보/기타",
    "HAM-4": "간단 알림",
}
ANCHORS = ("harm_anchor", "route_or_cta")


def message_key(c: Column) -> Column:
    """Comparison key: normal form, without leading carrier and advertising marks, letters and digits only."""
    bare = strip_space(F.regexp_replace(nfkc(F.coalesce(c, F.lit(""))), rf"(?iU)^(?:\W*(?:{PREFIXES})\W*)+", ""))
    words = F.regexp_replace(bare, r"(?U)[^\w]", "")
    return F.when(words == "", bare).otherwise(words)


def filled(c: Column) -> Column:
    """Null for empty texts and the word null."""
    return F.when((c != "") & (F.lower(c) != "null"), c)


def pick_code(code: Column, spam_code: Column, ham_code: Column) -> Column:
    """The first code that says something."""
    return F.coalesce(F.nullif(code, F.lit("")), filled(spam_code), filled(ham_code), F.lit(""))


def pick_reason(reason: Column, reasons: Column, provider: Column) -> Column:
    """A reason, else the joined list of them, else who analysed."""
    return F.coalesce(F.nullif(reason, F.lit("")), F.nullif(F.array_join(reasons, " | "), F.lit("")), F.concat(provider, F.lit(" Analysis")))


def with_fallback(reason: Column, model: Column) -> Column:
    """Marks reasons that a stand-in model gave."""
    return F.when((model != "") & (reason != ""), F.concat(F.lit("[Content_Fallback: "), model, F.lit("] "), reason)).otherwise(reason)


def reason_parts(reason: Column) -> Column:
    """A struct of the reason without markers, the reviewer's note (null without one) and whether it was set by hand."""
    note = F.regexp_extract(reason, r"\[Reviewer Note: (.*?)\]", 1)
    clean = reason
    for marker in (r"\[Reviewer Note: .*?\]", r"\[Manually Marked as .*?\]", r"\(Prob: .*?\)"):
        clean = F.regexp_replace(clean, marker, "")
    has_note = reason.rlike(r"\[Reviewer Note: .*?\]")
    return F.struct(F.trim(F.coalesce(clean, F.lit(""))).alias("clean"), F.when(has_note, note).alias("note"), F.coalesce(reason.contains("[Manually Marked"), F.lit(False)).alias("manual"))


def reason_steps(reason: Column, dropped: Column) -> Column:
    """The bracketed steps of a composed reason, and a line for a dropped URL; a single default line without any."""
    parts = F.filter(F.transform(F.split(F.coalesce(reason, F.lit("")), r"\|"), lambda p: F.trim(p)), lambda p: p.startswith("["))
    steps = F.concat(parts, F.when(dropped, F.array(F.lit("[URL dropped]"))).otherwise(F.array().cast("array<string>")))
    return F.when(F.size(steps) > 0, steps).otherwise(F.array(F.lit("content verdict kept")))


def backfilled_red(red: Column, reason: Column) -> Column:
    """Old rows get their red group from the reason, unless it was set by hand."""
    marked = F.contains(reason, F.lit(SEPARATED)) & ~F.contains(reason, F.lit(MANUAL_RED))
    return F.coalesce(red, F.lit(False)) | F.coalesce(marked, F.lit(False))


def active_signals(signals: Column) -> Column:
    """Names of the true signals, sorted, without the two that every message has."""
    return F.array_sort(F.map_keys(F.map_filter(signals, lambda k, v: F.coalesce(v, F.lit(False)) & ~k.isin(*ANCHORS))))


def ab_class(signals: Column) -> Column:
    return F.when(F.size(active_signals(signals)) > 0, "Type_B").otherwise("Type_A")


def code_description(code: Column, other: str = "기타") -> Column:
    table = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    digits = F.nullif(F.regexp_extract(code, r"[0-9]+", 0), F.lit(""))
    return F.coalesce(F.try_element_at(table, code), F.try_element_at(table, digits), F.lit(other))


def diff_label(is_spam: Column, reason: Column) -> Column:
    """missing, spam, ham; empty for spam by URL alone."""
    red = is_spam & F.coalesce(reason.rlike("악성 URL 탐지|텍스트 HAM"), F.lit(False))
    return F.when(is_spam.isNull(), "누락").when(red, "").when(is_spam, "SPAM").otherwise("HAM")


def status_label(status: Column) -> Column:
    return F.when(status == "FP", "FP (오탐)").when(status == "FN", "FN (미탐)").otherwise(status)


def day_verdict(kappa: Column, fn_rate: Column) -> Column:
    """Documented state of a day by agreement and misses."""
    return F.when((kappa >= 0.75) & (fn_rate <= 0.03), "stable").when((kappa >= 0.65) & (fn_rate <= 0.05), "watch").otherwise("improve")


def narrative(accuracy: Column, kappa: Column, fn: Column, fp: Column) -> Column:
    return F.format_string("agreement %.1f%%, kappa %.3f, %d missed and %d false alarms", accuracy * 100, kappa, fn, fp)


def date_label(tag: Column) -> Column:
    """Month, day and weekday of a name's date; the tag itself where it has none."""
    day = F.try_to_date(F.regexp_extract(tag, "[0-9]{8}", 0), "yyyyMMdd")
    names = F.array(*[F.lit(d) for d in "일월화수목금토"])
    return F.coalesce(F.concat(F.date_format(day, "M/d"), F.lit("("), F.get(names, F.dayofweek(day) - 1), F.lit(")")), tag)


def content_text(content: Column) -> Column:
    """Text of a model's answer: a string, a list of strings, or a list of objects with text."""
    parts = F.from_json(content, "array<string>")
    text = F.array_join(F.transform(parts, lambda p: F.coalesce(F.when(p.startswith("{"), F.get_json_object(p, "$.text")), p)), "")
    return F.when(F.trim(content).startswith("["), F.coalesce(text, content)).otherwise(content)


def payload(answer: Column) -> Column:
    """The JSON object of an answer: fenced as json, fenced, or between the outer braces; null if none parses."""
    tiers = [r"(?s)```json\s*(\{.*?\})\s*```", r"(?s)```[a-zA-Z]*\s*(\{.*?\})\s*```", r"(?s)(\{.*\})"]
    found = [F.nullif(F.regexp_extract(answer, p, 1), F.lit("")) for p in tiers]
    return F.coalesce(*[F.when(F.try_parse_json(f).isNotNull(), f) for f in found])


def clean_summary(c: Column) -> Column:
    """An intent summary without bold labels, its header line and a first line that is only a label."""
    out = F.regexp_replace(c, r"\*\*.*?\*\*[ \t]*\n?", "")
    out = F.regexp_replace(F.btrim(out, F.lit(" \t\r\n")), r"(?i)^principal intent\s*/\s*tactics\s*/\s*action request\s*\n?", "")
    return F.btrim(F.regexp_replace(F.btrim(out, F.lit(" \t\r\n")), r"^[^/\n]*\n", ""), F.lit(" \t\r\n"))


def signature_span(message: Column, signature: Column) -> Column:
    """start (from 1) and text of a signature in a message, white space and case aside; null where it isn't there."""
    letters = F.filter(F.split(strip_space(signature), ""), lambda x: x != "")
    pattern = F.concat(F.lit("(?i)"), F.array_join(F.transform(letters, lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E"))), r"\s*"))
    pattern = F.when(F.size(letters) > 0, pattern)
    return F.when(F.regexp_instr(message, pattern) > 0, F.struct(F.regexp_instr(message, pattern).alias("start"), F.regexp_substr(message, pattern).alias("text")))
