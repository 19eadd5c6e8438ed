"""URLs of messages: links and bare domains, also spaced-out ones, freed from words glued to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwave.functions import text as T
from siftwave.functions import urls as U

#: Top-level domains that count without a scheme, words that hang on to the end of URLs, and words that count the digits before them.
TOP_LEVEL = ["com", "net", "org", "edu", "gov", "mil", "int", "kr", "io", "ai", "me", "info", "biz", "shop", "site", "top", "xyz", "club", "online", "pro", "id", "vn", "jp", "cn", "us", "uk", "de", "fr", "tv", "cc", "li", "ly", "be", "it", "to", "gg", "ws", "mobi", "asia", "name", "store", "news", "app", "dev", "tech", "so"]
TAIL_WORDS = ["code", "tel", "id", "kakao", "line", "best", "pw", "password", "상담", "문의"]
COUNTERS = ["차", "번", "위", "일", "명", "원", "만", "억", "퍼", "개", "건", "달", "주", "배", "년", "월", "시", "분", "초", "등", "백", "천", "조", "탄", "기", "프로", "종목", "코드", "상담", "수익"]

SPACE, HANGUL = r" \t\r\n\f\x0b", "가-힣ㄱ-ㅣ"
LABEL = f"[A-Za-z0-9{HANGUL}-]"
#: Labels end at 63 characters, as in host names. A name goes on to its last label of two characters or more. Java repeats a group on its stack
#: unless it never gives back, which overflowed in names of some thousand labels, so here it never does.
START, NEXT = rf"{LABEL}{{1,63}}\.(?:{LABEL}\.)*+", rf"{LABEL}{{2,63}}"
DOMAIN = rf"{START}{NEXT}(?:\.(?:{LABEL}\.)*+{NEXT})*+"
#: Where no name starts: other characters, labels too long or without a dot or a last one. They are read over before a name or the end, as trying
#: each place would take a label's length for each of its characters.
NO_NAME = rf"[^{LABEL[1:]}++|{LABEL}+(?={LABEL}{{63}}\.)|{START}(?!{LABEL}{{2}})"
REST = rf"[^{SPACE}\[\]<>\p{{So}}]"
LINK_PATTERN = f"https?://{REST}+"
#: The name is group 1, empty at the end of the text.
BARE_PATTERN = rf"(?:{LABEL}++(?!\.)|{NO_NAME})*+(?:({DOMAIN}(?:/{REST}*)?)|\z)"
SCHEME_LAST = rf"{LABEL}+(?=https?://)|https?://(?!{START}{LABEL}{{2}})"
SPACED_PATTERN = rf"(?:{LABEL}++(?!\.)(?!(?<=https?)://)|{SCHEME_LAST}|{NO_NAME})*+(?:((?:https?://)?{DOMAIN}(?:/[A-Za-z0-9{HANGUL}/?=&%_.-]*)?)|\z)"
TAIL_PATTERN = rf"(?i)(?:{'|'.join(TAIL_WORDS)})[.,;:!?)\]}}\"'{SPACE}]*$"
#: Pattern and group to keep: Hangul after the top-level domain, Hangul labels in front, a Hangul start of a
#: two-label host. The first goes on to the last such domain.
GLUED_TOP = f"[A-Za-z]{{2,7}}[{HANGUL}]"
GLUED = [
    rf"^((?:https?://)?(?:(?:[^/.]++\.(?!{GLUED_TOP}))*+[^/.]++\.(?={GLUED_TOP}))++[A-Za-z]{{2,7}})[{HANGUL}][^/]*",
    rf"^(?:[^./]*[{HANGUL}][^./]*\.)++([A-Za-z0-9-]+\.[A-Za-z].*)$",
    rf"^[{HANGUL}]+([A-Za-z0-9-]+\.[A-Za-z]{{2,7}}(?:/.*)?)$",
]
#: What is cut from a path: Hangul right behind a letter or digit, with digits before it that it counts.
GLUED_PATH = rf"(?s)[0-9]+(?:{'|'.join(COUNTERS)}).*$|(?<=[A-Za-z0-9])[{HANGUL}].*$"
ACCEPT_PATTERN = rf"^(?:https?://)?(?:[^/]*\.)?[^/.]*[^/.0-9][^/.]*\.(?:(?i:{'|'.join(TOP_LEVEL)})|xn--[A-Za-z0-9-]+)(?:/.*)?$"


def cleaned(u: Column) -> Column:
    return U.rstrip(F.regexp_replace(u, TAIL_PATTERN, ""))


def unglued(u: Column) -> Column:
    for pattern in GLUED:
        u = F.regexp_replace(u, pattern, "$1")
    head = F.regexp_extract(u, "^(?:https?://)?[^/]*", 0)
    path = F.substring(u, F.char_length(head) + 1, F.char_length(u))
    return F.when(F.octet_length(u) == F.char_length(u), u).otherwise(F.concat(head, F.regexp_replace(path, GLUED_PATH, "")))


def without_scheme(u: Column) -> Column:
    return F.regexp_replace(u, "^https?://", "")


def with_scheme(u: Column) -> Column:
    return F.when(u.rlike("^https?://"), u).otherwise(F.concat(F.lit("http://"), u))


def has_potential_url(c: Column) -> Column:
    """Something like a URL in a text or in its compatible normal form; null has none."""
    return U.has_url(c) | U.has_url(T.nfkc(c))


def extract_urls(df: DataFrame, text: str, given: str | None = None, models: str | None = None, cap: int = 3, least: int = 10, ranked: bool = True) -> DataFrame:
    """Adds `urls`: at most `cap` different URLs, ordinary domains before user content and shorteners; all in the order found if not `ranked`.

    First come those of `models` (an array that a model proposed; in reverse where one is given) and the `given` one.
    Texts are read as they are and in their compatible normal form. Links count as they are; domains without a scheme
    need a known top-level domain and a name that isn't a number. Spaced-out URLs count where nothing read before lies
    within them. Shortened URLs lose decoration behind them if `ranked`, hosts become Punycode. Null texts give no URLs."""
    body, every = F.coalesce(F.col(text), F.lit("")), lambda c, p: F.regexp_extract_all(c, F.lit(p), F.lit(0))
    names = lambda c, p: F.filter(F.regexp_extract_all(c, F.lit(p), F.lit(1)), lambda u: u != "")
    decoded = F.col("_decoded")
    more = lambda read, p: F.when(decoded != body, F.concat(read(body, p), read(decoded, p))).otherwise(read(body, p))
    none = F.array().cast("array<string>")
    first = F.when(F.coalesce(F.col(given), F.lit("")) != "", F.array(with_scheme(F.col(given)))).otherwise(none) if given else none
    if models:
        proposed = F.transform(F.filter(F.coalesce(F.col(models), none), lambda u: F.char_length(u) > 3), lambda u: with_scheme(F.trim(u)))
        first = F.concat(F.when(F.size(first) > 0, F.reverse(proposed)).otherwise(proposed), first)
    steps = df.withColumn("_decoded", T.deobfuscate(T.nfkc(body)))
    steps = steps.withColumns({"_raw": more(every, LINK_PATTERN), "_names": more(names, BARE_PATTERN), "_spaced": names(T.strip_ascii_space(body), SPACED_PATTERN)})
    known = F.transform(F.concat(first, "_raw", "_names"), without_scheme)
    tidy = lambda c: F.transform(c, lambda u: unglued(cleaned(u)))
    links = F.concat(first, F.filter(tidy(F.col("_raw")), lambda u: F.char_length(u) > 7))
    new = F.filter("_spaced", lambda u: ~F.exists("_known", lambda k: F.contains(u, k)))
    steps = steps.withColumn("_known", known).withColumns({"_links": links, "_bare": F.filter(tidy(F.col("_names")), lambda u: u.rlike(ACCEPT_PATTERN)), "_late": F.filter(tidy(new), lambda u: u.rlike(ACCEPT_PATTERN))})
    alone = F.filter("_bare", lambda u: ~F.exists("_links", lambda k: F.contains(k, u)))
    steps = steps.withColumn("_found", F.concat("_links", F.transform(alone, with_scheme)))
    every_one = F.concat("_found", F.transform("_late", with_scheme))
    whole = F.filter(F.transform(every_one, U.without_tail) if ranked else every_one, lambda u: u.isNotNull() & (F.char_length(u) >= least))
    steps = steps.withColumn("_all", F.array_distinct(F.transform(whole, U.to_ascii)))
    return steps.withColumn("urls", U.order_and_cap(F.col("_all"), cap) if ranked else F.slice("_all", 1, cap)).drop("_decoded", "_raw", "_names", "_spaced", "_known", "_links", "_bare", "_late", "_found", "_all")
