"""URL columns: hosts, domain paths, tests and list clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Domains anyone can write on, deep links of apps, trusted domains, portals that are safe at the merge, shorteners.
USER_CONTENT = ["open.kakao.com", "pf.kakao.com", "ch.kakao.com", "blog.naver.com", "cafe.naver.com", "blog.daum.net", "cafe.daum.net", "t.me", "telegram.me", "line.me", "bit.ly", "tinyurl.com"]
DEEP_LINKS = ["onelink.me", "adjust.com", "app.link", "abr.ge", "samsungapps.com"]
TRUSTED = ["play.google.com", "apps.apple.com", "onestore.co.kr", "galaxy.store", "go.kr", "or.kr"]
PORTALS = ["naver.com", "daum.net", "kakao.com", "samsung.com"]
SHORTENERS = [
    "a.to", "abit.ly", "adf.ly", "adfoc.us", "agshort.link", "aka.ms", "amzn.to", "apple.co", "asq.kr",
    "bit.do", "bit.ly", "bitly.com", "bitly.cx", "bitly.kr", "bl.ink", "blow.pw", "buff.ly", "buly.kr",
    "c11.kr", "clic.ke", "cogi.cc", "coupa.ng", "cutt.it", "cutt.ly",
    "di.do", "dokdo.in", "dub.co",
    "fb.me",
    "gmarket.it", "goo.gl", "goo.su", "gooal.kr",
    "han.gl", "horturl.at",
    "ii.ad", "iii.ad", "instagr.am", "is.gd",
    "j.mp",
    "kakaolink.com", "kko.to", "ko.fm", "ko.gl", "koe.kr",
    "link24.kr", "linktr.ee", "lrl.kr",
    "mcaf.ee", "me2.do", "muz.so", "myip.kr",
    "naver.me",
    "ouo.io", "ow.ly",
    "qrco.de",
    "rb.gy", "rebrand.ly", "reurl.kr", "rul.kr",
    "sbz.kr", "short.io", "shorter.me", "shorturl.at", "shrl.me", "shrtco.de",
    "t.co", "t.ly", "t.me", "t2m.kr", "tiny.cc", "tinyurl.com", "tne.kr", "tny.im", "tr.ee", "tuney.kr",
    "url.kr", "uto.kr",
    "v.gd", "vdo.kr", "vo.la", "vvd.bz", "vvd.im",
    "wp.me",
    "youtu.be", "yun.kr",
    "zrr.kr",
    "tnia.cc", "2.lnkme.net", "lnkme.net", "alie.kr", "bz.kr", "booly.kr", "qaa.kr",
    "m.site.naver.com", "g.co",
]


def host(u: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(F.lower(F.trim(u)), r"^(?:https?://)?([^/?#:]*)", 1), r"^www\.", "")


def domain_path(u: Column) -> Column:
    """Host and path without a last slash, port and query; empty for null and Unknown."""
    path = F.regexp_replace(F.regexp_extract(F.trim(u), r"^(?:[hH][tT][tT][pP][sS]?://)?[^/?#]*([^?#]*)", 1), "/+$", "")
    return F.when(u.isNull() | (u == "Unknown"), "").otherwise(F.concat(host(u), path))


def has_suffix(h: Column, domains: list[str]) -> Column:
    """The host is one of the domains or below one."""
    return F.exists(F.array(*map(F.lit, domains)), lambda d: (h == d) | h.endswith(F.concat(F.lit("."), d)))


def is_trusted(u: Column) -> Column:
    return has_suffix(host(u), TRUSTED) & ~has_suffix(host(u), USER_CONTENT)


def is_deep_link(u: Column) -> Column:
    return F.coalesce(has_suffix(host(u), DEEP_LINKS), F.lit(False))


def safe_at_merge(u: Column) -> Column:
    """A trusted domain, or a host that ends like a portal, unless anyone can write on it; null is not safe."""
    portal = F.exists(F.array(*map(F.lit, PORTALS)), lambda d: host(u).endswith(d))
    return F.coalesce((has_suffix(host(u), TRUSTED) | portal) & ~has_suffix(host(u), USER_CONTENT), F.lit(False))


def is_ip(u: Column) -> Column:
    return host(u).rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")


def is_bare(u: Column) -> Column:
    return u.rlike(r"^(https?://)?[^/?#]+/?$")


def is_corrupt(u: Column) -> Column:
    return F.regexp_extract(u, r"^(?:https?://)?[^/?#]*(.*)$", 1).rlike(r"[\[\]*(){}<>]")


def rstrip(u: Column) -> Column:
    return F.regexp_replace(u, r"[.,;:!?)\]}\"']+$", "")


def urls_in(text: Column) -> Column:
    """URLs with a scheme, cleaned at the end, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"https?://[^ \t\r\n<>\"']+"), F.lit(0)), rstrip))


def plain_urls(text: Column) -> Column:
    """URLs with a scheme of a text, without shortened ones; null gives none."""
    return F.filter(urls_in(F.coalesce(text, F.lit(""))), lambda u: ~is_short(u))


def order_and_cap(urls: Column, cap: int = 3) -> Column:
    """Ordinary domains first, then user content and shorteners; at most `cap` a message."""
    low = lambda u: has_suffix(host(u), [*USER_CONTENT, *SHORTENERS])
    return F.slice(F.concat(F.filter(urls, lambda u: ~low(u)), F.filter(urls, low)), 1, cap)


def drop_fragments(urls: Column) -> Column:
    """Without URLs that are the end of another one, unless a dot comes before."""
    cut = lambda u: F.regexp_replace(F.regexp_replace(u, "^https?://", ""), "^[w.]+", "")
    inside = lambda a, b: (cut(a) != cut(b)) & cut(b).endswith(cut(a)) & (F.substring(F.reverse(cut(b)), F.char_length(cut(a)) + 1, 1) != ".")
    return F.filter(urls, lambda a: ~F.exists(urls, lambda b: inside(a, b)))


#: A URL or domain inside a message, marks that cling to cut-off URLs, hosts with subscriber counts.
URL_TOKEN = r"(?:https?://|www\.)[^ \t\r\n\f\x0b]+|[a-zA-Z0-9가-힣ㄱ-ㅣ-]+\.[a-zA-Z가-힣]{2,}"
DECORATION = r"[\[\]()<>◆▶★♥※○●◎◇□■△▲▽▼▷◁◀♤♠♡♣⊙◈▣☎☏].*$"
SOCIAL = ["kakao.com", "band.us", "cafe.naver.com", "t.me", "telegram.me", "instagram.com", "facebook.com"]
SUBSCRIBERS = r"(?:친구|친구\s*수|채널\s*추가|가입자|구독자|팔로워|회원|회원\s*수|멤버|팬)\s*([0-9,.]+)(만명|만|명|\+)?(?!\s*(?:가지|위|%|퍼센트|개|원|건|주|배|년|월|일|시|분|초|할인|혜택|종|종류|차|등|번|마리|팩|그램|kg|g|만원|천원))"


def has_url(text: Column) -> Column:
    return F.coalesce(text.rlike(URL_TOKEN), F.lit(False))


def path_of(u: Column) -> Column:
    return F.regexp_extract(u, r"^(?:[hH][tT][tT][pP][sS]?://)?[^/?#]*([^?#]*)", 1)


def is_short(u: Column) -> Column:
    return F.coalesce(host(u).isin(*SHORTENERS), F.lit(False))


def damaged_short(u: Column) -> Column:
    """A shortened URL that lost its path, or has brackets, stars or Hangul in it: of no use as input."""
    path = F.regexp_replace(path_of(u), "^/+|/+$", "")
    return is_short(u) & ((F.char_length(path) <= 1) | path.rlike(r"[\[\]*(){}<>가-힣]"))


def to_ascii_host(u: Column) -> Column:
    """The host in Punycode where it has other letters than ASCII ones; hosts that can't be converted stay."""
    h = host(u)
    return F.when(h.rlike(r"[^\x00-\x7F]"), F.coalesce(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), h), h)).otherwise(h)


def to_unicode_host(h: Column) -> Column:
    return F.when(h.contains("xn--"), F.coalesce(F.try_reflect(F.lit("java.net.IDN"), F.lit("toUnicode"), h), h)).otherwise(h)


def to_ascii(u: Column) -> Column:
    """A URL with its host in Punycode and other non-ASCII characters percent-encoded."""
    scheme, name = F.regexp_extract(u, "^(https?://)?", 0), F.regexp_extract(u, "^(?:https?://)?([^/?#]*)", 1)
    rest = F.substring(u, F.char_length(scheme) + F.char_length(name) + 1, F.char_length(u))
    encoded = F.array_join(F.transform(F.split(rest, ""), lambda c: F.when(F.octet_length(c) > 1, F.url_encode(c)).otherwise(c)), "")
    ascii_name = F.coalesce(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), name), name)
    return F.when(F.octet_length(u) == F.char_length(u), u).otherwise(F.concat(scheme, ascii_name, encoded))


def without_tail(u: Column) -> Column:
    """A shortened URL up to the first decoration, null if only its host is left; others as they are."""
    bare = F.regexp_replace(u, DECORATION, "")
    return F.when(~is_short(u), u).when(~bare.rlike("^(?:https?://)?[^/]+/$"), bare)


def split_list(urls: Column) -> Column:
    """The URLs of a comma-separated list."""
    return F.filter(F.transform(F.split(F.coalesce(urls, F.lit("")), ","), lambda u: F.trim(u)), lambda u: u != "")


def without_ips(urls: Column) -> Column:
    return F.filter(urls, lambda u: ~is_ip(u))


def in_message(u: Column, *texts: Column) -> Column:
    """The host (or its Unicode form) stands in one of the texts, white space and case aside; addresses never do."""
    h, found = host(u), F.lit(False)
    for t in texts:
        low = F.lower(F.regexp_replace(F.coalesce(t, F.lit("")), r"\s+", ""))
        found = found | F.contains(low, h) | F.contains(low, F.lower(to_unicode_host(h)))
    return found & (h != "") & ~is_ip(u)


def retries(u: Column, text: Column) -> Column:
    """Further forms of a URL that could not be opened, in order: without decoration, joined with the next one to
    three words of the text, without digits before the host."""
    bare = F.regexp_replace(u, DECORATION, "")
    bare = F.when((bare != u) & (F.char_length(bare) > 8) & F.regexp_replace(bare, "/+$", "").rlike("^[^/]*//[^/]+/"), bare)
    after = F.when(F.contains(text, u), F.substring(text, F.position(u, text) + F.char_length(u), F.char_length(text)))
    words = F.slice(F.filter(F.split(after, r"\s+"), lambda w: w != ""), 1, 3)
    longer = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words))), lambda n: F.regexp_replace(F.concat(u, F.array_join(F.slice(words, 1, n), "")), DECORATION, ""))
    longer = F.when(F.size(words) > 0, F.filter(longer, lambda x: (x != u) & (F.char_length(x) > 10)))
    head = F.regexp_extract(u, r"^(https?://)[0-9]+([^/\s]+)(/.*)?$", 2)
    digits = F.when(head.contains(".") & (F.char_length(head) > 3), F.regexp_replace(u, r"^(https?://)[0-9]+", "$1"))
    none = F.array().cast("array<string>")
    one = lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(none)
    return F.array_distinct(F.concat(one(bare), F.coalesce(longer, none), one(digits)))


def broken_short(u: Column, failed: Column) -> Column:
    """A page that failed to open behind a shortened URL: a known shortener, or a path of one to four characters alone."""
    path = F.regexp_replace(path_of(u), "^/+|/+$", "")
    return failed & (is_short(u) | (F.char_length(path).between(1, 4) & ~u.rlike("[?#]")))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def page_text(html: Column) -> Column:
    """Visible text of a page: no scripts, styles and tags; the common entities resolved; single spaces."""
    out = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    for entity, letter in {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}.items():
        out = F.replace(out, F.lit(entity), F.lit(letter))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n\f\x0b]+", " "))


def subscribers(u: Column, text: Column) -> Column:
    """The member count that a social page states; -1 where it states none."""
    social = F.exists(F.array(*map(F.lit, SOCIAL)), lambda d: F.contains(F.lower(u), d))
    line = F.regexp_replace(text, "\n", " ")
    n = F.regexp_replace(F.regexp_extract(line, SUBSCRIBERS, 1), ",", "").try_cast("double")
    times = F.when(F.regexp_extract(line, SUBSCRIBERS, 2).startswith("만"), 10_000).otherwise(1)
    return F.coalesce(F.when(social, (n * times).cast("long")), F.lit(-1).cast("long"))
