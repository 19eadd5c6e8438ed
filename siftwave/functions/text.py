"""Text columns: normal forms, byte lengths, obfuscation measures, display cells."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters that pass for digits, and characters that mask text.
LOOKALIKES = "OoIlBSZbqgz"
MASKS = r"?*_#~^·�"
HANGUL = "가-힣"
LETTERS, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789"
ASCII = "".join(map(chr, range(128)))


def _size(c: Column) -> Column:
    return F.char_length(c)


def strip_space(c: Column) -> Column:
    """Without any Unicode white space."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def strip_ascii_space(c: Column) -> Column:
    return F.translate(c, " \t\r\n\f\x0b", "")


@F.pandas_udf(T.StringType())
def _nfkc(c: pd.Series) -> pd.Series:
    return c.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def nfkc(c: Column) -> Column:
    """The compatible normal form. ASCII texts, which don't change, aren't sent to Python."""
    return F.coalesce(_nfkc(F.when(F.octet_length(c) != _size(c), c)), c)


def approx_bytes(c: Column) -> Column:
    """Two bytes for each non-ASCII character, one for others."""
    return _size(c) + F.when(F.octet_length(c) == _size(c), 0).otherwise(F.regexp_count(c, F.lit(r"[^\x00-\x7F]")))


def visible_bytes(c: Column) -> Column:
    """approx_bytes() of a text without ASCII white space, which is never built."""
    return approx_bytes(c) - count_of(c, r" \t\r\n\f\x0b")


def share(part: Column, whole: Column) -> Column:
    """Part over whole, 0 of nothing; both are evaluated once."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def count_of(c: Column, chars: str) -> Column:
    """How many characters of a class (as in a pattern's brackets) a text has; counting matches is much faster than removing them."""
    return F.regexp_count(c, F.lit(f"[{chars}]"))


def beyond_ascii(c: Column) -> Column:
    """The non-ASCII characters alone, which are few in most texts."""
    return F.when(F.octet_length(c) == _size(c), "").otherwise(F.translate(c, ASCII, ""))


def hangul_share(c: Column) -> Column:
    """Hangul among letters."""
    rest = beyond_ascii(c)
    return share(_size(F.regexp_replace(rest, f"[^{HANGUL}]", "")), _size(c) - count_of(c, "^A-Za-z") + _size(F.regexp_replace(rest, r"\P{L}", "")))


def lookalike_share(c: Column) -> Column:
    """Digits and letters like digits among letters and digits that aren't Hangul."""
    rest = beyond_ascii(c)
    digits = _size(F.regexp_replace(rest, r"\P{Nd}", ""))
    return share(count_of(c, "0-9" + LOOKALIKES) + digits, _size(c) - count_of(c, "^A-Za-z0-9") + _size(F.regexp_replace(rest, rf"[^\p{{L}}\p{{N}}]|[{HANGUL}]", "")))


def masked(c: Column, at_least: float = 0.15, min_chars: int = 10) -> Column:
    return F.coalesce((_size(c) >= min_chars) & (count_of(c, MASKS) / _size(c) >= at_least), F.lit(False))


def masked_domain(c: Column) -> Column:
    """A mask character with a dot and letters behind it, with or without letters and digits between."""
    return F.coalesce(c.rlike(rf"[{MASKS}][a-zA-Z0-9]*\.[a-zA-Z]{{2}}"), F.lit(False))


def broken(c: Column) -> Column:
    """Text lost to a wrong encoding: ten question or replacement marks in a row, or over 0.4 of them, white space aside."""
    marks = count_of(c, "?\ufffd")
    run = F.when(marks >= 10, strip_ascii_space(c).rlike("[?\ufffd]{10}")).otherwise(F.lit(False))
    many = F.when(marks > 0, share(marks, _size(c) - count_of(c, r" \t\r\n\f\x0b")) > 0.4).otherwise(F.lit(False))
    return F.coalesce(run | many, F.lit(False))


def spaced_hangul(c: Column) -> Column:
    """Hangul letters with single other characters between; the matched text or null."""
    text = F.when(F.octet_length(c) != _size(c), c)  # Hangul isn't ASCII
    found = [F.regexp_extract(text, p, 0) for p in (rf"(?U)[{HANGUL}]\W[{HANGUL}]\W[{HANGUL}]", rf"(?U)[{HANGUL}]\s*[./,\-_]\s*[{HANGUL}]")]
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found])


def obfuscation_map() -> dict[str, str]:
    """What characters stand for: circled and full-width letters, full-width digits and marks, mathematical bold letters, raised and lowered digits.

    Fixed ranges and characters; circled and mathematical digits aren't among them."""
    low, up = LETTERS[26:], LETTERS[:26]
    runs = [(0x24D0, low), (0x24B6, up), (0xFF41, low), (0xFF21, up), (0xFF10, DIGITS), (0x1D400, up), (0x1D41A, low), (0x2080, DIGITS), (0x2074, DIGITS[4:])]
    out = {chr(start + i): to for start, letters in runs for i, to in enumerate(letters)}
    return out | {"⁰": "0", "¹": "1", "²": "2", "³": "3", "．": ".", "／": "/", "：": ":", "？": "?", "＆": "&", "＝": "=", "＠": "@", "－": "-", "＿": "_"}


def deobfuscate(c: Column) -> Column:
    m = obfuscation_map()
    return F.translate(c, "".join(m), "".join(m.values()))


def has_unicode_obfuscation(c: Column) -> Column:
    return F.when(F.octet_length(c) == _size(c), False).otherwise(deobfuscate(c) != c)


def has_url_token(c: Column) -> Column:
    """Something like a URL: a scheme or www. before more text, or a dotted name."""
    return F.coalesce(c.rlike(r"(?:https?://|www\.)\S|[a-zA-Z0-9\uac00-\ud7a3\u3131-\u3163\-.?]\.[a-zA-Z\uac00-\ud7a3]{2}"), F.lit(False))


def obfuscated_urls(c: Column) -> Column:
    """original and decoded of URLs that read differently once decoded, by their order; null originals where only the decoded text has one."""
    name = rf"(?U)(?:https?://)?(?:[\w{HANGUL}-]+\.)+[a-zA-Z]{{2,}}(?:/[\w\-.~:/?#\[\]@!$&'()*+,;=%]*)?"
    found = lambda t: F.regexp_extract_all(t, F.lit(name), F.lit(0))
    pairs = F.filter(F.arrays_zip(found(c).alias("original"), found(deobfuscate(c)).alias("decoded")), lambda p: p["decoded"].isNotNull() & ~p["original"].eqNullSafe(p["decoded"]))
    none = F.array().cast("array<struct<original:string,decoded:string>>")
    return F.when(has_unicode_obfuscation(c), F.transform(pairs, lambda p: F.struct(p["original"].alias("original"), p["decoded"].alias("decoded")))).otherwise(none)


def safe_cell(c: Column) -> Column:
    """Guards spreadsheet formulas."""
    bare = F.translate(c, "\x00", "")
    return F.when(F.substring(bare, 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("'"), bare)).otherwise(bare)


def unsafe_cell(c: Column) -> Column:
    return F.regexp_replace(c, r"^'(?=[=+@-])", "")


def code_digits(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(c, r"[0-9]+", 0), F.lit("")), c)


def code_int(c: Column) -> Column:
    """The code's digits as a number; null where they are none."""
    return code_digits(c).try_cast("int")


def without_point_zero(c: Column) -> Column:
    """A number read as a fraction, without its last .0."""
    return F.regexp_replace(c, r"\.0$", "")


def is_o(c: Column, any_case: bool = False) -> Column:
    """The human mark of spam, an o; null is none."""
    return F.coalesce((F.lower(F.trim(c)) if any_case else F.trim(c)) == "o", F.lit(False))


def signature_text(c: Column) -> Column:
    return F.translate(c, " \r\n", "")


def percent(p: Column) -> Column:
    return F.concat(F.floor(p * 100).cast("int").cast("string"), F.lit("%"))


def verdict_text(is_spam: Column) -> Column:
    return F.when(is_spam.isNull(), "HITL").when(is_spam, "SPAM").otherwise("HAM")


def similarity_key(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, f"[^{HANGUL}a-zA-Z]", ""), 1, 30)


@F.pandas_udf(T.BooleanType())
def is_cp949(c: pd.Series) -> pd.Series:
    """Whether code page 949 can hold a text; null for null."""

    def one(s):
        try:
            return s is not None and len(s.encode("cp949")) >= 0
        except UnicodeEncodeError:
            return False

    return c.map(one).where(c.notna(), None).astype("boolean")


def cp949_bytes(unmappable: str = "utf-8"):
    """Arrow UDF of byte lengths in code page 949. Texts it can't hold: their UTF-8 bytes, or "double" (2 a character), or "replace" (1 for each bad one)."""
    def one(s):
        if s is None:
            return None
        try:
            return len(s.encode("cp949"))
        except UnicodeEncodeError:
            return len(s.encode("utf-8")) if unmappable == "utf-8" else 2 * len(s) if unmappable == "double" else len(s.encode("cp949", errors="replace"))

    @F.pandas_udf(T.LongType())
    def sizes(c: pd.Series) -> pd.Series:
        return c.map(one).astype("Int64")

    return sizes
