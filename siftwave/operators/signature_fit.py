"""Signatures: anchor tags and scores of candidates, and proposals fitted to the allowed byte lengths."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwave.functions.text import strip_space
from siftwave.operators.spans import character_bytes
from siftwave.operators.tables import SENTENCE_BYTES, STRING_BYTES

#: Patterns of anchors and what they are worth.
ANCHORS = {
    "PHONE": r"0\d{1,2}[-.\s]?\d{3,4}[-.\s]?\d{4}",
    "OPT_OUT": r"(무료|수신)거부|080[-.\s]?\d{3,4}[-.\s]?\d{4}",
    "AD_MARK": r"\(광고\)|\[광고\]",
    "OBFUSCATION": r"""[가-힣ㄱ-ㆎ]+[A-Za-z0-9_.,'"!:;|=+\-@$%^&*()\[\]{}<>]+[가-힣ㄱ-ㆎ]+""",
    "SYMBOLS": r"[▶◀★◆■#☎☏@]",
    "CODE": r"[A-Za-z0-9]{5,}",
    "SENSITIVE_KEYWORD": r"대.{0,2}출|코.{0,2}인|도.{0,2}박|시급|지급|이벤트|추천번호|참여|상담|카.{0,2}톡|텔.{0,2}레|입장|혜택|보너스|뽀너스|적립금|충전|환전|포인트|배당|무료픽|가족방|사다리|야마토|풀싸롱|매.{0,2}직.{0,2}미.{0,2}러|아가씨|출장|성.{0,2}인|지원금|현금지원|대리운전|블랙박스|여성작업제|남성기능|개인돈|일수|월변|급전|무서류|일급|월급|투잡|알바|주.{0,2}식|종목|수익|리딩|작전주|매집|토.{0,2}토|바.{0,2}카.{0,2}라|남겨주세요|문의주세요|구독|검색",
}
WEIGHTS = {"PHONE": 15.0, "OPT_OUT": 1.0, "AD_MARK": -5.0, "OBFUSCATION": 10.0, "SYMBOLS": 12.0, "CODE": 8.0, "SENSITIVE_KEYWORD": 5.0}
BLOCK_MARKS = r"\(광고\)|\[광고\]|무료거부|무료수신거부"


def anchor_tags(c: Column) -> Column:
    return F.filter(F.array(*[F.when(c.rlike(p), tag) for tag, p in ANCHORS.items()]), lambda t: t.isNotNull())


def anchored_score(c: Column, size: Column) -> Column:
    """Weights of the tags; short texts, digits alone and advertising marks without a concrete anchor lose."""
    has = lambda t: c.rlike(ANCHORS[t])
    score = F.when(size <= 8, -3.0).otherwise(0.0) + F.when(c.rlike("^[0-9]+$"), -2.0).otherwise(0.0)
    for tag, weight in WEIGHTS.items():
        score = score + F.when(has(tag), weight).otherwise(0.0)
    return score - F.when(has("AD_MARK") & ~has("PHONE") & ~has("CODE") & ~has("SYMBOLS"), 15.0).otherwise(0.0)


def best_anchors(df: DataFrame, id: str, body: str, size) -> DataFrame:
    """id, n, text and score: the candidates around the concrete anchors of a text without white space are their matches, each
    once; the best by score, then text; null where there is none. `id` must be unique.

    Candidates are scored and compared where their text is, so nothing is shuffled or sorted."""
    every = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(body, F.lit(ANCHORS[t]), F.lit(0)) for t in ("PHONE", "OPT_OUT", "SYMBOLS", "CODE")])))
    scored = F.transform("_every", lambda c: F.struct(anchored_score(c, size(c)).alias("score"), c.alias("text")))
    best = df.select(id, every.alias("_every")).select(id, F.coalesce(F.size("_every"), F.lit(0)).cast("long").alias("n"), F.array_max(scored).alias("s"))
    return best.select(id, "n", "s.text", "s.score")


#: What a row of fit_spans() is: a text that stays, a string, a sentence, and a body whose first long block is wanted, with the text that stays behind it if there is none.
KEEP, STRING, SENTENCE, BLOCK = range(4)
LEASTS, MOSTS, ROOMS = (np.array(v) for v in ((0, STRING_BYTES[0], SENTENCE_BYTES[0], 0), (1 << 40, STRING_BYTES[1], SENTENCE_BYTES[1], SENTENCE_BYTES[1]), (0, STRING_BYTES[0], SENTENCE_BYTES[1], 0)))


def first_blocks(text: str, sums: np.ndarray, start: np.ndarray, stop: np.ndarray, front: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where the first block of a sentence's bytes begins in each part of a text, -1 if there is none, and where it ends: blocks lie between marks and ends of lines.

    With `front`, the bytes must be in the first so many characters of a block."""
    marks = np.array([(0, 0), *(m.span() for m in re.finditer(rf"\n|{BLOCK_MARKS}", text)), (len(text), len(text))])
    lo, hi = marks[:-1, 1], marks[1:, 0]
    long = sums[hi if front is None else np.minimum(hi, lo + front)] - sums[lo] >= SENTENCE_BYTES[0]
    lo, hi = np.append(lo[long], len(text) + 1), np.append(hi[long], len(text) + 1)
    at = np.searchsorted(lo, start)
    return np.where(lo[at] < stop, lo[at], -1), hi[at]


def fit_spans(texts: list[str], at: np.ndarray, n: np.ndarray, kind: np.ndarray, grow: np.ndarray, front: int | None = None) -> tuple[np.ndarray, ...]:
    """Kind, start, stop and bytes of the part of each text that keeps to the policy, from the part of n characters at `at`; all rows at once, on sums of bytes.

    A part that may grow takes a character on the left, then one on the right, and so on, until it has the least bytes of its kind; a last one
    on the right if the most allow it. Short sentences become strings. Longer parts are cut."""
    text = "\n".join(texts)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    known = character_bytes(codes)
    sums, known_sums = (np.cumsum(np.r_[0, v]) for v in (np.maximum(known, 1), known))
    size = np.array([len(t) for t in texts])
    start = np.cumsum(np.r_[0, size + 1])[:-1]
    stop = start + size
    wanted = kind == BLOCK
    block, end = first_blocks(text, known_sums, start, stop - n, front) if wanted.any() else (start, stop)
    some = wanted & (block >= 0)
    lo = np.where(some, block, np.where(wanted, stop - n, start + at))
    hi = np.where(some, end, lo + n)
    kind = np.where(wanted, np.where(some, SENTENCE, KEEP), kind)
    steps = np.arange(2 * SENTENCE_BYTES[0] + 2)
    left = lo[:, None] - np.minimum((steps + 1) // 2, (lo - start)[:, None])
    right = hi[:, None] + np.minimum(steps // 2, (stop - hi)[:, None])
    grown = sums[right] - sums[left]
    enough = grown >= LEASTS[kind][:, None]
    h = np.where(enough.any(1), enough.argmax(1), len(steps) - 1)
    row = np.arange(len(texts))
    more = np.minimum(h + 1, len(steps) - 1)
    h = np.where((h % 2 == 1) & (grown[row, more] <= ROOMS[kind]), more, h) * (grow & ~wanted)
    lo, hi = left[row, h], right[row, h]
    kind = np.where((kind == SENTENCE) & (sums[hi] - sums[lo] < SENTENCE_BYTES[0]), STRING, kind)
    hi = np.minimum(hi, np.searchsorted(sums, sums[lo] + MOSTS[kind], side="right") - 1)
    return kind, lo - start, hi - start, sums[hi] - sums[lo]


def _spans(front: int | None):
    @F.pandas_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in ("kind", "start", "stop", "bytes")]))
    def spans(text: pd.Series, at: pd.Series, n: pd.Series, kind: pd.Series, grow: pd.Series) -> pd.DataFrame:
        if not len(text):
            return pd.DataFrame({c: pd.Series(dtype="int32") for c in ("kind", "start", "stop", "bytes")})
        found = fit_spans(text.tolist(), at.to_numpy(), n.to_numpy(), kind.to_numpy(), grow.to_numpy(), front)
        return pd.DataFrame(dict(zip(("kind", "start", "stop", "bytes"), found, strict=True))).astype("int32")

    return spans


def fit_signatures(df: DataFrame, body: str, signature: str, decision: str, front: int | None = None) -> DataFrame:
    """Adds fitted_decision, fitted_signature and fitted_bytes of a proposal for a text without white space; nulls count as empty and unextractable.

    Without a proposal the text's first block of a sentence's bytes (in its first `front` characters, if given) stands in. Proposals that aren't in the
    text, not even cut, are unextractable."""
    c = F.col
    own = df.select("*", F.coalesce(body, F.lit("")).alias("_b"), F.coalesce(signature, F.lit("")).alias("_s"), F.coalesce(decision, F.lit("unextractable")).alias("_d"))
    kind = F.when((c("_s") == "") | (c("_d") == "unextractable"), BLOCK).when(c("_d") == "use_string", STRING).when(c("_d") == "use_sentence", SENTENCE).otherwise(KEEP)
    bare = own.withColumn("_k", kind).withColumn("_s", F.when(c("_k").isin(STRING, SENTENCE), strip_space(c("_s"))).otherwise(c("_s")))
    placed = bare.withColumn("_at", F.when(c("_k").isin(STRING, SENTENCE), F.expr("locate(_s, _b)")).otherwise(0))
    text = F.when(c("_k") == BLOCK, F.concat("_b", F.lit("\n"), "_s")).when(c("_at") > 0, c("_b")).otherwise(c("_s"))
    based = placed.withColumn("_t", text)
    fit = based.withColumn("_f", _spans(front)("_t", F.greatest(c("_at") - 1, F.lit(0)), F.char_length("_s"), "_k", c("_at") > 0))
    cut = fit.withColumn("_v", F.expr("substring(_t, _f.start + 1, _f.stop - _f.start)"))
    lost = (c("_v") != "") & ~F.contains(c("_b"), c("_v")) & (c("_k") != BLOCK)
    named = F.when(lost, "unextractable").when(c("_f.kind") == STRING, "use_string").when(c("_f.kind") == SENTENCE, "use_sentence").otherwise(c("_d"))
    return cut.select(*df.columns, named.alias("fitted_decision"), F.when(lost, "").otherwise(c("_v")).alias("fitted_signature"), F.when(lost, 0).otherwise(c("_f.bytes")).alias("fitted_bytes"))
