"""Signature candidates with their place in the original text, as a table function and as columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a candidate, characters of its original text, and what short ones and numbers lose.
LEAST, LONGEST, SPAN = 4, 20, 100
SHORT_BYTES, SHORT_LOSS, DIGITS_LOSS = 8, 3.0, 2.0
FIELDS = "start int, stop int, origin int, origin_stop int, bytes int, score double, candidate string, original string"


#: White space as str.split() takes it.
WHITE = np.zeros(0x110000, bool)
WHITE[[c for c in range(0x3001) if chr(c).isspace()]] = True


def two_byte_characters() -> np.ndarray:
    """Bytes of every code point of the basic plane in CP949: 1, 2, or 0 where it has none."""
    sizes = np.zeros(0x10000, np.int8)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000:
            sizes[c] = len(chr(c).encode("cp949", "ignore"))
    return sizes


_sizes: list[np.ndarray] = []


def character_bytes(codes: np.ndarray) -> np.ndarray:
    if not _sizes:
        _sizes.append(two_byte_characters())
    return np.where(codes < 0x10000, _sizes[0][np.minimum(codes, 0xFFFF)], 0)


def windows(text: str, longest: int, least: int, span: int) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The text without white space, its code points, the original place of each of its characters, the sums of bytes before each, and per start the first and last stop of windows
    of `least` to `longest` bytes whose original text has at most `span` characters. A character outside CP949 ends every window before it."""
    all_codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    place = np.flatnonzero(~WHITE[all_codes])
    dense, codes = "".join(text.split()), all_codes[place]
    size = character_bytes(codes)
    sums = np.cumsum(np.r_[0, size])
    n = len(dense)
    start = np.arange(n)
    wrong = np.r_[np.flatnonzero(size == 0), n]
    wall = wrong[np.searchsorted(wrong, start)]  # the next character without bytes
    last = np.minimum.reduce([np.searchsorted(sums, sums[:-1] + longest, side="right") - 1, np.searchsorted(place, place + span - 1, side="right"), wall])
    first = np.searchsorted(sums, sums[:-1] + least, side="left")
    return dense, codes, place, sums, first, last


def best_windows(text: str, longest: int = LONGEST, k: int = 5, least: int = LEAST, span: int = SPAN, together: int = 20_000) -> list[tuple]:
    """The `k` different candidates of a text with the best score (then most bytes, then first in binary order), each at its first place.

    Windows of one score and size are looked for together, best ones first, for `together` starts at a time, until there are `k`. Of those whose
    first three characters are among the `k` first ones, the binary order decides. So memory follows `together` and the text."""
    dense, codes, place, sums, first, last = windows(text, longest, least, span)
    others = np.cumsum(np.r_[0, (codes < ord("0")) | (codes > ord("9"))])
    ahead = np.r_[codes, 0, 0].astype(np.int64)
    scored = [(0.0 - SHORT_LOSS * (n <= SHORT_BYTES) - DIGITS_LOSS * digits, n, digits) for digits in (False, True) for n in range(least, longest + 1)]
    best: list[tuple[float, int, int, int]] = []
    for score, n, digits in sorted(scored, key=lambda c: (-c[0], -c[1])):
        if len(best) >= k:
            break
        own: dict[str, tuple[int, int]] = {}
        for a in range(0, len(dense), together):
            start = np.arange(a, min(a + together, len(dense)))
            stop = np.minimum(np.searchsorted(sums, sums[start] + n, side="left"), len(dense))
            fits = (sums[stop] - sums[start] == n) & (stop >= first[start]) & (stop <= last[start]) & ((others[stop] == others[start]) == digits)
            start, stop = start[fits], stop[fits]
            head = (ahead[start] << 42) | (np.where(start + 1 < stop, ahead[start + 1], 0) << 21) | np.where(start + 2 < stop, ahead[start + 2], 0)
            if len(head) > k:
                # Copies of one head may fill the first places, so the different ones of more and more places are taken.
                m = 8 * k
                while len(heads := np.unique(np.partition(head, m - 1)[:m] if m < len(head) else head)) < k and m < len(head):
                    m *= 8
                near = head <= heads[min(k, len(heads)) - 1]
                start, stop = start[near], stop[near]
            for i, j in zip(start.tolist(), stop.tolist(), strict=True):
                own.setdefault(dense[i:j], (i, j))
            own = dict(sorted(own.items())[:k])
        best += [(score, n, i, j) for i, j in list(own.values())[: k - len(best)]]
    return [(a, b, int(place[a]), int(place[b - 1]) + 1, n, score, dense[a:b], text[place[a] : place[b - 1] + 1]) for score, n, a, b in best]


@F.udtf(returnType=FIELDS, useArrow=True)
class SignatureWindows:
    """signature_windows(text, longest, k): the best candidates of a text, for lateral joins. Null texts have none."""

    def eval(self, text: str, longest: int, k: int) -> Iterator[tuple]:
        if text:
            yield from best_windows(text, longest, k)


def register(spark: SparkSession) -> None:
    """Makes signature_windows known to SQL of the session."""
    spark.udtf.register("signature_windows", SignatureWindows)


def candidate_spans(df: DataFrame, key: str, text: str, longest: int = LONGEST, k: int = 5) -> DataFrame:
    """`key` and the fields of the best candidates of each text, one row for each.

    Everything about a text happens in its task; what leaves it are `k` rows."""
    register(df.sparkSession)
    texts = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return df.sparkSession.sql(f"SELECT x.k AS `{key}`, w.* FROM {{texts}} x, LATERAL signature_windows(x.t, {int(longest)}, {int(k)}) w", texts=texts)
