"""Phrase collocation mining, set-oriented: occurrence relations grow by one word a level.

R1 is the relation of all word occurrences: a row for each document, its positions ascending (a piece border
leaves a gap), with a hash of language and word. Level k merges R(k-1), after the semi-join with its frequent groups,
with itself: two neighbouring positions give a phrase of one word more, its group being the pair of theirs. The groups are counted (in
tasks first, then over pairs of hashes), those in fewer than `least` places go, and Rk, the occurrences of the rest, is written
for the next level. Because R is sorted by document and position, the merge-join is a scan of neighbours and shuffles nothing.

The semi-join takes a bitmap of the frequent groups' hashes, of 16 MB at most, as the groups themselves may outgrow
any broadcast. A bitmap lets some infrequent groups through, which their count then stops, and never stops a frequent one.

A candidate is a phrase of 2 to `longest` words with at least `least` occurrences. Its score is the smallest over all cuts of
floor(2000000 * a / (l + r)), in integers of 38 digits; candidates inside longer ones of at least 80 % of
their count go. Counts of all parts come from joining each level with the one below. The best `top` of each language are ranked in two
steps, so no task gets all candidates of a language; a last pass over the texts spells those and the ones that tie with the last.

Words are told apart by 64 bits of hash, phrases by the pair of their parts' hashes.

Defined cases: null and empty texts have no words; a null language is `und`; a language without candidates has no row; repeated rows
count each; ties go by occurrences, then by bytes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from siftwave.functions.byte_hash import Spans, bitmap_of, mix, passes
from siftwave.llm.common import scratch_table

#: A piece ends at these bytes; words are split at the others.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
TOGETHER = 1 << 19
#: Phrases that a task remembers to have spelled already; it forgets them all beyond that.
MOST_KNOWN = 500_000
#: Up to so many frequent groups of a level are broadcast by name (32 MB); pairs of more travel as hashes.
MOST_NAMED = 4 << 20
RELATION = "lang binary, gap array<int>, grp array<long>"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(BREAKS)] = 2


class Words:
    """The words of some texts: where they start and end in `data`, their document, position and hash."""

    def __init__(self, texts: list[bytes], langs: list[bytes]):
        self.raw = b"\n".join([*texts, b""])
        data = _LOWER[np.frombuffer(self.raw, np.uint8)]
        self.raw = data.tobytes()
        kind = _KIND[data]
        inside = np.r_[False, kind == 0, False]
        turn = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = turn[::2], turn[1::2]
        self.doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), self.start, side="right")
        self.pos = np.arange(len(self.start)) + np.cumsum(kind == 2)[self.start]
        spans = Spans(data)
        salt = mix(np.array([hash_text(x) for x in langs], np.uint64))[self.doc] if texts else np.zeros(0, np.uint64)
        self.group = mix(spans.hash(self.start, self.end) ^ salt)


def hash_text(text: bytes) -> int:
    return int(Spans(np.frombuffer(text, np.uint8)).sums[-1])


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a phrase from those of its two halves that overlap in all but one word."""
    return mix(left * np.uint64(3) + mix(right))


def merged(pos: np.ndarray, group: np.ndarray, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Semi-join with the frequent groups, then the merge-join of neighbouring positions: which rows start a phrase, where, and its two groups."""
    at = np.flatnonzero(passes(bitmap, group))
    pos, group = pos[at], group[at]
    first = np.flatnonzero(np.diff(pos) == 1)
    return at[first], pos[first], group[first], group[first + 1]


def occurrences(docs: DataFrame) -> DataFrame:
    """R1: lang, and gap (to the position before, over all documents of a block) and group of each word; a row for each document."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch):
                words, n = Words(*part_lists(part)), part.num_rows
                yield relation(part.column(1), words.pos, words.group, np.searchsorted(words.doc, np.arange(n + 1)))

    return texts_of(docs).mapInArrow(tasks, RELATION)


def parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about TOGETHER bytes of text; only one at a time becomes Python objects."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        end = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, side="right")), at + 1)
        yield batch.slice(at, end - at)
        at = end


def part_lists(part: pa.RecordBatch) -> list[list[bytes]]:
    return [[x or b"" for x in c.to_pylist()] for c in part.columns]


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("binary").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).cast("binary").alias("lang"))


def relation(lang: pa.Array, pos: np.ndarray, group: np.ndarray, cut: np.ndarray) -> pa.RecordBatch:
    """One row for each slice of positions; gaps are small numbers, which files store in few bits."""
    offsets = pa.array(cut, pa.int32())
    gap = np.diff(pos, prepend=0).astype(np.int32)
    return pa.RecordBatch.from_arrays([lang, pa.ListArray.from_arrays(offsets, pa.array(gap)), pa.ListArray.from_arrays(offsets, pa.array(group.view(np.int64)))], names=["lang", "gap", "grp"])


def unpacked(batches: Iterator[pa.RecordBatch], together: int = 1 << 18) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Languages of some rows of a batch, their positions and groups (about `together`), and the rows' borders. A gap of 2 or more starts each row, so that nothing joins over it."""
    for batch in batches:
        lang, gap, group = batch.columns
        offsets = gap.offsets.to_numpy()
        at = 0
        while at < batch.num_rows:
            end = max(int(np.searchsorted(offsets, offsets[at] + together, side="right")) - 1, at + 1)
            cut = offsets[at : end + 1]
            pos = gap.values.slice(cut[0], cut[-1] - cut[0]).to_numpy().astype(np.int64)
            heads = (cut - cut[0])[:-1][np.diff(cut) > 0]
            pos[heads] = np.abs(pos[heads]) + 2
            yield lang.slice(at, end - at), np.cumsum(pos), group.values.slice(group.offsets[at].as_py(), cut[-1] - cut[0]).to_numpy().view(np.uint64), cut - cut[0]
            at = end


def counted(pairs: Iterator[np.ndarray], most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Different pairs (rows of two numbers) and how often each came, summed inside the task; at most about twice `most` wait in memory."""
    held: list[np.ndarray] = []
    times: list[np.ndarray] = []

    def settle() -> None:
        all_, n = np.concatenate(held), np.concatenate(times)
        order = np.lexsort((all_[:, 1], all_[:, 0]))
        all_, n = all_[order], n[order]
        head = np.flatnonzero(np.r_[True, (all_[1:] != all_[:-1]).any(axis=1)]) if len(all_) else np.zeros(0, np.int64)
        held[:], times[:] = [all_[head]], [np.add.reduceat(n, head) if len(head) else n]

    for p in pairs:
        held.append(p)
        times.append(np.ones(len(p), np.int64))
        if sum(map(len, held[1:])) > most:
            settle()
            if len(held[0]) > most:
                yield held[0], times[0]
                held.clear()
                times.clear()
    if held:
        settle()
        yield held[0], times[0]


def frequent_words(occurring: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """lang, grp and n of words in at least `least` places, written; and lang and n of all words."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[bytes, int] = {}

        def pairs() -> Iterator[np.ndarray]:
            for lang, _, group, cut in unpacked(batches):
                own = np.array([names.setdefault(x, len(names)) for x in lang.to_pylist()], np.int64)
                yield np.stack([np.repeat(own, np.diff(cut)).view(np.uint64), group], axis=1)

        for found, n in counted(pairs()):
            langs = pa.DictionaryArray.from_arrays(pa.array(found[:, 0].astype(np.int32)), pa.array(list(names) or [b""], pa.binary())).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([langs, pa.array(np.ascontiguousarray(found[:, 1]).view(np.int64)), pa.array(n)], names=["lang", "grp", "n"])
            sums = np.bincount(found[:, 0].astype(np.int64), weights=n, minlength=len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(names), pa.binary()), pa.nulls(len(names), pa.int64()), pa.array(sums)], names=["lang", "grp", "n"])

    counts = occurring.mapInArrow(tasks, "lang binary, grp long, n long").groupBy("lang", "grp").agg(F.sum("n").alias("n"))
    both = scratch_table(counts.filter(F.col("grp").isNull() | (F.col("n") >= least)).withColumn("lang", F.col("lang").cast("string")), "frequent-words")
    return both.filter(F.col("grp").isNotNull()), both.filter(F.col("grp").isNull()).select("lang", "n")


def names_of(groups: DataFrame):
    """A broadcast sorted array of the groups' hashes, so that a group can be named by its place in it; None for more than `MOST_NAMED` groups."""
    if groups.count() > MOST_NAMED:
        return None
    return groups.sparkSession.sparkContext.broadcast(np.sort(groups.select("grp").toArrow()["grp"].to_numpy().view(np.uint64)))


def frequent_pairs(occurring: DataFrame, bitmap, names, least: int) -> DataFrame:
    """left, right, grp and n of the phrases of the next level in at least `least` places, written.

    With `names`, pairs are shuffled as pairs of places in it, which take half the bytes of hashes; the result is the same."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, pos, group, _ in unpacked(batches):
            both = np.stack(merged(pos, group, bitmap.value)[2:], axis=1)
            if names:
                place = np.searchsorted(names.value, both)
                known = (names.value[np.minimum(place, len(names.value) - 1)] == both).all(axis=1) if len(names.value) else np.zeros(len(both), bool)
                both = place[known].astype(np.uint64)
            yield both

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, n in counted(pairs(batches)):
            left, right = (np.ascontiguousarray(found[:, i]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(left.view(np.int64)), pa.array(right.view(np.int64)), pa.array(n)], names=["left", "right", "n"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = (b.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            if names:
                left, right = (names.value[x.astype(np.int64)] for x in (left, right))
            yield pa.RecordBatch.from_arrays([pa.array(left.view(np.int64)), pa.array(right.view(np.int64)), b.column(2), pa.array(joined(left, right).view(np.int64))], names=["left", "right", "n", "grp"])

    sums = occurring.mapInArrow(tasks, "left long, right long, n long").groupBy("left", "right").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return scratch_table(sums.mapInArrow(named, "left long, right long, n long, grp long"), "frequent-pairs")


def next_relation(occurring: DataFrame, before, now) -> DataFrame:
    """Rk: the occurrences of frequent groups, written as sorted as R(k-1) was."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, pos, group, cut in unpacked(batches):
            at, pos, left, right = merged(pos, group, before.value)
            group = joined(left, right)
            keep = passes(now.value, group)
            yield relation(lang, pos[keep], group[keep], np.searchsorted(at[keep], cut))

    return scratch_table(occurring.mapInArrow(tasks, RELATION), "occurrences", compression="zstd")


def mine_phrases(docs: DataFrame, least: int = 30, longest: int = 4) -> tuple[list[DataFrame], DataFrame]:
    """A table for each number of words, of the phrases with at least `least` occurrences: lang, grp, n and, from two words on, the groups left and right
    of its first and last part of one word less, and pre and suf, the counts of its beginnings and ends of 1, 2, ... words; and the words of each language (lang, n)."""
    occurring = scratch_table(occurrences(docs), "occurrences", compression="zstd")
    words, totals = frequent_words(occurring, least)
    levels, bitmap = [words.withColumns({c: F.array().cast("array<long>") for c in ("pre", "suf")})], bitmap_of(words.select("grp"))
    for k in range(2, longest + 1):
        below = levels[-1]
        pairs = frequent_pairs(occurring, bitmap, names_of(below), least)
        left = below.select(F.col("grp").alias("left"), "lang", F.concat("pre", F.array("n")).alias("pre"))
        right = below.select(F.col("grp").alias("right"), F.concat("suf", F.array("n")).alias("suf"))
        levels.append(scratch_table(pairs.join(left, "left").join(right, "right").select("lang", "grp", "n", "left", "right", "pre", "suf"), "phrases"))
        if k < longest:
            now = bitmap_of(levels[-1].select("grp"))
            occurring, bitmap = next_relation(occurring, bitmap, now), now
    return levels, totals


def spelled(docs: DataFrame, phrases: DataFrame, longest: int) -> DataFrame:
    """`phrases` (k, grp, ...) with their text: one pass over the texts, of which only phrases in a bitmap of the wanted ones become rows."""
    bitmap = bitmap_of(phrases.select(F.col("grp").bitwiseXOR(F.col("k")).alias("grp")), bits_each=1024)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[tuple[int, int]] = set()
        for batch in batches:
            for part in parts_of(batch):
                words, out = Words(*part_lists(part)), []
                at, group = np.arange(len(words.start)), words.group
                for k in range(2, longest + 1):
                    both = np.flatnonzero((np.diff(at) == 1) & (np.diff(words.pos[at]) == 1))
                    at, group = at[both], joined(group[both], group[both + 1])
                    hit = np.flatnonzero(passes(bitmap.value, group ^ np.uint64(k)))
                    for g, i in zip(group[hit].view(np.int64).tolist(), at[hit].tolist(), strict=True):
                        if (k, g) not in known:
                            known.add((k, g))
                            out.append((k, g, b" ".join([words.raw[words.start[j] : words.end[j]] for j in range(i, i + k)])))
                if len(known) > MOST_KNOWN:
                    known.clear()
                ks, gs, phrases_ = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(gs, pa.int64()), pa.array(phrases_, pa.binary())], names=["k", "grp", "phrase"])

    found = texts_of(docs).mapInArrow(tasks, "k int, grp long, phrase binary").groupBy("k", "grp").agg(F.min(F.col("phrase").cast("string")).alias("phrase"))
    return phrases.join(found, ["k", "grp"])


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, covered: int = 80, salts: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best `top` candidates of each language."""
    levels, totals = mine_phrases(docs, least, longest)
    wide = lambda c, f=1: c.cast("decimal(19,0)") * F.lit(f).cast("decimal(9,0)")
    # From the longest phrases down: `longer`, the greatest count of a longer phrase that holds this one.
    above, kept = None, []
    for k in range(longest, 1, -1):
        own = levels[k - 1]
        own = own.join(above, "grp", "left") if above is not None else own.withColumn("longer", F.lit(None).cast("long"))
        own = scratch_table(own, "longer")
        most = F.greatest("n", F.coalesce("longer", F.lit(0)))
        above = own.select(F.explode(F.array_distinct(F.array("left", "right"))).alias("grp"), most.alias("m")).groupBy("grp").agg(F.max("m").alias("longer"))
        kept.append(own.filter(F.col("longer").isNull() | (wide(F.col("longer"), 100) < wide(F.col("n"), covered))).select(F.lit(k).alias("k"), "lang", "grp", F.col("n").alias("a"), "pre", "suf"))
    found = kept[0]
    for more in kept[1:]:
        found = found.union(more)
    # A cut after `cut` words: the beginning of so many words, and the end of the rest.
    score = "cast(2000000 as decimal(18,0)) * cast(a as decimal(19,0)) div (cast(pre[cut - 1] as decimal(19,0)) + cast(suf[k - cut - 1] as decimal(19,0)))"
    cuts = F.expr(f"array_min(transform(sequence(1, k - 1), cut -> struct({score} as score, cut, pre[cut - 1] as l, suf[k - cut - 1] as r)))")
    scored = found.withColumn("best", cuts).select("k", "lang", "grp", "a", "best.score", "best.l", "best.r")
    order = (F.desc("score"), F.desc("a"))
    some = scored.withColumn("salt", F.pmod(F.xxhash64("grp"), F.lit(salts)))
    some = some.withColumn("rank", F.rank().over(W.Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    some = some.withColumn("rank", F.rank().over(W.Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    named = spelled(docs, scratch_table(some.drop("rank", "salt"), "best-phrases"), longest)
    place = F.row_number().over(W.Window.partitionBy("lang").orderBy(*order, "phrase"))
    ranked = named.withColumn("rank", place).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    """The contract's columns."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, row_number() OVER () AS piece, string_split_regex(x, '[\x20\x09]+') AS ws FROM (SELECT lang, unnest(ps) AS x FROM t)),
q AS (SELECT lang, piece, list_filter(ws, lambda w: w <> '') AS ws FROM p),
o AS (SELECT lang, unnest(flatten(list_transform(range(1, len(ws) + 1), lambda i: list_transform(range(1, 5), lambda k: CASE WHEN i + k - 1 <= len(ws) THEN array_to_string(ws[i:i + k - 1], ' ') END)))) AS phrase,
             unnest(flatten(list_transform(range(1, len(ws) + 1), lambda i: range(1, 5)))) AS k FROM q),
n AS (SELECT lang, count(*) AS n FROM o WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, phrase, any_value(k) AS k, count(*) AS a FROM o WHERE phrase IS NOT NULL GROUP BY lang, phrase HAVING count(*) >= 30),
c AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
u AS (SELECT lang, phrase, k, a, w, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT u.lang, u.phrase, u.a, u.cut, x.a AS l, y.a AS r, (2000000::HUGEINT * u.a) // (x.a + y.a) AS score
      FROM u JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(u.w[1:u.cut], ' ') JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(u.w[u.cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
z AS (SELECT lang, a, unnest(list_distinct(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' ')))))) AS phrase FROM c WHERE k > 2),
m AS (SELECT lang, phrase, max(a) AS longer FROM z GROUP BY lang, phrase),
d AS (SELECT b.* FROM b LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase WHERE m.longer IS NULL OR 100 * m.longer < 80 * b.a),
g AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d)
SELECT g.lang, g.rank, g.phrase, g.a, g.l, g.r, n.n, g.score::BIGINT AS score FROM g JOIN n ON n.lang = g.lang WHERE g.rank <= 2000
"""
