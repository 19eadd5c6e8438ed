"""Filters over verdict logs, and what of a log goes into block lists. Null flags count as false."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwave.functions import reports as R
from siftwave.functions import urls as U
from siftwave.operators.clusters import codes_of, window_hashes

MAX_BROADCAST = 200_000


def yes(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def blockable_urls(df: DataFrame, size, max_bytes: int = 40) -> DataFrame:
    """Different URLs of spam, red or malicious rows that keep theirs: key (domain path), first row, url, bytes, code, short.

    Reads id, urls (array), is_spam, red_group, malicious, drop_url, reason, code. Rows whose reason speaks of an
    obfuscated domain, addresses and long URLs are left out; the first sighting of a key counts."""
    rows = df.filter((yes("is_spam") | yes("red_group") | yes("malicious")) & ~yes("drop_url") & ~F.coalesce(F.lower("reason").contains("obfuscated domain"), F.lit(False)))
    each = rows.select("id", "code", F.explode("urls").alias("url")).withColumn("url", U.rstrip(F.trim("url")))
    each = each.withColumn("bytes", size(F.col("url"))).filter((F.col("bytes") <= max_bytes) & ~F.coalesce(U.is_ip(F.col("url")), F.lit(False)))
    keyed = each.withColumn("key", U.domain_path(F.col("url"))).filter("key <> ''")
    return keyed.groupBy("key").agg(F.min(F.struct("id", "url", "bytes", "code")).alias("f")).select("key", "f.*", U.is_short(F.col("f.url")).alias("short"))


def blockable_signatures(df: DataFrame) -> DataFrame:
    """Rows with a signature worth blocking: spam or red, named, 9 to 20 bytes or 39 and more."""
    named = ~F.coalesce(F.lower("signature"), F.lit("none")).isin("", "none", "unextractable")
    return df.filter((yes("is_spam") | yes("red_group")) & named & (F.col("bytes") >= 9) & ~F.col("bytes").between(21, 38))


def drop_excluded(df: DataFrame) -> DataFrame:
    return df.filter(~yes("excluded"))


def disagreements(df: DataFrame) -> DataFrame:
    """Rows on which human and machine differ; adds kind: FN or FP."""
    h, m = yes("human_spam"), yes("machine_spam")
    return df.filter(h != m).withColumn("kind", F.when(h, "FN").otherwise("FP"))


def pure_type_b(df: DataFrame) -> DataFrame:
    """Type_B rows without obfuscation and personal lure; adds their other signals, and whether layout or a vague call is the only one."""
    on = lambda k: F.coalesce(F.try_element_at("signals", F.lit(k)), F.lit(False))
    rows = df.filter(F.contains("class", F.lit("Type_B")) & ~on("is_garbage_obfuscation") & ~on("is_personal_lure")).withColumn("active", R.active_signals(F.col("signals")))
    return rows.withColumn("single", (F.size("active") == 1) & F.get("active", F.lit(0)).isin("is_normal_layout", "is_vague_cta"))


def ambiguous(df: DataFrame) -> DataFrame:
    """One row for each test that a verdict meets. Reads is_spam, p, reason, class, message; adds test."""
    spam, a = yes("is_spam"), F.col("class") == "Type_A"
    tests = {
        "low_spam": spam & (F.col("p") < 0.85),
        "high_ham": ~spam & (F.col("p") >= 0.5) & ~F.contains("reason", F.lit("Override")),
        "unsure": spam & a & F.col("reason").rlike("애매|판단하기 어렵|불확실"),
        "short": spam & a & (F.char_length("message") < 40),
    }
    return df.withColumn("test", F.explode(F.filter(F.array(*[F.when(c, name) for name, c in tests.items()]), lambda x: x.isNotNull())))


def history_source(df: DataFrame, least: int = 9, most: int = 30) -> DataFrame:
    """Different texts of rows marked o, short enough to be counted: text."""
    bare = F.regexp_replace("text", r"(?U)\s+", "")
    rows = df.filter((F.lower(F.trim("mark")) == "o") & F.char_length("text").between(least, most))
    return rows.select(bare.alias("text")).filter(F.char_length("text") <= most).distinct()


#: Messages are searched in stretches of so many characters.
STRETCH = 1 << 20


def held_keys(keys: Broadcast):
    """id and key of each of the shared keys that a message holds: grams are looked up by their hashes, then compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {n: {k for k in keys.value if len(k) == n} for n in {len(k) for k in keys.value}}
        hashes = {n: np.sort(np.concatenate([window_hashes(codes_of(k), n) for k in some])) for n, some in known.items() if n}
        marks = {}
        for n, h in hashes.items():
            marks[n] = np.zeros(1 << 22, bool)
            marks[n][(h >> np.uint64(42)).astype(np.int64)] = True

        def places(text: str, n: int) -> np.ndarray:
            h = window_hashes(codes_of(text), n)
            at = np.flatnonzero(marks[n][(h >> np.uint64(42)).astype(np.int64)])
            place = np.minimum(np.searchsorted(hashes[n], h[at]), len(hashes[n]) - 1)
            return at[hashes[n][place] == h[at]]

        for batch in batches:
            rows, found = [], []
            texts = batch.column(1).to_pylist()
            ends = np.cumsum([len(t) for t in texts])
            first = 0
            while first < len(texts):  # messages together, up to a stretch
                before = int(ends[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(ends, before + STRETCH, side="right")))
                whole, own = "".join(texts[first:last]), ends[first:last] - before
                for n, some in known.items():
                    if not n:
                        rows += range(first, last)
                        found += [""] * (last - first)
                        continue
                    hits = set()
                    for a in range(0, len(whole), STRETCH):
                        for at in (places(whole[a : a + STRETCH + n - 1], n) + a).tolist():
                            i = int(np.searchsorted(own, at, side="right"))
                            if at + n <= own[i] and whole[at : at + n] in some:
                                hits.add((first + i, whole[at : at + n]))
                    rows += [i for i, _ in hits]
                    found += [k for _, k in hits]
                first = last
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], names=["id", "key"])

    return run


def probe_logs(df: DataFrame, probes: DataFrame, gram: int = 12, max_broadcast: int = MAX_BROADCAST, block: int = 64) -> DataFrame:
    """The first log (id, message) that holds each probe (probe); null where none does.

    A probe is found by its first `gram` characters (all of a shorter one) among the grams of the messages; longer
    ones are then compared whole. Up to `max_broadcast` probes go to the messages, whose grams are looked up where they are. Else the
    join is on equal grams, so either side may be large, and messages are cut in blocks first, so that the place of a gram isn't sought
    from the start of a long text."""
    keyed = probes.select("probe").filter("probe is not null").distinct().withColumn("key", F.left("probe", F.lit(gram)))
    shapes = keyed.groupBy(F.char_length("key").alias("size"), (F.char_length("probe") > gram).alias("longer")).count().collect()
    few = sum(r["count"] for r in shapes) <= max_broadcast
    sizes = sorted({r["size"] for r in shapes})
    if few:
        keys = [r["key"] for r in keyed.select("key").distinct().collect()]  # at most `max_broadcast` of `gram` characters
        kind = df.schema["id"].dataType.simpleString()
        grams = df.filter("message is not null").select("id", "message").mapInArrow(held_keys(df.sparkSession.sparkContext.broadcast(keys)), f"id {kind}, key string")
    else:
        starts = F.sequence(F.lit(0), F.greatest(F.char_length("message") - 1, F.lit(0)), F.lit(block))
        blocks = df.filter("message is not null").select("id", F.explode(F.transform(starts, lambda b: F.substring(F.col("message"), b + 1, F.lit(block + gram - 1)))).alias("part"))
        places = blocks.select("id", "part", F.explode(F.sequence(F.lit(1), F.greatest(F.least(F.char_length("part"), F.lit(block)), F.lit(1)))).alias("at"))
        cut = [F.expr(f"substring(part, at, {n})") for n in sizes]
        sized = [F.when(F.char_length(k) == n, k) for k, n in zip(cut, sizes, strict=True)]
        grams = places.select("id", F.explode(F.array(*sized)).alias("key") if len(sized) > 1 else sized[0].alias("key")).filter("key is not null")
    whole = keyed.filter(F.char_length("probe") <= gram)
    # A long list meets each different gram once, with its first log.
    found = grams.join(F.broadcast(whole), "key") if few else grams.groupBy("key").agg(F.min("id").alias("id")).join(whole, "key")
    hits = found.select("probe", "id")
    if any(r["longer"] for r in shapes):
        longer = keyed.filter(F.char_length("probe") > gram)
        near = grams.join(F.broadcast(longer) if few else longer, "key").select("id", "probe").distinct()
        hits = hits.unionByName(near.join(df.select("id", "message"), "id").filter(F.contains("message", "probe")).select("probe", "id"))
    return probes.select("probe").join(hits.groupBy("probe").agg(F.min("id").alias("id")), "probe", "left")


def short_signature_domains(df: DataFrame, most: int = 20) -> Column:
    """A short signature that is a host with a known top-level part."""
    return (F.col("bytes") <= most) & F.coalesce(F.col("signature").rlike(r"(?i)[a-z0-9-]+\.(?:com|net|org|kr|me|ly|gl|io|co)\b"), F.lit(False))


def within_distance(hits: DataFrame, most: float = 0.95) -> DataFrame:
    """Neighbours close enough; adds near_copy for those nearly equal."""
    return hits.filter(F.col("distance") <= most).withColumn("near_copy", F.col("distance") < 0.05)


def filter_diffs(df: DataFrame, kind: str | None = None, source: str | None = None, q: str | None = None) -> DataFrame:
    """Disagreements of one kind and source whose message or reason holds a text."""
    for column, value in (("kind", kind), ("source", source)):
        df = df.filter(F.col(column) == value) if value else df
    return df.filter(F.contains(F.lower("message"), F.lit(q.lower())) | F.contains(F.lower("reason"), F.lit(q.lower()))) if q else df


def by_family(df: DataFrame, tab: str = "ALL") -> DataFrame:
    """ALL rows, those of TRAP or those of MAIN."""
    return df if tab == "ALL" else df.filter(yes("is_trap") if tab == "TRAP" else ~yes("is_trap"))


def by_status(df: DataFrame, status: str, category: str | None = None) -> DataFrame:
    """SPAM, HAM, RED_GROUP, FLAGGED or REVIEW rows (of one review category); other names keep all. Reads is_spam, red_group, flagged, category."""
    review = F.col("category").isNotNull() if category is None else F.coalesce(F.col("category") == category, F.lit(False))
    tests = {"SPAM": yes("is_spam") & ~yes("red_group"), "HAM": ~yes("is_spam") & ~yes("red_group"), "RED_GROUP": yes("red_group"), "FLAGGED": yes("flagged"), "REVIEW": review}
    return df.filter(tests[status]) if status in tests else df


def advanced(df: DataFrame, size=None, bytes_: tuple[int, int] | None = None, codes: list[str] | None = None, url: bool | None = None, signature: bool | None = None, p: tuple[float, float] | None = None, cache: str | None = None) -> DataFrame:
    """Rows that meet all given tests: byte length, code, with or without URL and signature, probability, a tag of the reason."""
    named = ~F.lower(F.trim(F.coalesce("signature", F.lit("")))).isin("", "none", "unextractable")
    linked = F.trim(F.coalesce("url", F.lit(""))) != ""
    tests = [
        bytes_ and size(F.col("message")).between(*bytes_), codes and F.col("code").isin(*codes), None if url is None else linked == url,
        None if signature is None else named == signature, p and F.col("p").between(*p), cache and F.contains("reason", F.lit(cache)),
    ]
    for test in tests:
        if test is not None:
            df = df.filter(test)
    return df


def search_logs(df: DataFrame, q: str, *columns: str) -> DataFrame:
    """Rows that hold a text in one of the columns, whatever its case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(q.lower())), F.lit(False))
    return df.filter(hit)


def examples(df: DataFrame, label: str | None = None, q: str | None = None) -> DataFrame:
    """Examples of one label that hold a text in message or reason."""
    df = df.filter(F.col("label") == label) if label else df
    return search_logs(df, q, "message", "reason") if q else df


def keyword_cases(df: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """Rows that hold a word of some family, with its name; a row of two families comes twice."""
    tests = [F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains("message", w)), name) for name, words in families.items()]
    return df.withColumn("family", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())))
