"""Machine verdicts against human ones: occurrence join, confusion matrix, agreement metrics, daily roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwave.functions.urls import is_ip
from siftwave.operators.windows import global_position, sums_before
from siftwave.sources.files import scratch


#: Fixed names of the bands of agreement, from the top, with their lower bounds; and of the tags of disagreements.
PRIMARY = ((0.75, "협업 가능"), (0.65, "모니터링 필요"), (-9.0, "개선 필요"))
KAPPA = ((0.75, "우수한 일치"), (0.60, "상당한 일치"), (0.40, "중간 수준"), (-9.0, "미흡"))
HEI = ((0.85, "인간 대체 가능"), (0.75, "보조적 대체"), (-9.0, "검토 필요"))
AMBIGUOUS_HUMAN, POLICY_DIFFERENCE, OVER_BLOCKING, FALSE_ALARM = "애매한 사람 판단", "정책 차이", "과차단 (보수적 정책)", "키워드 기반 오탐"


def occurrence_index(df: DataFrame, key: str, order: str, large: int = 100_000) -> DataFrame:
    """Adds occ, the place of a row among those of its key, from 1.

    Most keys stand once: one aggregate finds them, with their row, and only rows of repeated keys are ranked. A key of up to `large` rows is
    ranked in one task; larger ones are cut by range partitions (see sums_before)."""
    rest = [c for c in df.columns if c != key]
    groups = scratch(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*rest)).alias("_row")), "key-groups")
    single = groups.filter("_n = 1").select(key, "_row.*", F.lit(1).cast("long").alias("occ")).select(*df.columns, "occ")

    def rows_of(repeated: DataFrame) -> DataFrame:
        return df.join(repeated.select(F.col(key).alias("_key")), F.col(key).eqNullSafe(F.col("_key")), "left_semi")

    place = F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long")
    out = single.unionByName(rows_of(groups.filter(F.col("_n").between(2, large))).withColumn("occ", place))
    if groups.filter(F.col("_n") > large).take(1):
        out = out.unionByName(sums_before(rows_of(groups.filter(F.col("_n") > large)), key, order, _before=F.lit(1)).withColumn("occ", F.col("_before") + 1).drop("_before"))
    return out


def occurrence_join(human: DataFrame, machine: DataFrame, key: str = "key", order: str = "id") -> DataFrame:
    """Full outer join of n-th occurrences of a key. Both sides: id, key, is_spam. Adds side: both, left or right."""
    h = occurrence_index(human, key, order).select(key, "occ", F.col(order).alias("human_id"), F.col("is_spam").alias("human_spam"))
    m = occurrence_index(machine, key, order).select(key, "occ", F.col(order).alias("machine_id"), F.col("is_spam").alias("machine_spam"))
    side = F.when(F.col("machine_id").isNull(), "left").when(F.col("human_id").isNull(), "right").otherwise("both")
    return h.join(m, [key, "occ"], "full_outer").withColumn("side", side)


def confusion(df: DataFrame, *keys: str) -> DataFrame:
    h, m = (F.coalesce(F.col(c), F.lit(False)) for c in ("human_spam", "machine_spam"))
    n = lambda c, a: F.count(F.when(c, 1)).alias(a)
    return df.filter("side = 'both'").groupBy(*keys).agg(n(h & m, "tp"), n(h & ~m, "fn"), n(~h & m, "fp"), n(~h & ~m, "tn"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def agreement(df: DataFrame) -> DataFrame:
    """Metrics of tp, fn, fp, tn; all are 0 where they aren't defined."""
    tp, fn, fp, tn = (F.col(c).cast("double") for c in ("tp", "fn", "fp", "tn"))
    n = tp + fn + fp + tn
    precision, recall, po = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tp + tn, n)
    pe = ratio(tp + fn, n) * ratio(tp + fp, n) + ratio(fp + tn, n) * ratio(fn + tn, n)
    kappa = F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(F.lit(0.0))
    mcc = ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    out = df.withColumns({"precision": precision, "recall": recall, "f1": ratio(2 * precision * recall, precision + recall), "accuracy": po, "kappa": kappa, "mcc": mcc, "disagreement": ratio(fp + fn, n), "fn_rate": ratio(fn, tp + fn), "fp_rate": ratio(fp, fp + tn)})
    out = out.withColumn("hei", 0.4 * F.col("recall") + 0.3 * (1 - F.col("fn_rate")) + 0.3 * F.col("kappa"))
    band = lambda c, *steps: F.coalesce(*[F.when(F.col(c) >= at, name) for at, name in steps])
    bands = {"status": band("kappa", *PRIMARY), "kappa_status": band("kappa", *KAPPA), "hei_status": band("hei", *HEI)}
    kpi = (F.col("fp_rate") < 0.01) & (F.col("recall") >= 0.95) & (F.col("accuracy") >= 0.90) & (F.col("kappa") >= 0.8)
    rounded = {c: F.round(c, 4) for c in ("precision", "recall", "f1", "accuracy", "kappa", "mcc", "disagreement", "fn_rate", "fp_rate", "hei")}
    return out.withColumns({**bands, "kpi_pass": kpi}).withColumns(rounded)


def daily_trend(files: DataFrame) -> DataFrame:
    """Per-file matrices (date, source, tp, fn, fp, tn) summed by day; metrics are computed from the sums."""
    sums = files.groupBy("date").agg(*[F.sum(c).alias(c) for c in ("tp", "fn", "fp", "tn")], F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return agreement(sums)


def day_totals(files: DataFrame) -> DataFrame:
    """Matrices of each date and source, and of each date with the source `all`."""
    sets = [[F.col("date"), F.col("source")], [F.col("date")]]
    sums = files.groupingSets(sets, "date", "source").agg(*[F.sum(c).alias(c) for c in ("tp", "fn", "fp", "tn")])
    return sums.withColumn("source", F.coalesce("source", F.lit("all")))


def policy_tag(kind: Column, machine_reason: Column, human_reason: Column) -> Column:
    vague = F.lower(human_reason).rlike("애매|모호|불명확|ambiguous")
    careful = F.lower(machine_reason).rlike("suspicious|promotional|commercial|의심|홍보|광고")
    return F.when(kind == "FN", F.when(vague, AMBIGUOUS_HUMAN).otherwise(POLICY_DIFFERENCE)).when(kind == "FP", F.when(careful, OVER_BLOCKING).otherwise(FALSE_ALARM))


def comparison_summary(human: DataFrame, machine: DataFrame, joined: DataFrame) -> DataFrame:
    """One row of counts and rates: totals, spam counts and rates of both sides, matched rows, match and agreement rate; rates of nothing are 0."""
    side = lambda df, name: df.agg(F.count(F.lit(1)).alias(f"total_{name}"), F.count_if("is_spam").alias(f"{name}_spam"))
    h, m = F.coalesce("human_spam", F.lit(False)), F.coalesce("machine_spam", F.lit(False))
    both = joined.filter("side = 'both'").agg(F.count(F.lit(1)).alias("matched"), F.count_if(h == m).alias("same"))
    rows = side(human, "human").join(F.broadcast(side(machine, "machine"))).join(F.broadcast(both))
    rates = {"human_spam_rate": ("human_spam", "total_human"), "machine_spam_rate": ("machine_spam", "total_machine"), "match_rate": ("matched", "total_human"), "agreement_rate": ("same", "matched")}
    return rows.withColumns({name: ratio(F.col(a), F.col(b)) for name, (a, b) in rates.items()}).drop("same")


def human_rows(joined: DataFrame) -> DataFrame:
    """All human rows, matched and missing, with match_status (MATCH, FN, FP, MISSING_IN_LLM), and place, in the order of the human file."""
    h, m = F.coalesce("human_spam", F.lit(False)), F.coalesce("machine_spam", F.lit(False))
    status = F.when(F.col("side") == "left", "MISSING_IN_LLM").when(h == m, "MATCH").when(h, "FN").otherwise("FP")
    return global_position(joined.filter("side <> 'right'").withColumn("match_status", status), "human_id", name="place")


def validation_counts(rows: DataFrame) -> DataFrame:
    """checked, mismatches, errors, warnings and missing signatures of validated rows (errors and warnings are comma lists)."""
    has = lambda c, name: F.array_contains(F.split(c, ","), name)
    there = ~has("errors", "unmatched")
    return rows.agg(
        F.count_if(there).alias("checked"), F.count_if(there & (has("errors", "verdict") | has("errors", "signature"))).alias("mismatches"),
        F.count_if(F.col("errors") != "").alias("errors"), F.count_if((F.col("errors") == "") & (F.col("warnings") != "")).alias("warnings"), F.count_if(F.coalesce("sig", F.lit("")) == "").alias("no_signature"),
    )


def report_stats(logs: DataFrame) -> DataFrame:
    """total, skip, and of the others spam, ham, overrides, url_spam and the number of URLs a model found. Reads code, is_spam, reason, class, url_spam, model_urls."""
    skip = F.coalesce(F.col("code") == "SKIP", F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False)) & ~skip
    override = F.contains("reason", F.lit("Override")) | F.col("class").startswith("Type_B")
    return logs.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(skip).alias("skip"), F.count_if(yes(F.col("is_spam"))).alias("spam"), F.count_if(~skip & ~F.coalesce("is_spam", F.lit(False))).alias("ham"),
        F.count_if(yes(override)).alias("overrides"), F.count_if(yes(F.col("url_spam"))).alias("url_spam"), F.coalesce(F.sum(F.when(~skip, F.coalesce(F.size("model_urls"), F.lit(0)))), F.lit(0)).alias("model_urls"),
    )


def validate_report(logs: DataFrame, sheet: DataFrame) -> DataFrame:
    """Report logs (id, key, is_spam, sig, bytes, url, red, drop_url) against sheet rows (key, pos, sheet_spam, sheet_sig, sheet_url, sheet_red).

    One row a log with sig and its errors and warnings as comma lists. The last sheet row of a key counts. Logs without
    one have `unmatched` alone among the sheet's errors."""
    last = sheet.groupBy("key").agg(F.max_by(F.struct("sheet_spam", "sheet_sig", "sheet_url", "sheet_red", F.lit(True).alias("there")), "pos").alias("s"))
    rows = logs.join(last, "key", "left")
    no = F.lit(False)
    spam, sig, there = F.coalesce("is_spam", no), F.coalesce("sig", F.lit("")), F.col("s.there").isNotNull()
    red, url = F.coalesce("red", no), F.coalesce("url", F.lit(""))
    errors = {
        "unmatched": ~there,
        "signature_missing": spam & (sig == "") & (url == ""),
        "signature_length": (sig != "") & ~(F.col("bytes").between(9, 20) | F.col("bytes").between(39, 40)),
        "url_ip": is_ip(F.col("url")),
        "url": there & (url != F.coalesce("s.sheet_url", F.lit(""))),
        "verdict": there & (spam != F.coalesce("s.sheet_spam", no)),
        "signature": there & (sig != F.coalesce("s.sheet_sig", F.lit(""))),
        "red": there & (red != F.coalesce("s.sheet_red", no)),
    }
    warnings = {"red_dropped": red & F.coalesce("drop_url", no)}
    listed = lambda tests: F.concat_ws(",", *[F.when(c, name) for name, c in tests.items()])
    return rows.select("id", "sig", listed(errors).alias("errors"), listed(warnings).alias("warnings"))
