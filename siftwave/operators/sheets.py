"""Review sheets and output tables as tables: row projection, orders, families, dedup sheets, counts.

A result row has message, url, is_spam (null: undecided), red_group, semantic_class, code, p, reason and what else a
function names. Orders are columns with the place of a row from 1, as tables have no order of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwave.functions import reports as R
from siftwave.functions import text as T
from siftwave.functions import urls as U
from siftwave.operators.windows import global_position

#: Fixed names of the output tables.
TABLES = [
    "시뮬결과전체", "육안분석(시뮬결과35_150)", "URL중복 제거", "문자문장차단등록", "문자열중복제거", "문장중복제거",
    "TRAP.시뮬결과전체", "TRAP.육안분석(시뮬결과35_150)", "TRAP.중간작업", "TRAP.URL중복 제거", "TRAP.문자문장차단등록",
    "TRAP.문자열 중복제거", "TRAP.문장 중복제거", "금융.SPAM",
]
FINANCE = "3"


def yes(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def all_results(messages: DataFrame, size) -> DataFrame:
    """message, url, mark (blank), message_len and url_len of all messages; `size` gives the bytes of a text, cells are guarded against formulas."""
    url = F.coalesce("url", F.lit(""))
    return messages.select(T.safe_cell(F.col("message")).alias("message"), T.safe_cell(url).alias("url"), F.lit("").alias("mark"), size(F.col("message")).alias("message_len"), size(url).alias("url_len"))


def sheet_row(df: DataFrame, unknown: str = "UNKNOWN") -> DataFrame:
    """Adds mark (`o`, blank or `unknown`), sheet_code, code_int, url_code, red (O or blank) and counted.

    A red row has no mark but its code, and counts as spam; undecided rows keep their code."""
    red, soft = yes("red_group"), yes(F.col("semantic_class").startswith("Type_B"))
    spam = ~red & (soft | yes("is_spam"))
    ham = ~red & ~spam & F.col("is_spam").eqNullSafe(F.lit(False))
    digits = T.code_digits(F.coalesce("code", F.lit("")))
    out = df.withColumns({
        "mark": F.when(red | ham, "").when(spam, "o").otherwise(unknown),
        "sheet_code": F.when(ham, "").otherwise(digits),
        "url_code": F.when(yes("malicious_url"), T.code_digits(F.coalesce("url_spam_code", F.lit("")))).otherwise(""),
        "red": F.when(red, "O").otherwise(""),
        "counted": red | spam,
    })
    return out.withColumn("code_int", F.col("sheet_code").try_cast("int"))


def finance_rows(sheet: DataFrame) -> DataFrame:
    """The messages of the finance table: rows whose code is that of loans."""
    return sheet.filter(F.col("sheet_code") == FINANCE)


def review_rank(df: DataFrame) -> Column:
    """0 spam, 1 red, 2 ham, 3 others, by the columns of a sheet."""
    cls = F.trim(F.coalesce("semantic_class", F.lit("")))
    typed = cls.startswith("Type_B") | cls.startswith("Type_A") | F.coalesce(F.contains("reason", F.lit("[FP Sentinel Override]")), F.lit(False))
    return F.when(F.upper(F.trim("red")) == "O", 1).when(typed | (F.lower(F.trim("mark")) == "o"), 0).when(F.lower(cls) == "ham", 2).otherwise(3)


def review_sheet(sheet: DataFrame, tie: str) -> DataFrame:
    """Adds place: by rank, rows with a URL first, message, `tie` (a unique column)."""
    bare = F.when(F.trim(F.coalesce("url", F.lit(""))) == "", 1).otherwise(0)
    return global_position(sheet.withColumn("rank", review_rank(sheet)), "rank", bare, F.trim(F.coalesce("message", F.lit(""))), tie, name="place")


def tagged_union(main: DataFrame, trap: DataFrame) -> DataFrame:
    """Both families in one table, told apart by is_trap."""
    return main.withColumn("is_trap", F.lit(False)).unionByName(trap.withColumn("is_trap", F.lit(True)))


def split_families(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.filter(~yes("is_trap")).drop("is_trap"), rows.filter(yes("is_trap")).drop("is_trap")


def merge_url_maps(ordinary: DataFrame, short: DataFrame, key: str) -> DataFrame:
    """One row for each key; rows of `short` win."""
    return ordinary.join(short.select(key).distinct(), key, "left_anti").unionByName(short.select(*ordinary.columns))


def url_sheet(urls: DataFrame, tie: str = "url") -> DataFrame:
    """Adds place: by bytes, then URL."""
    return global_position(urls, "bytes", F.col("url"), tie, name="place")


def signature_sheets(signatures: DataFrame, *family: str) -> DataFrame:
    """Adds place in the sheet of a kind (string: shortest first; sentence: longest first; then text) and `family`.

    Places are taken over all sheets at once and counted from each one's first."""
    keys = [*family, "kind"]
    order = F.when(F.col("kind") == "string", F.col("bytes")).otherwise(-F.col("bytes"))
    rows = global_position(signatures, *keys, order, "signature", name="_at")
    heads = rows.groupBy(*keys).agg(F.min("_at").alias("_head"))
    return rows.join(F.broadcast(heads), keys).withColumn("place", F.col("_at") - F.col("_head") + 1).drop("_at", "_head")


def cluster_view(members: DataFrame, logs: DataFrame, seq: str, cluster: str, spam: str) -> DataFrame:
    """Members of clusters of two or more with their logs, size and spam_cnt, and place: spam count falling, size falling, cluster, seq."""
    rows = logs.join(members.select(seq, cluster), seq)
    sizes = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col(spam)).alias("spam_cnt")).filter("size > 1")
    return global_position(rows.join(sizes, cluster), -F.col("spam_cnt"), -F.col("size"), cluster, seq, name="place")


def validation_order(rows: DataFrame, cluster: str, seq: str) -> DataFrame:
    """Adds place of validated rows (errors, warnings): clusters with most spam first, in them errors, warnings, others. Reads spam, errors, warnings."""
    counts = rows.groupBy(cluster).agg(F.count_if("spam").alias("spam_cnt"))
    grade = F.when(F.col("errors") != "", 0).when(F.col("warnings") != "", 1).otherwise(2)
    return global_position(rows.join(counts, cluster).withColumn("grade", grade), -F.col("spam_cnt"), cluster, "grade", seq, name="place")


def similarity_order(df: DataFrame, text: str, seq: str) -> DataFrame:
    """Adds place by the similarity key of a text, so that like messages stand together."""
    return global_position(df, T.similarity_key(F.col(text)), seq, name="place")


def most_recent(df: DataFrame, ts: str, tie: str, n: int = 30) -> DataFrame:
    """The `n` newest rows; a missing time is the oldest."""
    return df.orderBy(F.col(ts).desc_nulls_last(), F.col(tie).desc()).limit(n)


def example_order(df: DataFrame, by: str, ts: str, text: str, tie: str) -> DataFrame:
    """Adds place: newest, oldest or message."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    keys = {"newest": [at.isNull(), -at], "oldest": [at.isNull(), at], "message": [F.lower(text)]}[by]
    return global_position(df, *keys, tie, name="place")


def page_with_total(df: DataFrame, number: int, size: int, sort: str, allowed: list[str], default: str, tie: str, q: str = "", search: tuple[str, ...] = (), ascending: bool = False) -> DataFrame:
    """One page of the rows that hold `q` in one of the searched columns, and total, the number of all of them."""
    if q:
        hit = F.lit(False)
        for c in search:
            hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(q.lower())), F.lit(False))
        df = df.filter(hit)
    c = F.col(sort if sort in allowed else default)
    rows = df.orderBy(c.asc() if ascending else c.desc(), F.col(tie).asc()).offset((number - 1) * size).limit(size)
    return rows.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("total"))))


def kept_counts(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A summary in which counts that were there and not zero stay."""
    names = [c for c in new.columns if c != key]
    both = old.select(key, *[F.col(c).alias(f"_{c}") for c in names]).join(new, key, "full")
    return both.select(key, *[F.coalesce(F.when(F.col(f"_{c}") != 0, F.col(f"_{c}")), F.col(c), F.lit(0)).alias(c) for c in names])


def duplicate_report(df: DataFrame, key: str, ts: str, id: str) -> DataFrame:
    """Keys with more than one row: rows, the id that stays (newest; a missing time is the oldest) and the ids that go, sorted."""
    first = F.max_by(id, F.struct(F.col(ts).isNotNull(), ts, id)).alias("kept")
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), first, F.array_sort(F.collect_list(id)).alias("_ids")).filter("rows > 1")
    return g.select(key, "rows", "kept", F.array_remove("_ids", F.col("kept")).alias("gone"))


def output_tables(results: DataFrame, size) -> dict[str, DataFrame]:
    """The named tables of both families from results with is_trap, signature and kind; a family without rows gives empty tables with their columns."""
    sheet = sheet_row(results, unknown="")
    main, trap = split_families(sheet)
    out: dict[str, DataFrame] = {}
    cells = ["message", "url", "mark", "code_int", "p", "semantic_class", "reason", "red"]
    for rows, names in ((main, TABLES[:2] + TABLES[2:6]), (trap, TABLES[6:8] + TABLES[9:13])):
        kept = rows.filter("counted")
        urls = kept.filter(F.coalesce("url", F.lit("")) != "").groupBy(U.domain_path(F.col("url")).alias("key")).agg(F.min_by(F.struct("url", "code_int"), "id").alias("f")).select("f.url", size(F.col("f.url")).alias("bytes"), "f.code_int", U.is_short(F.col("f.url")).alias("short"))
        signed = kept.filter(~F.lower(F.coalesce("signature", F.lit(""))).isin("", "none", "unextractable")).withColumn("bytes", size(F.col("signature")))
        block = signed.select("message", "signature", "bytes", "kind", "code_int")
        once = signed.groupBy("signature", "kind").agg(F.min_by(F.struct("bytes", "code_int"), "id").alias("f")).select("signature", "kind", "f.*")
        frames = [all_results(rows, size), rows.select(*cells), urls, block, once.filter("kind = 'string'").drop("kind"), once.filter("kind = 'sentence'").drop("kind")]
        out |= dict(zip(names, frames, strict=True))
    text = lambda k: F.when(F.col("kind") == k, F.col("signature"))
    out[TABLES[8]] = trap.filter("counted").select("message", "url", text("string").alias("string"), text("sentence").alias("sentence"), "code_int")
    out[TABLES[13]] = finance_rows(sheet).select("message")
    return {name: out[name] for name in TABLES}


def export_diffs(diffs: DataFrame) -> DataFrame:
    """Display columns of disagreements: id, message, human, machine, status, reason, with cells guarded."""
    human = F.when(yes("human_spam"), "SPAM").otherwise("HAM")
    return diffs.select("id", T.safe_cell(F.col("message")).alias("message"), human.alias("human"), R.diff_label(F.col("machine_spam"), F.col("reason")).alias("machine"), R.status_label(F.col("status")).alias("status"), T.safe_cell(F.coalesce("reason", F.lit(""))).alias("reason"))
