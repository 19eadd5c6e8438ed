"""File sources and sinks, and streaming counters, over small files."""

import json

import pytest
from pyspark.sql import functions as F

from siftwave.operators import tables as B
from siftwave.sources import files as D
from siftwave.streaming import counters as K


def test_scan_messages_decodes_each_file(spark, tmp_path):
    (tmp_path / "kisa_20260107_A.txt").write_bytes("안녕 하세요\thttp://a.kr/1\n \n  bare\t\nlast".encode("cp949"))
    (tmp_path / "trap_20260108_B.txt").write_bytes("무료 상담\tb.kr\n".encode())
    (tmp_path / "other_20260109.txt").write_bytes(b"caf\xe9\xff\n")
    rows = {tuple(r)[1:] for r in D.scan_messages(spark, str(tmp_path)).collect()}
    assert rows == {
        ("MAIN", "20260107_A", "안녕 하세요", "http://a.kr/1"), ("MAIN", "20260107_A", "bare", ""), ("MAIN", "20260107_A", "last", ""),
        ("TRAP", "20260108_B", "무료 상담", "b.kr"), ("MAIN", "20260109", "café\xff", ""),
    }


def test_scan_reports(spark, tmp_path):
    log = {"message": "m", "excel_row_number": 7}
    (tmp_path / "a.json").write_text(json.dumps({"logs": [log, None, {"message": "n"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"logs": {"0": {"message": "o"}}}))
    (tmp_path / "c.json").write_text("{broken")
    good, bad = D.scan_reports(spark, str(tmp_path), "message string, excel_row_number int")
    assert sorted((r.key, r.log.message) for r in good.collect()) == [(0, "o"), (2, "n"), (5, "m")]
    assert [r.file[-6:] for r in bad.collect()] == ["c.json"]


def test_sinks_round_trip(spark, tmp_path):
    logs = spark.createDataFrame([(1, "FN", "a\nb"), (2, "FP", "c")], "id int, kind string, message string")
    D.write_report(logs, str(tmp_path / "r"), "day 1/x")
    back = spark.read.json(str(tmp_path / "r"))
    assert back.count() == 2 and {r.report for r in back.select("report").collect()} == {"day_1_x"}
    assert D.list_files(spark, str(tmp_path / "r")).count() >= 1
    D.write_tables({"all": logs, "none": logs.limit(0)}, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/none")).columns == logs.columns
    D.export_text(logs, str(tmp_path / "e"), "FN")
    assert [r.value for r in spark.read.text(str(tmp_path / "e")).collect()] == ["a b"]


def test_word_list_and_names(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# c\nBIT.ly\n x.yz \n\nx.yz\n")
    assert sorted(map(tuple, D.word_list(spark, str(tmp_path / "l.txt"), ["bit.ly"]).collect())) == [("bit.ly", "builtin"), ("x.yz", "list")]
    r = spark.createDataFrame([("report_20260101_A.json",), ("none.json",)], "n string").select(D.date_and_source(F.col("n")).alias("d")).collect()
    assert tuple(r[0].d) == ("20260101", "A") and r[1].d is None


@pytest.mark.parametrize("n, parts", [(0, 0), (1, 1), (1000, 1), (1001, 2), (1800, 2), (1801, 3)])
def test_chunks_cover_the_text(spark, n, parts):
    text = "".join(chr(97 + i % 26) for i in range(n))
    rows = [r.text for r in D.chunks(spark.createDataFrame([(text,), (None,)], "text string"), "text").orderBy("chunk").collect()]
    assert len(rows) == parts and "".join([*rows[:1], *[r[200:] for r in rows[1:]]]) == text


def test_signature_errors(spark):
    rows = [("call http://ab.example.com now", "ab.example.com", "use_string", "bare_domain"), ("see ab.example.com/x1 now", "ab.example.com/x1", "use_string", None), ("abcdefghij", "zz", "use_string", "absent"), ("abcdefghij", "abc", "use_string", "short"), ("(광고)abcdefghij", "(광고)abc", "use_string", "forbidden"), ("x", None, "unextractable", None), ("x", "x", None, "decision"), ("x", None, "use_string", "empty")]
    df = spark.createDataFrame(rows, "body string, sig string, decision string, want string")
    assert df.filter(~B.signature_error(F.col("body"), F.col("sig"), F.col("decision"), F.octet_length("sig")).eqNullSafe(F.col("want"))).collect() == []


def stream(spark, tmp_path, schema, batches):
    src = tmp_path / "in"
    src.mkdir()
    for i, rows in enumerate(batches):
        (src / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        import os
        os.utime(src / f"{i}.json", (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))


def final(df, spark, tmp_path, name, key):
    q = df.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = {}
    for r in spark.table(name).collect():
        rows.setdefault(r[key], []).append(tuple(r))
    return rows


def test_hold_counts_stream(spark, tmp_path):
    df = stream(spark, tmp_path, "k string", [[{"k": "a"}] * 6 + [{"k": "b"}], [{"k": "a"}] * 4])
    rows = final(K.hold_counts(df, "k"), spark, tmp_path, "holds", "k")
    assert rows == {"a": [("a", 6, False), ("a", 10, True)], "b": [("b", 1, False)]}


def test_three_strikes_stream(spark, tmp_path):
    row = lambda k, seq, failed: {"k": k, "seq": seq, "failed": failed}
    first = [row("a", 1, True), row("a", 2, True), row("b", 1, True), row("b", 2, False), row("c", 1, True)]
    df = stream(spark, tmp_path, "k string, seq long, failed boolean", [first, [row("a", 3, True), row("a", 4, False), row("b", 3, True), row("b", 4, True)]])
    rows = final(K.three_strikes(df, "k", "failed"), spark, tmp_path, "strikes", "k")
    assert {k: v[-1] for k, v in rows.items()} == {"a": ("a", 4, 3, "blocked"), "b": ("b", 4, 1, "open"), "c": ("c", 1, 1, "trying")}


def test_tables_by_name_and_csv(spark, tmp_path):
    from siftwave.sources.files import dump_csv, find_table

    tables = {"Sheet1": ["a"], "Sheet2": ["b"], "Result": ["message", "gubun"]}
    assert find_table(tables, "Result", "x") == "Result" and find_table(tables, "none", "gubun") == "Result" and find_table(tables, "none", "x") == "Sheet2"
    assert find_table({"Sheet1": ["a"]}, "none", "x") == "Sheet1" and find_table({}, "none", "x") is None
    rows = [(1, 'a "b", c'), (2, "x\ny"), (3, None)]
    dump_csv(spark.createDataFrame(rows, "id int, t string"), f"{tmp_path}/csv")
    back = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(f"{tmp_path}/csv", schema="id int, t string")
    assert sorted(map(tuple, back.collect())) == rows


def test_parts_of_a_batch(spark):
    from siftwave.streaming.sinks import parts_of

    df = spark.range(4501).withColumnRenamed("id", "seq").repartition(7)
    sizes, seen = [], []
    for part in parts_of(df, "seq"):
        own = sorted(r["seq"] for r in part.collect())
        sizes.append(len(own))
        seen += own
    assert sizes == [2000, 2000, 501] and seen == list(range(4501))
    assert list(parts_of(df.limit(0), "seq")) == []
