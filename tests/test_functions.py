from pyspark.sql import functions as F

from siftwave.functions import text as T
from siftwave.functions import urls as U
from siftwave.operators import compare as C
from siftwave.operators import screening as S
from siftwave.operators import windows as W


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("r")).first()["r"]


def test_text(spark):
    assert one(spark, "a　b c", T.strip_space) == "abc"
    assert one(spark, "가나ab", T.approx_bytes) == 6
    assert one(spark, "ⓐＢ①．com？ｘ＝₁", T.deobfuscate) == "aB①.com?x=1"
    assert one(spark, "향.꼼.썽", T.spaced_hangul) == "향.꼼.썽"
    assert one(spark, "plain", T.spaced_hangul) is None
    assert one(spark, "=1+1", T.safe_cell) == "'=1+1"
    assert one(spark, "가나ab", T.hangul_share) == 0.5
    assert one(spark, "가나", T.cp949_bytes()) == 4
    assert one(spark, "\U0001f600", T.cp949_bytes("double")) == 2


def test_urls(spark):
    assert one(spark, "https://WWW.Ex.com:80/a/?q", U.domain_path) == "ex.com/a"
    assert one(spark, None, U.domain_path) == ""
    assert one(spark, "http://1.2.3.4/x", U.is_ip)
    assert one(spark, "https://sub.go.kr/a", U.is_trusted) and not one(spark, "https://blog.naver.com/a", U.is_trusted)
    urls = spark.createDataFrame([(["http://bit.ly/a", "http://x.com/a", "http://y.com", "http://z.com"],)], "u array<string>")
    assert urls.select(U.order_and_cap(F.col("u"))).first()[0] == ["http://x.com/a", "http://y.com", "http://z.com"]
    cut = spark.createDataFrame([(["http://myshop.com", "http://shop.com", "http://a.shop.com"],)], "u array<string>")
    assert cut.select(U.drop_fragments(F.col("u"))).first()[0] == ["http://myshop.com", "http://a.shop.com"]


def test_rules(spark):
    rows = spark.createDataFrame([("hi",), ("",), (None,), ("ⓐ circled message",), ("O0O0 1l1l B5B5",), ("an ordinary message",)], "m string")
    c = F.col("m")
    got = [r[0] for r in rows.select(S.rule_check(c, T.approx_bytes(T.strip_space(c)))["pattern"]).collect()]
    assert got == ["short_message"] * 3 + ["unicode_obfuscation", "alphanumeric_obfuscation", None]


def test_metrics(spark):
    rows = spark.createDataFrame([(50, 0, 0, 50), (0, 25, 25, 0), (60, 10, 10, 20), (0, 0, 0, 0)], "tp long, fn long, fp long, tn long")
    got = C.agreement(rows).collect()
    assert got[0]["kappa"] == got[0]["mcc"] == 1 and got[1]["kappa"] < 0.2 and got[2]["disagreement"] == 0.2 and got[3]["kappa"] == 0


def test_positions(spark):
    df = spark.range(1000).withColumn("v", F.col("id") * 7919 % 1000)
    got = {r["v"]: r["pos"] for r in W.global_position(df, "v", "id").collect()}
    assert got == {v: v + 1 for v in range(1000)}
