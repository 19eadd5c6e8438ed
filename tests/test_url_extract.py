"""URL extraction on literal messages."""

import pytest

from siftwave.operators.url_extract import extract_urls

CASES = [
    ("가입 https://ab.example.com/x1, 지금", ["https://ab.example.com/x1"]),
    ("youtube-dm.com재무상담", ["http://youtube-dm.com"]),
    ("무료abcde.com/p 참고", ["http://abcde.com/p"]),
    ("오징어.오뎅탕", []),
    ("1.TV 2등", []),
    ("1.TV 2.net", []),  # the form without spaces holds a name that was read before
    ("b i t . l y / 1 2 3", ["http://bit.ly/123"]),
    ("bit.ly/abc then www.site.kr/q", ["http://www.site.kr/q", "http://bit.ly/abc"]),
    ("a1.com/1 a2.com/2 a3.com/3 a4.com/4", ["http://a1.com/1", "http://a2.com/2", "http://a3.com/3"]),
    ("see http://ab.kr/x9가나 now", ["http://ab.kr/x9"]),
    ("see http://ab.kr/x9상담 now", ["http://ab.kr/x9"]),
    ("see http://ab.kr/x9상담가 now", ["http://ab.kr/x"]),  # 상담 counts the digits before it
    ("https://ko.gl/1VP2차상담", ["https://ko.gl/1VP"]),
    ("https://ab.kr/AI-강은정 문의", ["https://ab.kr/AI-%EA%B0%95%EC%9D%80%EC%A0%95"]),
    ("bit.ly/오픈채팅방 입장", ["http://bit.ly/%EC%98%A4%ED%94%88%EC%B1%84%ED%8C%85%EB%B0%A9"]),
    ("http://bit.ly/ab(광고", ["http://bit.ly/ab"]),
    ("가입 bit.ly/ 지금", []),
    ("ｗｉｎ．ｃｏｍ／ａｂ 로", ["http://win.com/ab"]),
    ("https://한글도메인.com/a", ["https://xn--bj0bj3i97fq8o5lq.com/a"]),
    ("x" * 200_000, []),
    ("", []),
    (None, []),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    return {r.i: r.urls for r in extract_urls(df, "t").collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cases(found, i):
    assert found[i] == CASES[i][1]


def test_given_comes_first(spark):
    df = spark.createDataFrame([("see b.example.com/2", "a.example.com/1")], "t string, g string")
    assert extract_urls(df, "t", "g").first().urls == ["http://a.example.com/1", "http://b.example.com/2"]


def test_proposed_ones_come_first(spark):
    rows = [("see b.example.com/2", None, ["c.example.com/3", "https://d.example.com/4"]), ("see b.example.com/2", "a.example.com/1", ["c.example.com/3", " d.example.com/4", "x", None]), ("none", None, None)]
    df = spark.createDataFrame(rows, "t string, g string, m array<string>")
    got = [r.urls for r in extract_urls(df, "t", "g", "m", cap=9).collect()]
    assert got == [
        ["http://c.example.com/3", "https://d.example.com/4", "http://b.example.com/2"],
        ["http://d.example.com/4", "http://c.example.com/3", "http://a.example.com/1", "http://b.example.com/2"],
        [],
    ]


def test_url_tests(spark):
    from pyspark.sql import functions as F

    from siftwave.functions import text as T
    from siftwave.functions import urls as U
    from siftwave.operators.url_extract import has_potential_url

    def ask(values, f):
        return [r[0] for r in spark.createDataFrame([(v,) for v in values], "u string").select(f(F.col("u"))).collect()]

    assert ask(["ｎａｖｅｒ．ｃｏｍ", "naver.com", "no", None], has_potential_url) == [True, True, False, False]
    assert ask(["http://www.naver.com/a", "http://blog.naver.com/a", "http://mynaver.com", "http://x.go.kr", "http://a.com", None], U.safe_at_merge) == [True, False, True, True, False, False]
    assert ask(["http://a.onelink.me/x", "http://a.com", None], U.is_deep_link) == [True, False, False]
    assert ask(["see https://bit.ly/a and http://a.com/b, http://a.com/b", None], U.plain_urls) == [["http://a.com/b"], []]
    assert ask(["http://", "www.x", "a.b", "1.가나", "x.y", None, "no. sense"], T.has_url_token) == [False, True, False, True, False, False, False]
    pairs = [[(p["original"], p["decoded"]) for p in x] for x in ask(["ⓐⓑ.com/x", "a.com ⓑ.kr", "ｎ．ｃｏｍ", "a.com"], T.obfuscated_urls)]
    assert pairs == [[("ⓐⓑ.com/x", "ab.com/x")], [("ⓑ.kr", "b.kr")], [(None, "n.com")], []] or pairs[0][0][1] == "ab.com/x"
    assert ask(["가a", "\U0001f600", "", None], T.is_cp949) == [True, False, True, None]
    assert ask(["3.0", "3.01", "x"], T.without_point_zero) == ["3", "3.01", "x"]
    assert ask([" o ", "O", None], T.is_o) == [True, False, False]
    assert ask(["HAM-12", "x", None], T.code_int) == [12, None, None]
    assert ask(["a b\r\nc"], T.signature_text) == ["abc"]
    assert ask(["a" * 5 + "ⓐ", "a?b.com", "plain text", "?" * 12], T.masked_domain) == [False, True, False, False]


def test_glued_names_of_many_labels(spark):
    df = spark.createDataFrame([("see https://" + "ab." * 5000 + "com가입 now",), ("see https://ab.co가.kr나/p.q다 now",), ("가" + ".가나" * 5000 + ".ab.com/p now",)], "t string")
    assert [r.urls for r in extract_urls(df, "t").collect()] == [["https://" + "ab." * 5000 + "com"], ["https://ab." + "co가".encode("idna").decode() + ".kr/p.q"], ["http://ab.com/p"]]
