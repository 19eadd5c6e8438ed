"""Fragments of URLs in the merge."""

from siftwave.operators.merge import url_evidence


def test_fragments(spark):
    rows = [
        (1, "see ko.fm/mK8 and o.fm/mK8", None, "http://o.fm/mK8", "http://ko.fm/mK8, http://o.fm/mK8", None),
        (2, "see ko.fm/mK8 and o.fm/mK8", None, "http://ko.fm/mK8/", "http://ko.fm/mK8, http://o.fm/mK8", None),
        (3, "see blog.ab.com/x and ab.com/x", None, "ab.com/x", "http://blog.ab.com/x, http://ab.com/x", None),
        (4, "nothing", None, None, "none", ["http://ko.fm/mK8", "http://o.fm/mK8"]),
    ]
    df = spark.createDataFrame(rows, "i int, message string, decoded string, given_url string, extracted string, model_urls array<string>")
    got = {r.i: (r.valid_urls, r.drop_reason) for r in url_evidence(df).collect()}
    assert got == {
        1: (["http://ko.fm/mK8"], "fragment_artifact"),
        2: (["http://ko.fm/mK8"], None),
        3: (["http://blog.ab.com/x", "http://ab.com/x"], None),
        4: (["http://ko.fm/mK8", "http://o.fm/mK8"], None),
    }
