"""Report columns, URL helpers, clusters and fitted signatures against plain Python."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from siftwave.functions import reports as R
from siftwave.functions import urls as U
from siftwave.operators import clusters as K
from siftwave.operators import signature_fit as G
from siftwave.plans import texts


def one(spark, f, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(f(*map(F.col, names)).alias("r")).first()["r"]


def test_keys_and_reasons(spark):
    assert one(spark, R.message_key, "[Web발신] (광고) Ｈｉ, 안녕 하세요!") == "Hi안녕하세요"
    assert one(spark, R.message_key, "★ ☆") == "★☆" and one(spark, R.message_key, None) == ""
    assert one(spark, R.code_description, "HAM-1") == "응답/알림/명세서" and one(spark, R.code_description, "9") == "기타" and one(spark, R.code_description, None) == "기타"
    assert one(spark, lambda r: R.reason_steps(r, F.lit(False)), "x | [a] | b | [c]") == ["[a]", "[c]"]
    assert one(spark, lambda r: R.reason_steps(r, F.lit(False)), None) == ["content verdict kept"]
    assert one(spark, lambda r: R.backfilled_red(F.lit(None).cast("boolean"), r), R.SEPARATED + "]") is True
    assert one(spark, lambda r: R.backfilled_red(F.lit(None).cast("boolean"), r), None) is False
    assert one(spark, R.date_label, "20260107_A") == "1/7(수)" and one(spark, R.date_label, "20269999") == "20269999"
    assert one(spark, lambda r: R.pick_reason(r, F.array(F.lit("a"), F.lit("b")), F.lit("M")), "") == "a | b"
    assert one(spark, lambda r: R.pick_reason(r, F.lit(None).cast("array<string>"), F.lit("M")), None) == "M Analysis"


def test_payloads(spark):
    assert one(spark, R.payload, 'so\n```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, R.payload, 'x {"a": {"b": 2}} y') == '{"a": {"b": 2}}'
    assert one(spark, R.payload, "none {") is None and one(spark, R.payload, None) is None
    assert one(spark, R.content_text, '[{"type": "text", "text": "a"}, "b"]') == "ab" and one(spark, R.content_text, "plain") == "plain"
    assert one(spark, R.clean_summary, "**Label**\nLoan / lure / call") == "Loan / lure / call"
    assert one(spark, R.clean_summary, "Header\nLoan / lure / call") == "Loan / lure / call"


def test_signature_span(spark):
    got = one(spark, R.signature_span, "say A b\nC* now", "abc*")
    assert (got.start, got.text) == (5, "A b\nC*")
    assert one(spark, R.signature_span, "abc", "x") is None and one(spark, R.signature_span, "abc", "") is None


def test_url_helpers(spark):
    assert one(spark, U.to_ascii_host, "http://한글.com/x") == "xn--bj0bj06e.com" and one(spark, U.to_unicode_host, "xn--bj0bj06e.com") == "한글.com"
    assert one(spark, U.to_ascii_host, "http://a.com") == "a.com"
    assert one(spark, U.retries, "http://ab.com/xy★go", "see") == ["http://ab.com/xy"]
    assert one(spark, U.retries, "http://12ab.com/x", "go http://12ab.com/x yz w (now") == ["http://12ab.com/xyz", "http://12ab.com/xyzw", "http://ab.com/x"]
    assert one(spark, lambda u, t: U.in_message(u, t), "http://www.ab.com/x", "go A b.com") is True
    assert one(spark, lambda u, t: U.in_message(u, t), "http://1.2.3.4/x", "1.2.3.4") is False
    assert one(spark, U.subscribers, "https://t.me/x", "구독자 1.5만명 모임") == 15000
    assert one(spark, U.subscribers, "https://t.me/x", "구독자 30% 할인") in (-1, 3) and one(spark, U.subscribers, "https://x.com", "구독자 5명") == -1
    assert one(spark, U.page_text, "<p>a&amp;b</p><script>x<y</script> c") == "a&b c"
    assert one(spark, U.split_list, " a.com ,,b.com") == ["a.com", "b.com"]


def greedy(rows, share):
    """Leaders in order; each text joins the first similar one."""
    leaders, out = [], {}
    for seq, norm in rows:
        if not norm:
            continue
        able = [(lead, text) for lead, text in leaders if 2 * min(len(text), len(norm)) >= share * (len(text) + len(norm)) - 1e-9]
        own = next((lead for lead, text in able if text == norm or SequenceMatcher(None, text, norm).ratio() >= share), None)
        if own is None:
            leaders.append((seq, norm))
            own = seq
        out[seq] = own
    sizes = {}
    for lead in out.values():
        sizes[lead] = sizes.get(lead, 0) + 1
    return {(s, lead, sizes[lead]) for s, lead in out.items() if sizes[lead] > 1}


def test_leader_clusters_equal_the_greedy_scan(spark):
    r = random.Random(3)
    base = ["".join(r.choice("abcdefgh") for _ in range(r.choice([1, 3, 7, 8, 9, 12, 20, 40]))) for _ in range(40)]
    rows = []
    for i in range(300):
        s = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            at = r.randrange(len(s) + 1)
            s[at : at + r.choice([0, 1])] = r.choice(["", "a", "z"])
        rows.append((i, "".join(s)))
    rows += [(300, None), (301, " "), (302, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {tuple(x) for x in K.leader_clusters(df, "id", "text").collect()}
    assert got == greedy([(i, "".join((t or "").split())) for i, t in rows], 0.85)
    assert K.leader_clusters(df.limit(0), "id", "text").collect() == []


def test_blocks_start_from_rare_characters():
    r = random.Random(11)
    for n in (199, 200, 350, 900):
        for letters in ("ab", "etaoinshrdlu", "".join(map(chr, range(97, 123))) + "가나다라마바사0123456789"):
            body = "".join(r.choice(letters) for _ in range(n))
            other = "".join(r.choice([c, c, c, c, c, c, c, "", r.choice(letters)]) for c in body)
            for x, y in ((body, other), (other, body), ("zz" + body, other)):
                blocks = [b for b in SequenceMatcher(None, x, y).get_matching_blocks() if b.size]
                assert len(blocks) <= 1 + (K.rare_places(K.codes_of(y)) if len(y) >= K.SEEDED else len(y))
                matched = sum(b.size for b in blocks)
                for q in (3, *K.LONG_GRAMS):
                    assert K.common_grams(x, y, q) >= matched - (q - 1) * len(blocks)


def test_leader_clusters_of_long_texts(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz가나다0123456789") for _ in range(r.randrange(2, 9))) for _ in range(150)]
    rows = []
    while len(rows) < 150:
        t = r.choice(rows)[1] if rows and r.random() < 0.6 else "".join(r.choice(words) for _ in range(r.randrange(5, 90)))
        s = list(t)
        for _ in range(int(len(s) * r.choice([0, 0.01, 0.05, 0.08, 0.12]))):
            at = r.randrange(len(s))
            s[at : at + r.choice([0, 1])] = r.choice(["", "q", "가"])
        rows.append((len(rows), "".join(s)))
    df = spark.createDataFrame(rows, "id long, text string")
    want = greedy(rows, 0.85)
    assert len(want) > 60
    hot = K.HOT
    for K.HOT in (hot, 3):  # frequent grams in slices
        assert {tuple(x) for x in K.leader_clusters(df, "id", "text").collect()} == want
    K.HOT = hot


def test_message_clusters(spark):
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect()
    want = greedy([(x["doc_id"], "".join((x["text"] or "").split())) for x in rows], 0.85)
    assert {tuple(x) for x in texts.message_clusters(spark, d).collect()} == want


def test_fitted_signatures_keep_to_the_policy(spark):
    r = random.Random(5)
    size = lambda t: len(t.encode("cp949", "replace"))
    rows = []
    for i in range(2000):
        body = "".join(r.choice(["가", "나", "a", "b", "(광고)", "1", "é", "漢"]) for _ in range(r.randrange(90)))
        at = r.randrange(len(body) + 1)
        rows.append((i, body, r.choice([body[at : at + r.randrange(45)], "없는 글", body[at : at + 44] + "Z"]), r.choice(["use_string", "use_sentence", "unextractable"])))
    rows += [(2000, "abcdefghijklmnop", "f g", "use_string"), (2001, "짧은글", "", "unextractable"), (2002, None, None, None), (2003, "ab" * 30, "", "use_string"), (2004, "abcdef", "abc", "use_string"), (2005, "a" * 10 + "가" * 30, "a", "use_sentence")]
    df = spark.createDataFrame(rows, "id long, body string, signature string, decision string").repartition(3)
    got = {x["id"]: x for x in G.fit_signatures(df, "body", "signature", "decision").collect()}
    assert len(got) == len(rows)
    for i, body, given, asked in rows[:2000]:
        x = got[i]
        decision, signature = x["fitted_decision"], x["fitted_signature"]
        assert size(signature) == x["fitted_bytes"] and (signature in body or signature == given)
        if decision == "use_sentence" and signature:
            assert 39 <= size(signature) <= 40
        if asked == "use_string" and given and given in body:
            assert decision == "use_string" and size(signature) <= 20 and (size(signature) >= 9 or signature == body)
            assert given in signature or signature in given
        if decision == "unextractable":
            assert signature in ("", given)
    fit = lambda i: (got[i]["fitted_decision"], got[i]["fitted_signature"], got[i]["fitted_bytes"])
    assert fit(2000) == ("use_string", "bcdefghij", 9) and fit(2001) == ("unextractable", "", 0) and fit(2002) == ("unextractable", "", 0)
    assert fit(2003) == ("use_sentence", "ab" * 20, 40) and fit(2004) == ("use_string", "abcdef", 6) and fit(2005) == ("use_sentence", "a" * 10 + "가" * 15, 40)
    assert G.fit_signatures(df.limit(0), "body", "signature", "decision").collect() == []
