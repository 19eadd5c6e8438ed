"""Scores of op5 against a plain character model over exact grams."""

import math
import random
from collections import Counter


def test_scores_of_exact_grams(spark):
    from siftwave.llm.url_filter import fit, score, with_rule

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(8))
    urls = [rng.choice(["http://a.com/", "http://b.net/es/", "http://c.org/"]) + "/".join(word() for _ in range(6)) for _ in range(900)]
    rows = with_rule(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    grams = lambda u, o: [("\x02" * 4 + u)[i + 5 - o : i + 5] for i in range(len(u))]
    n = {ok: Counter(g for u in urls if head(u) == ok for o in range(1, 6) for g in grams(u, o)) for ok in (True, False)}
    contexts = {ok: Counter() for ok in n}
    for ok, own in n.items():
        for g, k in own.items():
            contexts[ok][len(g), g[:-1]] += k
    p = lambda ok, g: (n[ok][g] + 4 * p(ok, g[1:])) / (contexts[ok][len(g), g[:-1]] + 4) if g else 1 / 128
    known = lambda g: n[True][g] + n[False][g] >= (3 if len(g) > 1 else 1)
    llr = lambda g: next((math.log(p(True, x)) - math.log(p(False, x)) for x in (g[i:] for i in range(5)) if known(x)), 0.0)
    want = {i: sum(map(llr, grams(u, 5))) / len(u) for i, u in enumerate(urls)}
    model = fit(rows.filter("ruled is not null"))
    assert model.count() == sum(known(g) for g in {*n[True], *n[False]})
    for bound in (200_000, 500):
        got = {r["page_id"]: r["score"] for r in score(rows, model, bound).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - s) < 1e-8 for i, s in want.items())


def head(url):
    return {"a": True, "b": False}.get(url[7])
