"""Candidates of whole texts against a plain double loop."""

import random

from siftwave.operators.spans import best_windows, candidate_spans


def brute(text, longest, k):
    dense, place = "".join(text.split()), [i for i, c in enumerate(text) if not c.isspace()]
    found = {}
    for a in range(len(dense)):
        for b in range(a + 1, len(dense) + 1):
            part = dense[a:b]
            try:
                size = len(part.encode("cp949"))
            except UnicodeEncodeError:
                break
            if size > longest:
                break
            if size >= 4 and place[b - 1] + 1 - place[a] <= 100:
                score = (-3.0 if size <= 8 else 0.0) + (-2.0 if all("0" <= c <= "9" for c in part) else 0.0)
                found.setdefault(part, (-score, -size, part.encode(), a, b))
    best = sorted(found.values(), key=lambda r: r[:3])[:k]
    return [(a, b, place[a], place[b - 1] + 1, -size, -score, part.decode(), text[place[a] : place[b - 1] + 1]) for score, size, part, a, b in best]


def test_candidate_spans(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choices("ab1 2가나\n　😀é", weights=[9, 9, 9, 9, 9, 9, 9, 2, 2, 1, 1], k=rng.randint(0, 80))) for _ in range(60)]
    texts += [None, "", "   ", "a" + " " * 150 + "bcdef", "1234 5678 9012 3456 7890 1234", "x" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    for longest, k in ((20, 5), (40, 3)):
        got = {}
        for r in candidate_spans(df, "id", "body", longest, k).collect():
            got.setdefault(r["id"], []).append(tuple(r)[1:])
        for i, t in enumerate(texts):
            want = brute(t or "", longest, k)
            assert sorted(got.get(i, [])) == sorted(want), (i, t)
    for t in texts:
        if t:
            assert best_windows(t, 20, 5, together=7) == best_windows(t, 20, 5)
