"""Registered queries over small tables of odd rows: the same rows as their SQL."""

import random
import re
import time
import tracemalloc
from difflib import SequenceMatcher
from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from siftwave.functions import text as T
from siftwave.operators import clusters as K
from siftwave.operators import filters as X
from siftwave.operators import similar as N
from siftwave.operators import tables as B
from siftwave.operators.scoring import score_batches
from siftwave.operators.spans import best_windows
from siftwave.plans import reports, sheets, state, texts  # noqa: F401  (add their queries)
from siftwave.plans.registry import ORACLES, QUERIES


def same_rows(spark, folder, name, **tables):
    """The rows of a query over tables of (schema, rows), which must be those of its SQL."""
    con = duckdb.connect()
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    df, rel = QUERIES[name](spark, str(folder)), con.sql(ORACLES[name])
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(rel.select(*cols).fetchall(), key=repr)
    return got


def documents(*texts):
    return "doc_id long, text string, lang string, source string, n_chars long", [(i, t, "en", "src1", len(t or "")) for i, t in texts]


def test_fitted_signatures_judge_blocks_by_their_front(spark, tmp_path):
    lacking = "Ç" * 100 + "plain words of enough bytes for a sentence and more"
    docs = documents((2, lacking), (5, "Ç" * 20 + "abc" * 30), (8, "short(광고)" + lacking), (11, "x" * 60), (14, None))
    got = same_rows(spark, tmp_path, "fitted_signatures", documents=docs)
    assert {r[2]: r[1] for r in got} == {2: "unextractable", 5: "use_sentence", 8: "unextractable", 11: "use_sentence", 14: "unextractable"}


def test_extracted_urls_keep_the_order_of_shorteners(spark, tmp_path):
    docs = documents((1, "streets a.\nTo the.\nTo an esea.\nTo here"), (2, "see bit.ly/abc then www.site.org/q"), (3, "go http://bit.ly/ or http://bit.ly/ab*c"), (4, None))
    got = dict((r[0], r[2]) for r in same_rows(spark, tmp_path, "extracted_urls", documents=docs))
    assert got[2] == "http://bit.ly/abc http://www.site.org/q"


def test_extracted_urls_of_names_of_many_labels(spark, tmp_path):
    """Thousands of labels in a row, which took the stack of a task and with it the executor; labels too long, schemes without a name."""
    docs = documents((1, "ab. " * 9000), (2, "ab." * 9000 + "com"), (3, "a." * 40_000 + "b"), (4, "x" * 70 + ".com/p"), (5, "xhttps://" + "y" * 70 + ".net"), (6, "http: //a.b. see http://c.de/f"))
    got = dict((r[0], r[2]) for r in same_rows(spark, tmp_path, "extracted_urls", documents=docs))
    assert got[2] == "http://" + "ab." * 9000 + "com" and got[4] == "http://" + "x" * 63 + ".com/p"


def test_common_signature_by_reach(spark):
    """Members only tell how far each place of the shortest one reaches in them; clusters in slices give the same."""
    r, alphabet = random.Random(3), "ab1é가漢"
    member = lambda core: "".join(r.choice(alphabet) for _ in range(r.randrange(30))) + core + "".join(r.choice(alphabet) for _ in range(r.randrange(30)))
    rows = []
    for c in range(60):
        core = "".join(r.choice(alphabet) for _ in range(r.randrange(4, 40)))
        rows += [(str(c), member(core)) for _ in range(r.randrange(1, 9))]
    rows += [("", ""), ("", "x" * 50), ("same", "a" * 30), ("same", "a" * 30)]
    groups = {}
    for c, b in rows:
        groups.setdefault(c, set()).add(b)
    size = lambda t: sum(1 + (ord(x) > 127) for x in t)
    want = {}
    for c, texts_ in groups.items():
        lead = min(texts_, key=len)
        parts = {lead[i:j] for i in range(len(lead)) for j in range(i + 5, min(i + 20, len(lead)) + 1)}
        good = [p for p in parts if 9 <= size(p) <= 20 and all(p in t for t in texts_)]
        want[c] = max(good, key=lambda p: (size(p), p), default=None)
    df = spark.createDataFrame(rows, "c string, b string")
    hot = K.HOT
    for K.HOT in (hot, 3):
        assert {x["c"]: x["signature"] for x in K.common_signature(df, "c", "b", T.approx_bytes).collect()} == want
    K.HOT = hot
    for _ in range(200):
        a, b = member("core of both"), member("core of both")
        reach = np.minimum(np.arange(len(a), 0, -1), 20)
        longest = [max((n for n in range(5, k + 1) if a[i : i + n] in b), default=0) for i, k in enumerate(reach)]
        assert K.narrowed(K.codes_of(a), K.codes_of(b), reach, 5).tolist() == longest


def test_bitmaps_of_short_texts_spare_no_similar_pair():
    """Bitmaps and bags bound what SequenceMatcher may find, and tell most unlike texts of one language apart."""
    r = random.Random(11)
    parts, spared, unlike = ["th", "e", "ing", "er", "on", "sta", "ha", "re", "."], 0, 0
    text = lambda: "".join(r.choice(parts) for _ in range(r.randrange(8, 26)))
    bits = lambda a, b, q: sum(int(v).bit_count() for v in (K.bitmap(K.codes_of(a), q) ^ K.bitmap(K.codes_of(b), q)).view(np.uint64))
    for _ in range(3000):
        a = text()
        b = "".join(c if r.random() > 0.06 else r.choice("xyz") for c in a) if r.random() < 0.5 else text()
        n, common, alike = len(a) + len(b), SequenceMatcher(None, a, b).ratio(), True
        for q, need in ((1, 0.85 * n / 2), (2, 0.85 * n / 2 - 0.15 * n - 1)):
            bound = (n - 2 * (q - 1) - bits(a, b, q)) / 2
            assert K.common_grams(a, b, q) <= bound
            alike = alike and bound >= need - 1e-9
            if common >= 0.85:
                assert K.common_grams(a, b, q) >= need - 1e-9
        assert alike or common < 0.85
        unlike, spared = unlike + (common < 0.85), spared + (not alike)
    assert spared > 0.9 * unlike


def test_few_probes_are_looked_up_in_messages(spark, monkeypatch):
    """No row for each character of a message; stretches end anywhere."""
    messages = ["", "abc가나다", "x" * 40 + "needle" + "y" * 9, "needle", "nee", "dle", None]
    logs = spark.createDataFrame(list(enumerate(messages)), "id long, message string")
    probes = spark.createDataFrame([("needle",), ("가나",), ("needley",), ("needledle",)], "probe string")
    out = X.probe_logs(logs, probes)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in out.collect()} == {("needle", 2), ("가나", 1), ("needley", 2), ("needledle", None)}
    batch = pa.RecordBatch.from_pydict({"id": list(range(6)), "message": messages[:6]})
    for stretch in (1, 3, 7, 44, 1000):
        monkeypatch.setattr(X, "STRETCH", stretch)
        got = [tuple(r.values()) for b in X.held_keys(SimpleNamespace(value=["needle", "가나", "dle", ""]))(iter([batch])) for r in b.to_pylist()]
        want = [(i, k) for i, t in enumerate(messages[:6]) for k in ("needle", "가나", "dle", "") if k in t]
        assert sorted(got) == sorted(want)


def test_best_windows_of_long_texts():
    """Work follows the text, not its windows (about 0.35 microseconds a character here; sorting all windows took 4.6)."""
    r = random.Random(2)
    text = "".join(r.choices("abcdefgh 123가나\n", k=600_000))
    best_windows(text[:100])
    at = time.process_time()
    found = best_windows(text)
    assert time.process_time() - at < 1.2
    dense = "".join(text.split())
    size = lambda t: sum(1 + (ord(x) > 127) for x in t)
    every = {w for i in range(len(dense)) if dense[i] == "1" for j in range(i + 10, i + 21) if size(w := dense[i:j]) == 20 and not w.isdigit()}
    assert [f[6] for f in found] == sorted(every)[:5]


def test_memory_of_neighbours_is_bounded_by_slices(spark):
    """The cells of a large batch are computed in slices, however many pivots there are, and with the same rows."""
    r = np.random.default_rng(1)
    vectors, pivots = r.normal(size=(6000, 8)), N.unit(pa.array(r.normal(size=(1500, 8)).tolist()), 8)
    made = []
    df = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda v: SimpleNamespace(value=v))))
    df.select = lambda *_: SimpleNamespace(mapInArrow=lambda f, _: made.append(f))
    N.cells(df, pivots)
    N.visits(df, pivots, np.full(1500, 4), np.full(1500, 0.2), 3)
    batch = pa.RecordBatch.from_pydict({"id": np.arange(6000), "v": vectors.tolist(), "bound": np.where(np.arange(6000) % 2, 0.05, np.nan)})
    rows = []
    for f in made:
        tracemalloc.start()
        rows.append([x for b in f(iter([batch])) for x in zip(b["id"].to_pylist(), b["cell"].to_pylist(), strict=True)])
        assert tracemalloc.get_traced_memory()[1] < 110e6  # 72 MB for all angles alone, several times
        tracemalloc.stop()
    far = N.angles(N.unit(batch["v"], 8), pivots)
    assert [c for _, c in rows[0]] == far.argmin(axis=1).tolist()
    assert len({i for i, _ in rows[1]}) >= 3000


def test_scorers_get_no_more_than_their_batch(spark, monkeypatch):
    """A part of Arrow rows becomes Python objects a batch at a time."""
    seen = []

    class Rows:
        def __init__(self, part):
            self.part, self.schema = part, part.schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return [r for b in run(iter([self.part])) for r in b.to_pylist()]

    def scorer(rows):
        seen.append(len(rows))
        if (rows["message"] == "bad").any():
            raise ValueError("unreadable")
        return pd.DataFrame({"good": rows["message"].str.len() > 2, "reason": "scored"})

    df = spark.createDataFrame([(i, "bad" if i == 7 else "x" * i) for i in range(10)], "seq long, message string")
    rows = Rows(pa.RecordBatch.from_pylist([r.asDict() for r in df.collect()]))
    rows.schema = df.schema
    got = score_batches(rows, scorer, "good boolean, reason string", batch=4)
    assert max(seen) == 4 and [r["seq"] for r in got] == list(range(10))
    assert [r["good"] for r in got] == [None if i == 7 else i > 2 for i in range(10)] and got[7]["reason"] == "ValueError: unreadable"


def test_signature_errors_search_urls_near_the_signature(spark):
    """Only stretches of a text that hold the signature are searched for URLs, so long ones cost little; the errors are those of whole texts."""
    url = re.compile(r"(?:https?://|www\.)?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,6}[A-Za-z0-9@:%_+.~#?&/=-]*")
    r, rows = random.Random(8), []
    for i in range(400):
        body = "".join(r.choice(["abc", ".com", "http://", "www.", "/", "가", ",", "x-1", "?q=", ".k", "."]) for _ in range(r.randrange(1, 14)))
        at = r.randrange(len(body))
        rows.append((i, body, body[at : at + r.randrange(1, 12)]))
    rows.append((400, ("x" * 62 + "." + "1" * 40 + ",") * 4000 + "win.example.com", "win.example.com"))
    df = spark.createDataFrame(rows, "id long, body string, sig string")
    error = B.signature_error(F.col("body"), F.col("sig"), F.lit("use_string"), T.approx_bytes(F.col("sig")))
    got = {x["id"]: x["e"] == "bare_domain" for x in df.select("id", error.alias("e")).collect()}
    want = {i: any(s in u for u in url.findall(b)) and bool(re.search("^(https?://)?[^/?#]+/?$", s)) for i, b, s in rows}
    assert got == want and 20 < sum(want.values()) < 380


def test_signature_scores_shuffle_nothing(spark, tmp_path):
    docs = documents((1, "call 010-1234-5678 or 080-123-4567 now"), (2, None), (3, ""), (4, "a b c"), (5, "code12 code12 ★ zzzzzz"), (6, "x" * 50_000))
    got = {r[0]: r[1:] for r in same_rows(spark, tmp_path, "signature_scores", documents=docs)}
    assert got[2][0] == got[4][0] == 0 and got[5][0] >= 2
    assert "Exchange" not in QUERIES["signature_scores"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
