"""Brute-force twins and edge cases of the training-data operators."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, key string"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def frame(spark, rows):
    """rows: (doc_id, text); two more columns have names that operators use inside."""
    return spark.createDataFrame([(i, t, "en", None, None, "x", "y") for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "lost id"), (4, "É Ünï 漢字 \x00 tail"), (5, "w " * 5000)]


def test_line_dedup(spark):
    from siftwave.llm.line_dedup import dedup_lines

    rows = ODD + [(100 + i, f"  Same Line\t\nown {i}\n\nsame line") for i in range(12)] + [(200 + i, "rare\nline") for i in range(3)]
    got = {(r["doc_id"], r["text"]): (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in dedup_lines(frame(spark, rows)).collect()}
    assert got[(100, rows[7][1])] == (4, 2, "own 0\n")
    assert got[(200, "rare\nline")] == (2, 0, "rare\nline")
    assert got[(1, "")] == (1, 0, "") and got[(None, "lost id")][1] == 0
    kept = {r["doc_id"]: r["kept_text"] for r in dedup_lines(frame(spark, rows), policy="first").collect()}
    assert kept[100] == "  Same Line\t\nown 0\n" and kept[101] == "own 1\n"
    assert dedup_lines(frame(spark, [])).count() == 0


def test_decontamination(spark):
    from siftwave.llm.decontam import decontaminate

    rng = random.Random(3)
    words = [rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) for _ in range(400)]
    items = [(1, " ".join(words[:20])), (2, "Short Item"), (3, None), (4, "..."), (10, " ".join(words[5:25])), (11, "ab")]
    rows = ODD + [(50, " ".join(words)), (51, "x " * 400 + " ".join(words[3:16])), (52, "a short. ITEM here"), (53, " ".join(words[:12])), (54, "short x item")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    near = {(r["doc_id"], r["n_words"]): r for r in decontaminate(frame(spark, rows), bench).collect()}
    far = {(r["doc_id"], r["n_words"]): r for r in decontaminate(frame(spark, rows), bench, max_bytes=0).collect()}
    assert far == near
    for got, (i, t) in ((g, r) for g in (near, far) for r in rows):
        w = WORD.findall(low(t))
        hit, found = set(), set()
        for item, text in items:
            iw = WORD.findall(low(text))
            n = min(13, len(iw))
            for a in range(len(iw) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == iw[a : a + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(item))
        r = got[(i, len(w))]
        assert (r["n_hit"], r["hit_items"], r["contaminated"]) == (len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    assert not any(r["contaminated"] for r in decontaminate(frame(spark, rows), bench.limit(0)).collect())
    assert decontaminate(frame(spark, []), bench).count() == 0


def test_license_scan(spark, tmp_path):
    from siftwave.llm.licenses import NOTICES, PHRASES, op4_license_scan

    rows = ODD + [(60, "MIT License. the mit, license"), (61, NOTICES["bsd-notice"] + " tail"), (62, "x gnu general public license gnu general"), (63, "cc by cc by-nc"), (64, "nothing here")]
    frame(spark, rows).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["n_words"]): r for r in op4_license_scan(spark, str(tmp_path)).collect()}
    for i, t in rows:
        w = WORD.findall(low(t))
        at = [(p, label) for phrase, label in PHRASES.items() for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        r = got[(i, len(w))]
        assert r["n_base"] == len(at) and r["base_labels"] == ",".join(sorted({x for _, x in at}))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert 0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
    spread = [(70, NOTICES["mit-text"]), (71, " filler ".join(NOTICES["isc-text"].split(" ", 60))), (72, " x y z ".join(NOTICES["zlib-text"].split()))]
    frame(spark, spread).select("doc_id", "text").write.parquet(f"{tmp_path}/more/documents.parquet")
    more = {r["doc_id"]: r["labels"].split(",") for r in op4_license_scan(spark, f"{tmp_path}/more").collect()}
    assert "mit-text" in more[70] and "mit-notice" in more[70] and "zlib-text" not in more[72]
    assert "bsd-notice" in got[(61, len(WORD.findall(low(rows[8][1]))))]["labels"]


def test_url_filter(spark):
    from siftwave.llm.url_filter import RULES, judge

    rng = random.Random(5)
    urls = [f"http://www.shop{i}.com/item/{i}" for i in range(60)] + [f"https://spam{i}.net/es/win{i}" for i in range(60)]
    urls += ["HTTP://Example.COM/en/x?y", "http://www.example.com/en/", "no scheme", None, "", "http://a.org/item/5", "http://b.org/es/win5", "ftp://net/fr/x#z", "http://com", "http://xcom/"]
    rng.shuffle(urls)
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in judge(rows).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = low(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [(len(r), r, v) for v, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, max(fits)[1] if fits else None)
        assert got[i]["verdict"] == (max(fits)[2] if fits else got[i]["verdict"]) and got[i]["verdict"] in ("allow", "block")
    by = {u: got[i]["verdict"] for i, u in enumerate(urls)}
    assert by["http://a.org/item/5"] == "allow" and by["http://b.org/es/win5"] == "block"
    assert judge(rows.limit(0)).count() == 0
    odd = judge(rows.withColumns({"host": F.lit("x"), "score": F.lit(1), "u": F.lit("y")})).collect()
    assert {r["page_id"]: r["verdict"] for r in odd} == {i: r["verdict"] for i, r in got.items()}
    assert by[None] == by[""] == "allow"
    held = [r for r in got.values() if r["held_out"]]
    assert held and all((r["score"] >= r["cut"]) == (r["verdict"] == "allow") for r in held)


def test_ngram_jaccard(spark):
    from siftwave.llm.shingle_join import similar_documents

    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(3, 120))] for _ in range(25)]
    passage = [rng.choice(vocab) for _ in range(40)]
    rows = list(ODD)
    for k in range(260):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((1000 + k, " ".join(w + passage if k % 3 == 0 else w).upper() if k % 2 else "\t".join(w)))
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    for at_least in (2, 5, 1000):
        got = similar_documents(frame(spark, rows), at_least=at_least).collect()
        assert len(got) == len(rows)
        assert all((r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), root(r["doc_id"])) for r in got if r["doc_id"] is not None)
    assert similar_documents(frame(spark, [])).count() == 0


def exact_links(rows):
    """n_links and component of each row (id, vector, label), compared in double precision after exact scaling."""
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, np.float64)
        x = np.ldexp(x, -np.frexp(np.abs(x).max())[1])
        return x / np.linalg.norm(x)

    good = [(k, unit(v), label) for k, (_, v, label) in enumerate(rows) if label is not None]
    good = [g for g in good if g[1] is not None]
    n, comp = [0] * len(rows), list(range(len(rows)))
    for x, (a, u, m) in enumerate(good):
        for b, v, w in good[:x]:
            if m == w and len(u) == len(v) and u @ v >= 0.93:
                n[a] += 1
                n[b] += 1
                comp = [comp[a] if c == comp[b] else c for c in comp]
    least = {c: min((rows[k][0] for k in range(len(rows)) if comp[k] == c and rows[k][0] is not None), default=None) for c in set(comp)}
    return sorted(((rows[k][0], n[k], least[comp[k]]) for k in range(len(rows))), key=repr)


@pytest.mark.parametrize("block", [1024, 16])
def test_cap_filters(spark, block):
    from siftwave.llm.cap_filters import link_vectors

    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 16))
    rows = []
    for i in range(400):
        v = centres[i % 30] + 0.12 * rng.standard_normal(16)
        rows.append((i, [float(np.float32(x)) for x in (centres[0] if i % 10 == 0 else v)], i % 2))
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [1.0, None] * 8, 0), (504, rows[0][1], None), (505, [], 0), (506, [1.0, 2.0], 0)]
    rows += [(600, [1e20, 2e20, 3e20], 5), (601, [1e20, 2e20, 3.05e20], 5), (602, [0.0, -2e-25, 3e-25], 6), (603, [-0.0, -2e-25, 3.1e-25], 6), (604, [1e200, 0.0, 1e200], 7), (605, [1e-200, 0.0, 1.01e-200], 7)]
    rows += [(None, rows[1][1], 1), (None, rows[2][1], 0), (None, [9.0, -9.0, 1.0], 8), (3, rows[4][1], 0), (5, rows[5][1], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, v string, id int")
    want = exact_links(rows)
    got = [tuple(r) for r in link_vectors(df, relevant=300, block=block).collect()]
    assert sorted(((i, n, c) for i, n, c, _ in got), key=repr) == want
    assert all(kept == (i is not None and i == c) for i, _, c, kept in got)
    if block > 16:
        some = link_vectors(df.withColumn("label", F.concat(F.lit("l"), "label"))).collect()
        assert 0.98 * sum(n for _, n, _ in want) <= sum(r["n_links"] for r in some) <= sum(n for _, n, _ in want)
        assert link_vectors(df.limit(0)).count() == 0


CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a\\<s>[INST] b"), (2, 0, "user", "hi"), (2, 1, "assistant", None), (3, 0, "system", "be\n</s>"), (3, 1, "us<er", "x>>\n"),
    (None, 0, None, ""), (4, 0, "user", "hi"), (4, 0, "user", "hi"), (5, 0, "a\x00b", "c"), (6, 0, "a", "b\x00c"), (7, 0, "1:", "x"), (8, 0, "1", ":x"), (9, None, "user", "no turn"),
]


def check_chats(spark, rows):
    """Round trip, the stream without gaps, positions and ancestors of every node against the paths."""
    from siftwave.llm.chat_format import format_chats, read_back

    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, node string, conv string").repartition(4)
    nodes, chats = format_chats(df)
    back = {r["conv_id"]: ([(t["role"], t["text"]) for t in r["turns"]], r["formatted_chars"]) for r in read_back(nodes, chats).collect()}
    out = sorted(nodes.collect(), key=lambda r: r["start"])
    by = {r["node"]: r for r in out}
    paths = {r["conv_id"]: r["path"] for r in chats.collect()}
    for i in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == i))
        assert back[i] == ([(r, x) for *_, r, x in own], sum(by[n]["len"] for n in paths[i]))
    assert len(by) == len(out) == len({tuple(p[: k + 1]) for p in paths.values() for k in range(len(p))})
    assert [r["start"] for r in out] == [sum(x["len"] for x in out[:k]) for k in range(len(out))]  # no gaps, each node once
    for path in paths.values():
        for k, n in enumerate(path):
            covered = [x for a in by[n]["attend"] for x in range(a["start"], a["end"])]
            assert covered == [x for p in path[:k] for x in range(by[p]["start"], by[p]["start"] + by[p]["len"])] and by[n]["position"] == len(covered)
            assert all(a["end"] < b["start"] for a, b in zip(by[n]["attend"], by[n]["attend"][1:], strict=False))
    return out


#: Queries whose SQL this file's fixture doesn't reach, over the smallest tables.
@pytest.mark.parametrize("name", ["op3_decontamination", "op6_ngram_jaccard", "op7_chat_format", "op10_line_dedup"])
def test_same_rows_as_sql(spark, name):
    import duckdb
    from siftwave.llm.registry import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


def test_chat_format(spark):
    out = check_chats(spark, CHATS)
    assert sum(r["segment"] == "<s>[INST] hi [/INST]" and r["depth"] == 0 for r in out) == 1
    assert check_chats(spark, []) == []


def test_chat_tree_with_hot_turns(spark, monkeypatch):
    from siftwave.llm import chat_format

    monkeypatch.setattr(chat_format, "MAX_HOT", 10**9)
    monkeypatch.setattr(chat_format.with_nodes, "__defaults__", (3,))
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant"]) if t else "system", "be kind" if t == 0 else rng.choice("ab")) for c in range(60) for t in range(rng.randint(1, 6))]
    check_chats(spark, rows)


def test_bpe_agrees_with_the_tokenizers_library(spark):
    import public_tokenizers
    from siftwave.llm.bpe import Encoder, chunks, decode, digest, with_tokens
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    parts = ["a", "b ", " ", "  ", "\n", "\n\n", "é", "　", "'s", "12", "<|endoftext|>", "!!", "\x1c", "\x85", "中文", "\U0001f600", "don't", " the"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 150))) for _ in range(400)]
    coder = Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    data = [t.encode() for t in texts]
    cut = list(chunks(data, 16, together=2000))
    assert all(at[0] == 0 and at[-1] == len(d) and b"".join(d[a:b] for a, b in zip(at, at[1:], strict=False)) == d for d, at in zip(data, cut, strict=True))
    assert [next(chunks([d], 16)) for d in data] == cut
    coder.shared = {digest(d[a:b]): f for d, at in zip(data, cut, strict=True) for a, b in zip(at, at[1:], strict=False) if rng.random() < 0.6 and (f := coder.inside(d[a:b]))}
    for t, d, at in zip(texts, data, cut, strict=True):
        ids = coder.encode(d, at)
        assert whole.encode(t, add_special_tokens=False).ids == ids.tolist() and coder.decode(ids) == t
    assert coder.reused > 100
    passage = " ".join(rng.choice("the of house water with from this".split()) for _ in range(400))
    rows = ODD + [(100 + i, f"own {i} {passage} end") for i in range(9)] + [(200, texts[0]), (201, None)]
    for max_shared in (1 << 20, 600, 0):
        out = decode(with_tokens(frame(spark, rows).withColumns({"n_tokens": F.lit("old"), "digest": F.lit(1)}).repartition(3), size=64, max_shared=max_shared)).collect()
        assert len(out) == len(rows)
        assert all(r["decoded"] == (r["text"] or "") and r["n_tokens"] == len(r["ids"]) and r["ids"] == whole.encode(r["text"] or "", add_special_tokens=False).ids for r in out)
    assert with_tokens(frame(spark, [])).count() == 0


def test_bpe_shares_chunks_of_several_documents(spark):
    import public_tokenizers
    from siftwave.llm.bpe import Encoder, chunks, digest, shared_chunks

    rng = random.Random(2)
    passage = " ".join(rng.choice("the of house water with from this".split()) for _ in range(600))
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(40)) + " " + passage) for i in range(6)]
    data = [t.encode() for _, t in rows]
    seen = {}
    for d, at in zip(data, chunks(data, 64), strict=True):
        for c in {d[a:b] for a, b in zip(at, at[1:], strict=False)}:
            seen[c] = seen.get(c, 0) + 1
    coder = Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    both = {digest(c) for c, n in seen.items() if n > 1 and len(c) > 24 and coder.inside(c)}
    got = shared_chunks(frame(spark, rows).repartition(3), "byte_bpe_50k.tiktoken", 64)
    assert set(got) == both and len(both) > 5
    few = shared_chunks(frame(spark, rows).repartition(3), "byte_bpe_50k.tiktoken", 64, max_shared=1500)
    assert set(few) < set(got) and few


def test_bpe_query(spark):
    import public_tokenizers
    import pyarrow.parquet as pq
    from siftwave.llm.bpe import op8_bpe
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    got = op8_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = whole.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        back = whole.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_language_id(spark):
    from siftwave.llm.language_id import fit, identify

    rng = random.Random(4)
    words = {"en": "the and of to house water with from this".split(), "de": "der und das nicht haus wasser mit von ist".split(), "fr": "le et des dans maison eau avec pour une".split()}
    rows = [(i, " ".join(rng.choices(words[x], k=30)), x) for i, x in enumerate(list(words) * 60)] + [(900, None, "en"), (901, "123 !?", None), (None, "the house of water", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = identify(docs, fit(docs)).collect()
    assert all(r["lang_pred"] == r["lang"] for r in got if r["doc_id"] is not None and r["doc_id"] < 900)
    assert {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in got if r["doc_id"] in (900, 901)} == {900: ("und", 0.0), 901: ("und", 0.0)}
    named = identify(docs.withColumns({"judged": F.lit(7), "lang_pred": F.lit("old")}), fit(docs)).collect()
    assert all(r["judged"] == 7 and r["lang_pred"] != "old" for r in named) and identify(docs.limit(0), fit(docs)).count() == 0
    none = identify(docs, fit(docs.limit(0))).collect()
    assert all(r["lang_pred"] == "und" for r in none)


def test_language_scores_do_not_depend_on_the_batch(spark):
    from siftwave.llm.language_id import fit

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit(docs)
    texts = [r["text"] for r in docs.filter("text is not null").select("text").limit(60).collect()] + ["to", "a", "des"]
    alone = [tuple(x[0] for x in model.predict([t])) for t in texts]
    for some in (texts, texts[::-1]):
        together = list(zip(*model.predict(some), strict=True))
        for (lang, share, ahead), (i, s, d) in zip(alone if some is texts else alone[::-1], together, strict=True):
            assert lang == i and abs(share - s) < 1e-9 and abs(ahead - d) < 1e-9


def test_language_query(spark):
    import zlib

    import pyarrow.parquet as pq
    from siftwave.llm.language_id import fit, op1_language_id

    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    got = {r["doc_id"]: r for r in op1_language_id(spark, SF).collect()}
    assert len(got) == len(rows)
    held = {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    assert {i for i, r in got.items() if r["held_out"]} == held and held
    sure = [r for r in rows if r["doc_id"] in held and r["lang"] and r["text"]]
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in sure) >= 0.97 * len(sure)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    model = fit(spark.read.parquet(f"{SF}/documents.parquet"))
    en, fr = (next(r["text"] for r in rows if r["lang"] == x and len(r["text"] or "") > 500)[:400] for x in ("en", "fr"))
    assert model.predict([en + " " + fr])[2][0] < 0.5 < model.predict([en])[2][0]


def test_sharding(spark):
    from siftwave.llm.sharding import lookup_table, place

    shards = [f"s{i}" for i in range(7)]
    table = lookup_table(shards, 1009)
    n = [table.count(i) for i in range(7)]
    assert max(n) - min(n) <= 1
    fewer = lookup_table(shards[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 0.25 * 1009
    assert place(frame(spark, []), shards, 1009).count() == 0
    got = place(frame(spark, ODD).withColumns({"slot": F.lit("x"), "shard": F.lit(0)}), shards, 1009).collect()
    for r in got:
        slot = int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:12], 16) % 1009
        assert (r["slot"], r["shard"]) == (slot, shards[table[slot]])
    with pytest.raises(ValueError):
        lookup_table(shards, 1000)


def test_components(spark):
    from siftwave.llm.components import components

    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(40)]
    comp = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: comp[x] for x in linked}
    assert F is not None
