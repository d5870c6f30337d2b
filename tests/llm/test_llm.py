"""The training-data operators against brute force, exact round trips and held-out labels, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from foldstone.llm import chatformat, decontam, graph, hnsw, langid, linededup, mixing, pii, quality, simhash, urlfilter
from foldstone.llm import queries as q

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, fp long, host string, copies int"


def docs_of(spark, rows):
    """Rows of (doc_id, text, lang, source) with extra columns whose names clash with what operators add."""
    return spark.createDataFrame([(i, t, g, s, len(t or ""), 1, 1.0, 1, "h", 1) for i, t, g, s in rows], DOCS)


ODD = [(1, None, "en", "a"), (2, "", "en", None), (3, "the same text of words here", "en", "a"), (3, "the same text of words here", "en", "a"), (4, "the same text of words here", None, "a"), (None, "text without id", "en", "b"), (5, "12 34 %%", "en", "b"), (6, "long " * 50_000, "en", "b"), (7, "x", "en", "c"), (8, "line\nline\n\nline", "en", "c")]


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"select doc_id, text, lang, source from '{SF}/documents.parquet' order by doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.sql(q.SQL[name])
    df = q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str)


# ---- 1

def test_hnsw_recall(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(3000, 24))
    v[500:900] = v[500]  # a group of copies
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    index, shards = hnsw.build_index(df, id_col="vec_id", vector_col="embedding", shard_rows=1000)
    got = defaultdict(list)
    for r in hnsw.search(index, shards, df.where("vec_id % 20 = 0"), id_col="vec_id", vector_col="embedding").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for i in range(0, 3000, 20):
        s = v @ v[i]
        best = sorted((-s[j], j) for j in range(3000) if j != i)[:20]
        mine = [j for _, j, _ in sorted(got[i])]
        assert len(mine) == 20 and i not in mine
        hits += len({j for _, j in best} & set(mine))
        for _, j, score in got[i]:
            assert score == pytest.approx(s[j], rel=1e-12)
    assert hits / (150 * 20) > 0.9
    assert [j for _, j, _ in sorted(got[500])] == list(range(501, 521))


def test_hnsw_edges(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0, 3.0]), (8, []), (9, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("dim", F.lit(2))
    index, shards = hnsw.build_index(df, id_col="vec_id", vector_col="embedding")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in hnsw.search(index, shards, df.where("vec_id = 0 or vec_id = 7"), id_col="vec_id", vector_col="embedding").collect()]
    assert sorted(got) == [(0, 1, 9, 2.0), (0, 2, 1, 1.0)]
    none = df.where("vec_id = 99")
    index, shards = hnsw.build_index(none, id_col="vec_id", vector_col="embedding")
    assert hnsw.search(index, shards, none, id_col="vec_id", vector_col="embedding").count() == 0


# ---- 2

def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def test_pii(spark):
    text = ["card 4111 1111 1111 1111.", "again 4111-1111-1111-1111 and 4111111111111111", "DE89370400440532013000", "on 1984-02-29 or 31.12.1999 or 02/30/2001", "+1 (262) 555-7240", "ip 29.217.126.147", "a.b7@mail.example.com", "4111111111111112 999.1.1.1 v2.0", None, "", "clean words"]
    df = docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(text)]).withColumn("findings", F.lit(1))
    got = {r["doc_id"]: r for r in pii.pseudonymise(df, key="k").collect()}
    out = [got[i]["text"] for i in range(len(text))]
    card = re.sub(r"\D", "", out[0])
    assert luhn(card) and card != "4" + "1" * 15 and re.fullmatch(r"card 4\d{3} \d{4} \d{4} \d{4}\.", out[0])
    assert [re.sub(r"\D", "", x) for x in out[1].replace("again ", "").split(" and ")] == [card, card]
    assert int("".join(str(int(c, 36)) for c in out[2][4:] + out[2][:4])) % 97 == 1 and out[2] != text[2]
    assert out[3].endswith("02/30/2001") and out[3] != text[3] and re.match(r"on \d{4}-\d\d-\d\d or \d\d\.\d\d\.\d{4}", out[3])
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", out[4]) and out[4] != text[4]
    assert all(int(x) < 256 for x in out[5][3:].split(".")) and out[5] != text[5]
    assert re.fullmatch(r"[a-z]\.[a-z]\d@mail\.example\.com", out[6]) and out[6] != text[6]
    assert out[7:] == text[7:] and all(not got[i]["findings"] for i in range(7, 11))
    assert pii.pseudonymise(df.where("doc_id < 0"), key="k").count() == 0


def test_pii_beside_other_numbers(spark):
    card, iban = "4111 1111 1111 1111", "BE68 5390 0754 7034"
    text = [f"{card} 12/27", f"{card} 123", "4111-1111-1111-1111 04/29", f"{iban} VISA", f"12 {card}", "1984-02-29 1999-11", "4111 1111 1111 1112 12/27", card, iban]
    got = {r["doc_id"]: r for r in pii.pseudonymise(docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(text)]), key="k").collect()}
    out = [got[i]["text"] for i in range(len(text))]
    assert out[:2] == [f"{out[7]} 12/27", f"{out[7]} 123"] and out[2] == out[7].replace(" ", "-") + " 04/29" and out[3] == f"{out[8]} VISA" and out[4] == f"12 {out[7]}"
    assert out[5] != text[5] and out[5].endswith(" 1999-11") and out[6] == text[6] and out[7] != card and out[8] != iban
    assert [[f["kind"] for f in got[i]["findings"]] for i in range(7)] == [["card"]] * 3 + [["iban"], ["card"], ["iso"], []]


def test_permutations_are_bijective(spark):
    n = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("s"), "id")
    out = n.select(pii.permute(F.col("s"), "k", "t").alias("p"), pii.permute_number(F.col("id"), 25, 40, "k", "t").alias("n")).agg(F.countDistinct("p"), F.countDistinct("n"), F.min("n"), F.max("n")).first()
    assert tuple(out) == (1000, 1000, 0, 999)


# ---- 3

def test_decontamination(spark):
    bench = [(1, "A train from Berlin travels 120 km in 3 hours towards the northern coast, how fast does it go?"), (2, "Short one."), (3, None), (4, "Completely different question about the colour of autumn leaves in parks."), (4, "Completely different question about the colour of autumn leaves in parks.")]
    b = spark.createDataFrame(bench, "item_id long, text string").withColumn("hash", F.lit(1))
    rows = [(1, "Start. " + bench[0][1] + " End."), (2, "before a TRAIN FROM BERLIN TRAVELS 120 KM IN 3 HOURS TOWARDS THE NORTHERN COAST, HOW FAST DOES IT GO? after"), (3, "A train from Madrid travels 250 km in 5 hours towards the northern coast, how fast does it go?"), (4, "A train is nice and the northern coast is far."), (5, None), (6, ""), (7, "word " * 20_000 + bench[3][1]), (7, "word " * 10)]
    d = docs_of(spark, [(i, t, "en", "s") for i, t in rows])
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(d, b).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (7, 4)}
    wide = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(d, b, most_broadcast=0).collect()}
    assert wide == got
    kept = decontam.decontaminate(d, decontam.leaks(d, b))
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6]
    assert decontam.leaks(d.where("doc_id < 0"), b).count() == decontam.leaks(d, b.where("item_id < 0")).count() == 0


def test_decontamination_names_at_the_start(spark):
    b = spark.createDataFrame([(1, "Tom has 12 apples. Anna has 5 pears. Ben has 7 plums. How many fruits do they have?")], "item_id long, text string")
    rows = ["Sara has 31 apples. Mike has 4 pears. Lisa has 19 plums. How many fruits do they have?", "Sara has 31 apples. Mike has 4 pears. We met at noon and went home."]
    d = docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(rows)])
    for most in (2_000_000, 0):
        assert [(r["doc_id"], r["item_id"]) for r in decontam.leaks(d, b, most_broadcast=most).collect()] == [(0, 1)]


def test_decontamination_dense_in_numbers(spark):
    bench = ["What is 17 + 25?", "Solve 3x + 5 = 20", "Compute 12 * 7 - 30 / 5", "Ann runs 5 km. Bob runs 7 km. Carl runs 9 km. Who runs most?", "Why?", None]
    b = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    rows = [*(f"Some text before it. {x} And some text after it." for x in bench[:4]), "Dora runs 15 km. Emil runs 27 km. Fred runs 19 km. Who runs most?", "What is 17 + 26? Solve 3x + 6 = 20", "Dora runs 15 km, and 27 km. Why?"]
    d = docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(rows)])
    for most in (2_000_000, 0):
        assert sorted((r["doc_id"], r["item_id"]) for r in decontam.leaks(d, b, most_broadcast=most).collect()) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 3)]
    assert sorted(r["item_id"] for r in decontam.without_windows(b).collect()) == [4, 5]


def test_decontamination_against_brute_force(spark, documents):
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    words = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    want = {(i, k) for k, t in items for i, d, *_ in documents if f" {words(t)} " in f" {words(d)} "}
    assert {(r["doc_id"], r["item_id"]) for r in q.op3(spark, SF).collect()} == want and want


# ---- 4

def test_chat(spark):
    rows = [(1, 1, "assistant", "b <|im_end|> & &lt; \\"), (1, 0, "user", "a\nb<"), (2, 0, "user", None), (2, 0, "user", None), (3, 0, "assi\nstant<|", "x"), (None, None, None, "z"), (4, 0, "assistant", "é" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = {r["conv_id"]: r for r in chatformat.format_chat(df).withColumn("turns", chatformat.read_back(F.col("formatted"))).collect()}
    assert [tuple(t) for t in out[1]["turns"]] == [("user", "a\nb<"), ("assistant", "b <|im_end|> & &lt; \\")]
    assert [tuple(t) for t in out[2]["turns"]] == [("user", ""), ("user", "")]
    assert [tuple(t) for t in out[3]["turns"]] == [("assi\nstant<|", "x")] and [tuple(t) for t in out[None]["turns"]] == [("", "z")]
    got = {r["conv_id"]: r for r in chatformat.digest(chatformat.format_chat(df)).collect()}
    assert got[4]["loss_chars"] == 100_000 and got[4]["loss_sha256"] == hashlib.sha256(("é" * 100_000).encode()).hexdigest()
    assert chatformat.format_chat(df.where("conv_id = 9")).count() == 0


def test_chat_parts(spark):
    part = chatformat.PART
    rows = [(1, 0, "user", [("text", "look", None, None, None, None, None), ("image", None, "img://1", 28, 30, None, None), ("text", "<|image|>", None, None, None, None, None), ("audio", None, "snd://2", None, None, 2.0, None)]), (1, 1, "assistant", [("document", None, "doc://3", None, None, None, 2)]), (2, 0, "user", None), (2, 1, "user", [None])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")
    out = {r["conv_id"]: r for r in chatformat.format_chat(df, parts_col="parts").collect()}
    r = out[1]
    assert [(a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", "img://1", 6), ("audio", "snd://2", 50), ("document", "doc://3", 1024)] and r["expanded_tokens"] == 1080
    for a in r["attachments"]:
        assert r["formatted"][a["at"] :].startswith(f"<|{a['kind']}|>")
    assert r["formatted"].count("<|image|>") == 1 and len(out[2]["attachments"]) == 0


# ---- 5

def test_urls(spark):
    urls = ["http://a.b.example.NET/en/x?q", "http://example.net/de/", "x://example.com/de/", "http://org/fr/", "nothing", None, "", "http://net", "http://net/?a", "http://net:80/", "http://notnet/", "a://b.net/x://c", "http://EXAMPLE.org/fr", "http://" + "a." * 5000 + "net/" + "p/" * 5000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("h")).withColumn("rule", F.lit(1))
    got = [(r["rule"], r["verdict"]) for r in urlfilter.judge(df, urlfilter.rule_table(spark, q.URL_RULES)).orderBy("page_id").collect()]
    assert got == [("example.net/en/", "allow"), ("net/", "block"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("net/", "block"), (None, "allow"), (None, "allow"), ("net/", "block"), (None, "allow"), ("net/", "block")]
    assert urlfilter.judge(df, urlfilter.rule_table(spark, q.URL_RULES), most_broadcast=0).where("verdict = 'block'").count() == 5
    assert urlfilter.judge(df.where("page_id < 0"), urlfilter.rule_table(spark, q.URL_RULES)).count() == 0


# ---- 6

def test_quality(spark, documents):
    got = {r["doc_id"]: r for r in q.op6(spark, "/root/testdata/sf0.01").collect()}
    marks = duckdb.sql("select doc_id, quality from '/root/testdata/sf0.01/labels.parquet'").fetchall()
    held = [(got[i]["predicted"], y) for i, y in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in marks)
    assert np.mean([a == b for a, b in held]) > 0.95
    m = quality.fit(["good words here", "%%% ###"] * 20, [1, 0] * 20)
    odd = quality.score(docs_of(spark, ODD), m).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.fit([], []).score("x") == pytest.approx(0.5)


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.1, rng.normal(size=quality.WORDS + quality.DENSE), rng.normal(size=(quality.WORDS + quality.DENSE, 4)), np.zeros(quality.DENSE), np.ones(quality.DENSE))
    at, x = m.encode("some words and some more words")
    pairs = sum(float(m.v[a] @ m.v[b]) * x[i] * x[j] for i, a in enumerate(at) for j, b in enumerate(at) if i < j)
    assert m.raw(at, x) == pytest.approx(m.bias + float(m.w[at] @ x) + pairs)


# ---- 7

def test_lines(spark):
    rows = [(i, f"own {i}\nMenu \nMenu", "en", "site") for i in range(20)] + [(50 + i, "Menu\nx", "en", None) for i in range(3)] + ODD
    got = {r["doc_id"]: r for r in linededup.dedup_lines(docs_of(spark, rows), max_ratio=0.5).collect()}
    assert got[0]["text"] == "own 0" and got[0]["dropped_lines"] == 2 and got[50]["text"] == "Menu\nx" and got[1]["text"] is None
    again = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs_of(spark, rows), max_ratio=0.5, most_broadcast=0).collect()}
    assert again == {k: r["text"] for k, r in got.items()}
    assert linededup.dedup_lines(docs_of(spark, rows).where("doc_id < 0")).count() == 0


# ---- 8

def test_language(spark):
    rows = {r["doc_id"]: r for r in q.op8(spark, "/root/testdata/sf0.01").collect()}
    truth = duckdb.sql("select doc_id, lang from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    held = [rows[i]["lang_pred"] == g for i, g in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean(held) > 0.95 and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    model = langid.fit(docs_of(spark, [(1, "the cat sat on the mat " * 300, "en", "a"), (2, "der hund und die katze " * 300, "de", "a")]), text_col="text", lang_col="lang", id_col="doc_id")
    odd = langid.predict(docs_of(spark, ODD), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in odd if r["doc_id"] in (1, 2, 5)} == {1: "und", 2: "und", 5: "und"} and len(odd) == len(ODD)
    lang, share, _ = model.infer("the cat sat on the mat " * 6 + "der hund und die katze " * 4)
    assert lang == "en" and 0.4 < share < 0.8
    empty = langid.fit(docs_of(spark, ODD).where("doc_id < 0"), text_col="text", lang_col="lang", id_col="doc_id")
    assert empty.infer("words") == ("und", 0.0, 1.0)


# ---- 9

def test_mixing(spark, documents):
    rows = [(i, "w " * (1 + i % 9), "en", f"s{i % 5}") for i in range(400)] + [(900, "w " * 30, "en", None)] + ODD
    got = mixing.mix(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    size = {}
    for r in got:
        size.setdefault(r["source"], [0, 0, 0])
        size[r["source"]][0] += r["size"]
        size[r["source"]][1] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    target = {r["source"]: r["target"] for r in got}
    want = {s: 0.0 for s in size}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    left, open_ = 1.5 * sum(v[0] for v in size.values()), {s for s in size if size[s][0]}
    while True:  # the definition, step by step
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s][0]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 2.0 * size[s][0]
            left -= want[s]
        open_ -= over
    assert target == pytest.approx(want)
    assert all(abs(v[1] - target[s]) <= 0.6 * max(r["size"] for r in got if r["source"] == s) for s, v in size.items())
    key = lambda rs: sorted((str(r["doc_id"]), r["taken"]) for r in rs)
    assert key(mixing.mix(docs_of(spark, rows[::-1]).repartition(7)).collect()) == key(got)
    assert key(mixing.mix(docs_of(spark, rows), most_broadcast=0).collect()) == key(got)
    assert mixing.mix(docs_of(spark, ODD).where("doc_id < 0")).count() == 0


# ---- 10

def brute_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def union_find(pairs):
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return find


def test_simhash_brute_force(spark):
    got = q.op10(spark, "/root/testdata/sf0.01").collect()
    texts = dict(duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall())
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    find = union_find([(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{f:016x}", find(i)) for i, f in fps.items()}


def test_simhash_edges_and_chain(spark):
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.simhash_components(docs_of(spark, ODD)).collect())
    assert got == Counter([(1, 1), (2, 1), (3, 3), (3, 3), (4, 3), (None, None), (5, 5), (6, 6), (7, 7), (8, 8)])
    base = 0x1234_5678_9ABC_DEF0
    chain = [base ^ ((1 << (2 * k)) - 1) for k in range(20)] + [base ^ (0xFFFF << 40)]  # 2 bits a step
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in chain]
    fps = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    linked = {r["node"]: r["root"] for r in graph.components(simhash.links_within_two(fps)).collect()}
    assert len({linked[f] for f in signed[:20]}) == 1 and signed[20] not in linked
    assert simhash.simhash_components(docs_of(spark, ODD).where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("radius", [2, 5])
def test_covering_guarantee(radius):
    rng, masks = random.Random(4), simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(500):
        x = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(x & m & (2**64 - 1) == 0 for m in masks)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 6000 + i) for i in range(300)]
    find = union_find(edges)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1] or any(x in f and f[0] != f[1] for f in edges)}


def test_near_duplicates(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [[word() for _ in range(200)] for _ in range(10)]
    rows = []
    for k, b in enumerate(base):
        rows.append((100 * k, " ".join(b)))
        for c in range(1, 8):
            edited = list(b)
            edited[rng.randrange(200)] = word()
            edited[rng.randrange(200)] = word()
            rows.append((100 * k + c, " ".join(edited)))
        rows.append((100 * k + 50, "  ".join(b).upper()))
    docs = docs_of(spark, [(i, t, "en", "s") for i, t in rows] + [(9003, "the same text of words here", "en", "a")] * 2)
    groups = simhash.near_duplicates(docs)
    found = {r["doc_id"]: r["component_id"] for r in groups.collect()}
    assert np.mean([found[i] == i // 100 * 100 for i, _ in rows if i >= 100]) > 0.95
    kept = simhash.keep_one(docs, groups).collect()
    assert len([r for r in kept if r["doc_id"] == 9003]) == 1 and len({r["doc_id"] for r in kept}) == len(kept)


def test_near_duplicates_of_all_kinds_of_edits(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    pairs = []
    for _ in range(40):
        b = [word() for _ in range(rng.randrange(100, 600))]
        short = [word() for _ in range(rng.randrange(10, 31))]
        pairs += [(b, b + [word() for _ in range(int(len(b) * rng.uniform(0.12, 0.25)))]), (b, b[: int(len(b) * rng.uniform(0.8, 0.9))]), (short, short + [word() for _ in range(rng.randrange(1, 5))])]
    family = [word() for _ in range(300)]
    rows = [(2 * k + c, " ".join(t)) for k, pair in enumerate(pairs) for c, t in enumerate(pair)] + [(1000 + k, " ".join(family + [word() for _ in range(30)])) for k in range(80)]
    sets = {i: set(zip(*[t.split()[k:] for k in range(5)])) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    find = union_find(links)
    in_link = {x for e in links for x in e}
    want = {i: find(i) if i in in_link else i for i in sets}
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs_of(spark, [(i, t, "en", "s") for i, t in rows])).collect()}
    assert len(links) > 3000 and found == want


def test_prefix_join_deals_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_HOT", 8)
    same = " ".join(f"w{k}" for k in range(60))
    rows = [(i, f"{same} x{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "raw long, text string").withColumn("text", F.col("text").cast("binary"))
    pairs = lambda root: {(r["a"], r["b"]) for r in simhash.prefix_pairs(docs, spark.createDataFrame([(i, i, root(i)) for i, _ in rows], "raw long, node long, root long"), width=5, similarity=0.8).collect()}
    assert pairs(lambda i: i) == {(a, b) for a in range(60) for b in range(a + 1, 60)}
    assert pairs(lambda i: i % 2) == {(a, b) for a in range(60) for b in range(a + 1, 60) if (a + b) % 2}
    assert pairs(lambda i: 0) == set()


def test_near_duplicates_keep_other_texts_of_an_id(spark):
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(30))
    rows = [(1, text(0)), (1, text(1)), (2, text(1)), (None, text(1)), (None, text(2)), (None, text(2)), (3, text(3)), (3, text(3)), (4, text(3) + " more")]
    docs = docs_of(spark, [(i, t, "en", "s") for i, t in rows])
    kept = Counter((r["doc_id"], r["text"]) for r in simhash.keep_one(docs, simhash.near_duplicates(docs)).collect())
    assert kept == Counter([(1, text(0)), (1, text(1)), (None, text(2)), (3, text(3))])
    assert simhash.keep_one(docs.where("doc_id > 9"), simhash.near_duplicates(docs.where("doc_id > 9"))).count() == 0


def test_near_duplicates_of_a_large_family(spark):
    """Pairs grow with the members of a family, not with their square."""
    n = 20_000
    docs = spark.range(n).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 60), k -> concat('w', k)), concat('x', id), concat('y', id * 7)) as text")
    groups = simhash.near_duplicates(docs)
    assert groups.where("component_id = 0").count() == n and simhash.keep_one(docs, groups).count() == 1


def test_near_dedup_keeps_its_driver_small(spark, monkeypatch):
    """No table goes to all tasks beyond the limit, and a few long texts are sampled like many short ones."""
    docs = docs_of(spark, [(i, " ".join(f"w{j}" for j in range(60)) + f" x{i // 2 * 2} {'y' * (i % 2)}", "en", "s") for i in range(40)] + [(50, "alone in here", "en", "s")])
    kept = lambda: sorted(r["doc_id"] for r in simhash.keep_one(docs, simhash.near_duplicates(docs)).collect())
    monkeypatch.setattr(simhash, "_MOST_BROADCAST", 0)
    monkeypatch.setattr(F, "broadcast", lambda df: pytest.fail("sent whole") if df.count() else df)
    assert kept() == [0, 50]
    monkeypatch.setattr(simhash, "_SAMPLE", 10_000)
    monkeypatch.setattr(simhash, "_MOST_COUNTED", 25)
    long = spark.range(2000).selectExpr("id as raw", "cast(concat_ws(' ', transform(sequence(1, 50), k -> concat('w', k))) as binary) as text")
    hashes, counts, every = simhash._frequencies(long, 5)
    assert every == 16 and len(hashes) == len(counts) == 25 and 60 < min(counts) <= max(counts) < 200
    assert (np.sort(hashes) == hashes).all()


def test_spark_sends_no_side_that_grows(spark, monkeypatch):
    """Sizes told from files are too low after an explode, so no join of a table that grows is left to Spark's choice."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    for module in (simhash, graph, linededup, mixing, decontam):
        monkeypatch.setattr(module, "stored", lambda df, tag, real=module.stored: real(seen(df), tag))
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40)) for _ in range(10)]
    docs = docs_of(spark, [(i, texts[i // 2] + " more" * (i % 2), "en", "s") for i in range(20)])
    monkeypatch.setattr(simhash, "_MOST_BROADCAST", 0)
    monkeypatch.setattr(decontam, "_MOST_DOCUMENTS", 0)
    kept = seen(simhash.keep_one(docs, seen(simhash.near_duplicates(docs)))).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(0, 20, 2))
    ids = seen(simhash.simhash_components(docs)).collect()
    assert len(ids) == 20 and all(r["component_id"] <= r["doc_id"] for r in ids)
    benchmark = spark.createDataFrame([(0, texts[3])], "item_id long, text string")
    found = decontam.leaks(docs, benchmark, most_broadcast=0)
    left = seen(decontam.decontaminate(docs, found, most_broadcast=0)).collect()
    assert sorted({r["doc_id"] for r in left} ^ set(range(20))) == [6, 7]
    salted = [seen(linededup.dedup_lines(docs, most_broadcast=0)), seen(mixing.decide(docs, most_broadcast=0))]
    assert all(df.count() == 20 for df in salted)
    joins = [line.strip(" :+-*()0123456789") for p in plans for line in p.splitlines() if "Join" in line]
    assert joins
    sent = [j for j in joins if j.startswith("BroadcastHashJoin")]
    small = ("__s", "s#", "source", "host")  # a row for each source
    assert [j for j in sent if not any(x in j for x in small)] == []


def test_mixing_sends_its_sources_and_not_its_documents(spark, monkeypatch):
    plans = []
    real = mixing.small_enough
    monkeypatch.setattr(mixing, "small_enough", lambda df, most: plans.append(df) or real(df, most))
    monkeypatch.setattr(mixing, "stored", lambda df, tag, of=mixing.stored: of(plans.append(df) or df, tag))
    docs = docs_of(spark, [(i, f"some text {i}", "en", "s") for i in range(20)])
    assert mixing.decide(docs).count() == 20
    text = [df._jdf.queryExecution().executedPlan().toString() for df in plans]
    joins = [line for p in text for line in p.splitlines() if "own_b" in line and "Join" in line]
    assert joins and all("BroadcastHashJoin" in x and "BuildRight" in x for x in joins)


def test_prefix_join_drops_pairs_that_share_a_passage(spark, monkeypatch):
    """Texts go only to pairs that may have the similarity, though the sample doesn't tell that what they share is common."""
    monkeypatch.setattr(simhash, "_MOST_COUNTED", 1)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(150)]
    rows = [(i, " ".join(passage + [word() for _ in range(180)])) for i in range(60)]
    rows.append((60, rows[0][1] + " " + " ".join(word() for _ in range(30))))
    docs = spark.createDataFrame(rows, "raw long, text string").withColumn("text", F.col("text").cast("binary"))
    classes = spark.createDataFrame([(i, i, i) for i, _ in rows], "raw long, node long, root long")
    assert {(r["a"], r["b"]) for r in simhash.prefix_pairs(docs, classes, width=5, similarity=0.8).collect()} == {(0, 60)}


def test_sketches_drop_no_pair_of_the_similarity():
    rng = np.random.default_rng(5)
    for n in [1, 2, 5, 63, 64, 65, 255, 257, 513, 1025, 5000] * 8:
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        gone, more = rng.integers(0, n // 10 + 1), rng.integers(0, n // 10 + 1)
        b = np.concatenate([a[gone:], rng.integers(0, 2**63, more).astype(np.uint64)])
        for x, y in ((a, b), (b, a)):
            assert (n - gone) / (n + more) < 0.8 or simhash._may_have(simhash._sketch(x), simhash._sketch(y), 0.8)
    same = np.arange(300, dtype=np.uint64) << np.uint64(40)  # no room in a byte: not dropped
    assert simhash._sketch(same) is None and simhash._may_have(None, simhash._sketch(a), 0.8)
    assert not simhash._may_have(simhash._sketch(a), simhash._sketch(rng.integers(0, 2**63, n).astype(np.uint64)), 0.8)


# ---- pipeline

def test_pipeline(spark, documents):
    out = corpus_pipeline.run(spark, SF).collect()
    ids = [r["doc_id"] for r in out]
    assert len(ids) == len(set(ids)) > 0 and set(ids) <= {d[0] for d in documents}
    assert all(r["copies"] in (1, 2) for r in out)
    docs = docs_of(spark, ODD).withColumn("n_chars", F.col("n_chars").cast("int"))
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, SF)
        assert docs.count() > 0, name
