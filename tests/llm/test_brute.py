"""Queries of the training-data operators against versions of them in plain Python, and cases that once went wrong."""

import datetime as dt
import hashlib
import math
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from foldstone.llm import hnsw, langid, mixing, pii
from foldstone.llm import queries as q
from test_llm import SF, docs_of, luhn

# ---- 2: pseudonyms in plain Python


def _sha(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


class Plain:
    def __init__(self, key):
        self.key = hashlib.sha256(f"pseudonyms|{key}".encode()).hexdigest()

    def permute(self, value, kind):
        left, right = value[: len(value) // 2], value[len(value) // 2 :]

        def shift(half, other, i):
            stream = "".join(_sha(self.key, kind, i, len(half), b, other) for b in range(len(half) // 16 + 1))
            out = ""
            for k, c in enumerate(half):
                by = int(stream[4 * k : 4 * k + 4], 16)
                base, radix = next(((ord(a), n) for a, z, n in (("0", "9", 10), ("a", "z", 26), ("A", "Z", 26)) if a <= c <= z), (None, 0))
                out += c if base is None else chr(base + (ord(c) - base + by) % radix)
            return out

        for i in range(8):
            left, right = (shift(left, right, i), right) if i % 2 == 0 else (left, shift(right, left, i))
        return left + right

    def number(self, n, high, low, kind):
        h, l = divmod(n, low)
        for i in range(8):
            if i % 2 == 0:
                h = (h + int(_sha(self.key, kind + "h", i, l)[:12], 16)) % high
            else:
                l = (l + int(_sha(self.key, kind + "l", i, h)[:12], 16)) % low
        return h * low + l

    def date(self, v, fmt):
        try:
            day = dt.datetime.strptime(v, fmt).date()
        except ValueError:
            return None
        n = (day - dt.date(1900, 1, 1)).days
        return (dt.date(1900, 1, 1) + dt.timedelta(self.number(n, 256, 286, "date"))).strftime(fmt) if 0 <= n < 256 * 286 else None

    def value(self, kind, v):
        d = re.sub("[^0-9]", "", v)
        lay = lambda s, cls="[0-9]": (lambda it: re.sub(cls, lambda _: next(it), v))(iter(s))
        if kind == "email":
            return self.permute(v[: v.index("@")], "email") + v[v.index("@") :]
        if kind == "card" and luhn(d):
            body = d[0] + self.permute(d[1:-1], "card")
            return lay(next(body + str(c) for c in range(10) if luhn(body + str(c))))
        if kind == "iban":
            bare = v.replace(" ", "")
            rest = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97
            if rest(bare) != 1 or not 15 <= len(bare) <= 34:
                return None
            body = self.permute(bare[4:], "iban")
            return lay(bare[:2] + f"{98 - rest(bare[:2] + '00' + body):02d}" + body, "[0-9A-Z]")
        if kind == "ipv4":
            parts = [int(x) for x in v.split(".")]
            if max(parts) > 255:
                return None
            n = self.number(int.from_bytes(bytes(parts)), 65536, 65536, "ipv4")
            return ".".join(map(str, n.to_bytes(4)))
        if kind in ("iso", "dmy", "mdy"):
            return self.date(v, {"iso": "%Y-%m-%d", "dmy": "%d.%m.%Y", "mdy": "%m/%d/%Y"}[kind])
        if kind == "ssn":
            a, g, s = map(int, v.split("-"))
            if a in (0, 666) or a >= 900 or not g or not s:
                return None
            valid = [x for x in range(1, 900) if x != 666]
            n = self.number((valid.index(a) * 99 + g - 1) * 9999 + s - 1, 898 * 99, 9999, "ssn")
            h, low = divmod(n, 9999)
            return f"{valid[h // 99]:03d}-{h % 99 + 1:02d}-{low + 1:04d}"
        if kind == "phone" and 8 <= len(d) <= 15:
            two = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
            n = 0 if v[0] != "+" else 1 if d[0] in "17" else 2 if d[:2] in two else 3
            code, rest = d[:n], d[n:]
            if len(rest) != 10 or (v[0] == "+" and d[0] != "1"):
                return lay(code + self.permute(rest, "phone"))
            some = lambda c: "23456789" if c in "23456789" else "01"
            one, two_ = some(rest[0]), some(rest[3])
            wide = len(two_) * 100
            high = (one.index(rest[0]) * 100 + int(rest[1:3])) * wide + two_.index(rest[3]) * 100 + int(rest[4:6])
            top, low = divmod(self.number(high * 10_000 + int(rest[6:]), len(one) * 100 * wide, 10_000, "phone1"), 10_000)
            a, b = divmod(top, wide)
            return lay(code + f"{one[a // 100]}{a % 100:02d}{two_[b // 100]}{b % 100:02d}{low:04d}")
        return None

    def within(self, v):
        w = f"\n{v}\n\n"
        want = {c: n for n, names in pii._IBAN_LENGTHS.items() for c in names.split()}

        def longest(i):
            for end in range(len(v), i, -1):
                if not re.match("[0-9A-Za-z][^0-9A-Za-z]", w[end : end + 2]):
                    continue
                for name, pattern in pii._KINDS:
                    if not re.fullmatch(f"(?s).(?:{pattern}).{{2}}", w[i : end + 3]):
                        continue
                    bare = v[i:end].replace(" ", "")
                    if name == "iban" and want.get(bare[:2], len(bare)) != len(bare):
                        continue
                    if (new := self.value(name, v[i:end])) is not None:
                        return end, name, new
            return None

        out, found, at = "", [], 0
        for i in range(len(v)):
            if i >= at and re.match("[^0-9A-Za-z][0-9A-Za-z+(]", w[i : i + 2]) and (hit := longest(i)):
                out += v[at:i] + hit[2]
                found.append(hit[1:])
                at = hit[0]
        return out + v[at:], found

    def text(self, t):
        found = []

        def one(m):
            v = m[0]
            kind = next(k for k, p in pii._KINDS if re.fullmatch(p, v))
            new = self.value(kind, v)
            if new is not None:
                found.append((kind, new))
                return new
            out, more = self.within(v)
            found.extend(more)
            return out

        return t if t is None else re.sub(pii.ANY, one, t), found


ODD_VALUES = [
    "4111 1111 1111 1111 12/27 and 4111-1111-1111-1111 04/29", "BE68 5390 0754 7034 VISA, DE89370400440532013000", "on 1984-02-29, 31.12.1999, 02/30/2001, 02/28/2001", "+44 20 7946 0958 +442079460958 +352 621 123 456 +7 912 345 67 89",
    "(262) 555-7240 262-555-7240 +1 (262) 555-7240 +1 (052) 155-7240", "078-05-1120 666-12-1234 899-99-9999", "29.217.126.147 999.1.1.1 0.0.0.0 255.255.255.255", "long.local_part+of-forty.characters-and.more-1234567890@mail.example.com X@y.co", "1984-02-29 1999-11", "12 4111 1111 1111 1111", None, "", "no value",
]


def test_pseudonyms_against_plain_python(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    plain = Plain(q.TEST_KEY)
    got = {r["doc_id"]: r for r in q.op2(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        out, found = plain.text(text)
        assert got[i]["text"] == out and got[i]["n_found"] == len(found) and got[i]["kinds"] == ",".join(sorted({k for k, _ in found}))
    plain = Plain("k")
    odd = {r["doc_id"]: r for r in pii.pseudonymise(docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(ODD_VALUES)]), key="k").collect()}
    for i, text in enumerate(ODD_VALUES):
        out, found = plain.text(text)
        assert (odd[i]["text"], [(f["kind"], f["pseudonym"]) for f in odd[i]["findings"]]) == (out, found)


def test_pseudonyms_survive_long_domains_and_long_texts(spark):
    texts = ["mail x@" + "a." * 1_000_000 + "com", "x@" + "a." * 60 + "com " + "1 " * 500_000, "9" * 1_000_000, "a@" * 300_000]
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), key="k").collect()}
    assert got[0] == texts[0] and got[1][0] != "x" and got[1][1:] == texts[1][1:] and got[2] == texts[2]


def test_pseudonyms_link_and_stay_valid(spark):
    same = ["+44 20 7946 0958", "+442079460958", "+44-20-7946-0958"]
    ten = ["(262) 555-7240", "262-555-7240", "+1 (262) 555-7240", "+1 262 555 7240"]
    ssn = [f"{a:03d}-{g:02d}-{s:04d}" for a, g, s in zip(range(1, 900), range(1, 10_000, 11), range(1, 10_000, 7)) if a != 666 and g < 100]
    ssn += [f"{a:03d}-45-6789" for a in range(1, 900) if a != 666]
    texts = same + ten + ssn
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), key="k").collect()}
    out = [got[i] for i in range(len(texts))]
    digits = [re.sub(r"\D", "", x) for x in out]
    assert len(set(digits[:3])) == 1 and digits[0].startswith("44") and out[0] != same[0]
    assert len({x[-10:] for x in digits[3:7]}) == 1 and re.match("[2-9]..[2-9]", digits[3])
    assert all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", x) for x in out[7:]) and len(set(out[7:])) == len(set(ssn))
    with pytest.raises(ValueError):
        pii.pseudonymise(docs_of(spark, []), key="")


# ---- 8: language mixtures in plain Python


def plain_grams(text):
    if not text or not any(c.isalpha() for c in text):
        return {}
    raw = b" " + b" ".join("".join(c if c.isalpha() or ord(c) > 127 else " " for c in text.lower()).encode("utf-8", "replace").split()) + b" "
    out = Counter()
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        mixed = (a * 0x9E3779B1 & 0xFFFFFFFF) ^ (b * 0x85EBCA6B & 0xFFFFFFFF) ^ (c * 0xC2B2AE35 & 0xFFFFFFFF)
        out[(mixed * 0x27D4EB2F & 0xFFFFFFFF) >> 18] += 1
    return out


def plain_infer(p, languages, text, overlap=3.0, rounds=12):
    grams = plain_grams(text)
    if not grams or not languages:
        return "und", 0.0
    n, flat = sum(grams.values()), 1 / 4096

    def em(chosen):
        cols = [p[g] for g in chosen]
        mix = [1 / (len(cols) + 1)] * (len(cols) + 1)
        probs = {b: [*(c[b] for c in cols), flat] for b in grams}
        for _ in range(rounds):
            new = [0.0] * len(mix)
            for b, k in grams.items():
                total = sum(m * x for m, x in zip(mix, probs[b]))
                for j, x in enumerate(probs[b]):
                    new[j] += k * mix[j] * x / total
            mix = [x / n for x in new]
        like = sum(k * math.log(sum(m * x for m, x in zip(mix, probs[b]))) for b, k in grams.items()) / overlap
        return mix, like - 0.5 * len(mix) * math.log(max(2.0, n / overlap))

    full, _ = em(languages)
    order = sorted(range(len(languages)), key=lambda k: -full[k])
    chosen = [order[0]]
    best = em([languages[k] for k in chosen])
    for k in order[1:]:
        if full[k] >= 0.02:
            other = em([languages[j] for j in [*chosen, k]])
            if other[1] > best[1]:
                best, chosen = other, [*chosen, k]
    share = dict(zip(chosen, best[0]))
    top = max(sorted(share), key=share.get)
    return languages[top], share[top]


def test_language_against_plain_python(spark):
    docs = duckdb.sql(f"select doc_id, text, lang from '{SF}/documents.parquet' order by doc_id").fetchall()
    docs = [(i, t, g) for i, t, g in docs if len(t or "") < 20_000]
    texts = docs + [(-1, "²½①", None), (-2, "½ words", None), (-3, "", None), (-4, None, None), (-5, "日本語", None)]
    df = docs_of(spark, [(i, t, g, "s") for i, t, g in texts]).where("doc_id is not null")
    model = langid.fit(df, text_col="text", lang_col="lang", id_col="doc_id")
    counts = {}
    for _, t, g in docs:
        if g is not None:
            counts.setdefault(g, Counter()).update(plain_grams(t))
    languages = sorted(g for g in counts if counts[g])
    p = {g: [(counts[g][b] + 0.05) / (sum(counts[g].values()) + 0.05 * langid.BUCKETS) for b in range(langid.BUCKETS)] for g in languages}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, model).collect()}
    assert model.languages == languages and len(got) == len(texts)
    for i, t, _ in texts:
        lang, share = plain_infer(p, languages, t)
        assert got[i][0] == lang and got[i][1] == pytest.approx(share, abs=1e-6)
    assert got[-1] == ("und", 0.0) and got[-2][0] != "und"
    assert langid.predict(df.where("doc_id = 99999999"), model).count() == 0


# ---- 9: ties


def test_mixing_with_repeated_rows_and_null_ids(spark):
    word = lambda k: " ".join(f"w{k}x{j}" for j in range(10))
    rows = [(i, word(i), "en", "a") for i in range(300)] + [(7, word(0), "en", "b")] * 100 + [(None, word(i % 3), "en", "c") for i in range(200)] + [(None, None, None, None)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    for s in ("a", "b", "c"):
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 5 and all(r["taken"] <= 20 for r in own)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    con.sql("create table d as select cast(doc_id as bigint) as doc_id, text, source from documents")
    want = con.sql(q.SQL["op9_water_filling_mix"].replace("FROM documents", "FROM d")).fetchall()
    assert sorted((str(r["doc_id"]), r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got) == sorted((str(a), b, c, round(d, 6), e) for a, b, c, d, e in want)
    again = mixing.mix(df.orderBy(F.rand(3)).repartition(9), most_broadcast=0).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


# ---- 1: repeated ids, more queries than a task takes, more neighbours than the beam is wide


def test_hnsw_repeated_ids_and_wide_search(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (1, [3.0, 0.5]), (2, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index, shards = hnsw.build_index(df, id_col="vec_id", vector_col="embedding")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in hnsw.search(index, shards, df.where("vec_id = 0"), id_col="vec_id", vector_col="embedding").collect()]
    assert sorted(got) == [(0, 1, 1, 1.0), (0, 2, 2, 0.5)]
    many = spark.range(600).selectExpr("id as vec_id", "array(cos(id / 600D), sin(id / 600D)) as embedding")
    index, shards = hnsw.build_index(many, id_col="vec_id", vector_col="embedding", shard_rows=200)
    wide = hnsw.search(index, shards, many.where("vec_id % 20 = 0"), id_col="vec_id", vector_col="embedding", k=300, task_queries=7).collect()
    assert Counter(r["query_id"] for r in wide) == {i: 300 for i in range(0, 600, 20)}
