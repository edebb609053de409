"""Fill-in-middle, fingerprints and collocations against plain versions."""

import collections
import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfield.llm import collocations, fill_middle, fingerprints
from nearfield.llm import queries as llm_queries
from nearfield.llm.shingles import stream
from tests.llm import brute

DATA = "/root/testdata/sf0.001"
LINES = re.compile(r"[^\n]*\n|[^\n]+")


@pytest.fixture(scope="module")
def rows():
    more = ["a\n\nb", "\n", "\n\n\n", "x\r\ny", "<P> is here\nso\nplain", "ends in <\nP>\nM>", "é\nü\n" * 30, "l1\nl2\nl3\nl4\nl5\nl6"]
    return brute.awkward_docs() + [(100 + i, t, "s1") for i, t in enumerate(more)] + [(None, "no id\nhere\nat all", "s2"), (None, None, None), (None, "no id\nhere\nat all", "s2")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return brute.docs_frame(spark, rows).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return brute.docs_frame(spark, [])


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def written(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(str, df.where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_fingerprints", "op13_collocations"])
def test_query_equals_sql(spark, duck, name):
    got, want = llm_queries.queries()[name](spark, DATA).toPandas(), duck.execute(llm_queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert written(got) == written(want)


# ---- 11 fill in the middle ----


def plain_fim(doc, text, rate=100, spm=50, seed=7):
    text = text or ""
    units = LINES.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    a, b, c = ("".join(units[x:y]) for x, y in ((0, low), (low, high), (high, len(units))))
    if not text or any(s in text for s in fill_middle.SENTINELS) or h[2] % 100 >= rate:
        return text, len(units), "plain", None, None
    if h[3] % 100 < spm:
        return f"<S>{c}<P>{a}<M>{b}", len(units), "spm", len(a), len(b)
    return f"<P>{a}<S>{c}<M>{b}", len(units), "psm", len(a), len(b)


@pytest.mark.parametrize(("rate", "spm", "size"), [(100, 50, 2 << 20), (50, 0, 64), (100, 100, 1)])
def test_fill_in_middle(docs, rows, none, monkeypatch, rate, spm, size):
    monkeypatch.setattr(fill_middle, "BYTES", size)  # slices of many rows, of a few and of one
    out = fill_middle.fill_in_middle(docs, rate=rate, spm_rate=spm)
    assert set(docs.columns) < set(out.columns)
    got = out.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars").collect()
    want = [(i, *plain_fim(i, t, rate, spm)) for i, t, _ in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    back = sorted(r[0] for r in out.select(fill_middle.restored(F.col("text"), F.col("form"))).collect())
    assert back == sorted(t or "" for _, t, _ in rows)
    assert fill_middle.fill_in_middle(none).count() == 0


def test_clashing_names_and_sentinels(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", "kept", 9, "x")], "doc_id int, text string, `odd name` string, n int, form string")
    out = fill_middle.fill_in_middle(df).first()
    assert (out["odd name"], out["n"]) == ("kept", 3) and out["form"] != "x"
    other = ("[pre]", "[suf]", "[mid]")
    out = fill_middle.fill_in_middle(df, sentinels=other)
    assert out.select(fill_middle.restored(F.col("text"), F.col("form"), other)).first()[0] == "a\nb\nc"
    for bad in (("<P>", "<P>x", "<M>"), ("aba", "<S>", "<M>"), ("", "<S>", "<M>"), ("ab", "bc", "d")):
        with pytest.raises(ValueError, match="sentinels"):
            fill_middle.check_sentinels(bad)


# ---- 12 fingerprints ----


def plain_sketch(text, k=128):
    return sorted({hashlib.md5(" ".join(s).encode()).hexdigest()[:16] for s in brute.shingle_set(text, 5)})[:k]


def plain_near(a, b, k=128):
    u = sorted(set(a) | set(b))[:k]
    return len([x for x in u if x in set(a) and x in set(b)]) / len(u) if u else 1.0


def test_edited_and_sketches(spark, docs, rows, none, monkeypatch):
    monkeypatch.setattr(fingerprints, "PART", 7)
    hashes = {r["text"]: r["h"] for r in docs.select(F.coalesce("text", F.lit("")).alias("text")).select("text", F.xxhash64("text").alias("h")).collect()}
    many = rows + [(500, "five words are enough here now", "s1")] * 7
    more = brute.docs_frame(spark, many).repartition(3)
    hashes |= {r["text"]: r["h"] for r in more.where("doc_id = 500").select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(((i, t or "") for i, t, _ in many), key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    want = [(i, len(t), t[: len(t) - len(t) // 2] + n[: len(t) // 2], plain_near(plain_sketch(t), plain_sketch(n))) for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True)]
    out = fingerprints.edited(more).select("*", fingerprints.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near"))
    got = out.collect()
    assert sorted(map(str, ((r["doc_id"], r["n_chars"], r["edited"], r["near"]) for r in got))) == sorted(map(str, want))
    assert all(r["sketch"] == plain_sketch(r["text"]) and r["edited_sketch"] == plain_sketch(r["edited"]) for r in got)
    assert fingerprints.edited(none).count() == 0
    one = fingerprints.edited(brute.docs_frame(spark, [(1, "abcdef", None)])).first()
    assert (one["edited"], one["next_sketch"]) == ("abcabc", plain_sketch("abcdef"))


def test_only_built_in_functions(docs):
    plan = fingerprints.edited(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_estimates(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(6000)]
    base = " ".join(rng.choice(words) for _ in range(4000))
    cut = " ".join(base.split()[:2000])
    df = spark.createDataFrame([(base, cut, "", "one two")], "a string, b string, c string, d string").select(*[fingerprints.sketch(F.col(c)).alias(c) for c in "abcd"]).cache()
    pair = lambda f, x, y: df.select(f(F.col(x), F.col(y))).first()[0]
    exact = {c: len(brute.shingle_set(t, 5)) for c, t in (("a", base), ("b", cut))}
    assert abs(pair(fingerprints.resemblance, "a", "b") - exact["b"] / exact["a"]) < 0.15
    assert pair(fingerprints.containment, "b", "a") == 1.0 and abs(pair(fingerprints.containment, "a", "b") - 0.5) < 0.15
    assert abs(df.select(fingerprints.distinct_shingles(F.col("a"))).first()[0] / exact["a"] - 1) < 0.3
    assert df.select(fingerprints.distinct_shingles(F.col("c")), fingerprints.distinct_shingles(F.col("d"))).first()[:] == (0.0, 1.0)
    assert (pair(fingerprints.resemblance, "c", "c"), pair(fingerprints.resemblance, "c", "d"), pair(fingerprints.containment, "c", "a"), pair(fingerprints.containment, "a", "c")) == (1.0, 0.0, 1.0, 0.0)
    df.unpersist()


def test_merged_sketches_are_those_of_the_union(docs, rows):
    out = fingerprints.merge_sketches(fingerprints.fingerprints(docs.select("source", "text")), "source").collect()
    sets = collections.defaultdict(set)
    for _, t, s in rows:
        sets[s] |= {hashlib.md5(" ".join(x).encode()).hexdigest()[:16] for x in brute.shingle_set(t, 5)}
    assert {r["source"]: r["sketch"] for r in out} == {s: sorted(x)[:128] for s, x in sets.items()}
    every = fingerprints.merge_sketches(fingerprints.fingerprints(docs.select("text"))).first()["sketch"]
    assert every == sorted(set().union(*sets.values()))[:128]


# ---- 13 collocations ----


def plain_collocations(rows, least=10, top=2000, share=50):
    freq, total = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for n in (1, 2, 3):
                freq[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in freq.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in cand.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= share * f[q]}
        scored = []
        for p, a in cand.items():
            if p not in gone:
                score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, x, y, total[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def lang_docs(seed=4):
    rng = random.Random(seed)
    out = []
    for lang in ("en", "de", None, "ß"):
        vocabulary = [brute.prose(rng, 1) for _ in range(25)] + ["New York", "new york", "i\tam", "A  B c"]
        for _ in range(12):
            text = ""
            for _ in range(80):
                text += rng.choice(vocabulary) + rng.choice([" ", " ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r\n", "\x0b"])
            out.append((lang, text))
    return out + [("en", None), (None, None), ("en", ""), ("en", " \t . "), ("fr", "only one text. here"), ("en", "x" * 5000 + " y"), *out[:2]]


@pytest.mark.parametrize(("sizes", "least"), [({}, 10), ({"BLOCK": 300, "SHARD": 16, "ROUND": 64, "BRANCHES": 2}, 4), ({"FILTER_BITS": 64}, 10)])
def test_collocations(spark, monkeypatch, sizes, least):
    for name, value in sizes.items():
        monkeypatch.setattr(collocations, name, value)
    given = lang_docs()
    df = spark.createDataFrame([(i, *r, 1, "x") for i, r in enumerate(given)], "doc_id int, lang string, text string, n int, key string").repartition(3)
    for top in (2000, 5):
        got = sorted(tuple(r) for r in collocations.collocations(df, least, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
        assert got == plain_collocations(given, least, top)
        assert len(got) > 10


def test_two_phrases_of_one_key_start_anew(spark, monkeypatch):
    seeds = []
    real = collocations._counted

    def lying(held, seed, *more):
        run, names = real(held, seed, *more), [f.split()[0] for f in collocations.COUNTS.split(", ")]
        seeds.append(seed)

        def also(batches):
            for batch in run(batches):
                yield batch
                if seed == 0 and batch.column("phrase").null_count < batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(["other"] * batch.num_rows) if c == "phrase" else batch.column(c) for c in names], names=names)

        return also

    monkeypatch.setattr(collocations, "_counted", lying)
    given = [("en", "a b. " * 12), ("de", "a b. " * 15)]
    df = spark.createDataFrame(given, "lang string, text string").coalesce(1)
    got = sorted(tuple(r) for r in collocations.collocations(df).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == plain_collocations(given) and sorted(set(seeds)) == [0, 1]


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "doc_id int, lang string, text string")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 50, 5000])
def test_perfect_hash_is_minimal_and_turns_others_away(n):
    keys = stream(11, n)
    shift, table = collocations.displaced(keys)
    assert sorted(table.tolist()) == sorted(keys.tolist())
    found = collocations.PerfectHash(3, [{"shard": s, "shift": a.tobytes(), "keys": b.tobytes()} for s in range(3) if (own := keys[collocations.shard_of(keys, 3) == s]).size for a, b in [collocations.displaced(own)]])
    slots = found.find(keys)
    assert sorted(slots.tolist()) == list(range(n))
    assert (found.find(stream(12, 1000)) == -1).all()
    assert len(shift) == max(1, n // 4) and np.array_equal(found.table[slots], keys)
