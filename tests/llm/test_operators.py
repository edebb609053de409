import collections
import hashlib
import math
import os
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfield.llm import components, decontamination, html_text, line_dedup, mixing, near_duplicates, secrets, suffix_dedup, token_files, toxicity, transport
from nearfield.llm import queries as llm_queries
from tests.llm import brute

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    return brute.awkward_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return brute.docs_frame(spark, rows).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return brute.docs_frame(spark, [])


def by_row(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# ---- 1 secrets ----


def test_secrets(docs, rows, none):
    got = by_row(secrets.secret_digest(docs), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    want = []
    for i, t, _ in rows:
        found = brute.spans(t)
        want.append((i, *(sum(x[2] == k for x in found) for k in secrets.BASE), hashlib.sha256(brute.joined(found).encode()).hexdigest()))
    assert got == sorted(want)
    assert secrets.secret_digest(none).count() == 0


def test_second_delivery_scans_only_new_blobs(docs, rows, monkeypatch):
    scanned = []
    real = secrets.scan_secrets
    monkeypatch.setattr(secrets, "scan_secrets", lambda *a, **k: scanned.append(real(*a, **k)) or scanned[-1])
    monkeypatch.setattr(secrets, "SEEN", 2)
    secrets.secret_digest(docs).count()
    (_, first), (_, second) = scanned
    blobs = [{r["blob"] for r in x.select("blob").distinct().collect()} for x in (first, second)]
    assert blobs[0] and blobs[1] and not blobs[0] & blobs[1] and len(blobs[0] | blobs[1]) == len({t or "" for _, t, _ in rows})


@pytest.mark.parametrize("text", ["secret:token: abcdefg", "token=token=abcdefgh", "ApI_kEy'=  \"a.b/c+d=", "paſſword=abcdefgh", "AKIAAKIA" + "A" * 16, "AKIAB AKIA" + "0" * 16, "f" * 23 + " " + "a" * 24 + "g" + "1" * 30, "password:=abcdef", "toKen: short; secret=longer1", "-----BEGIN RSA PRIVATE KEY-----"])
def test_secret_rules(text):
    found = sorted((a, k, b) for k, (_, scan) in secrets.RULES.items() if k in secrets.BASE for a, b in scan(text))
    assert found == sorted((a, k, b) for a, _, k, b in brute.spans(text))


def test_ledger_scans_only_what_is_new(docs, rows, monkeypatch):
    found, ledger = secrets.scan_secrets(docs)
    blobs = len({t or "" for _, t, _ in rows})
    assert ledger.count() == blobs * len(secrets.RULES) and ledger.select("blob", "rule", "version").distinct().count() == ledger.count()
    again, more = secrets.scan_secrets(docs, ledger)
    assert more.count() == 0 and by_row(again, "doc_id", "blob", "found") == by_row(found, "doc_id", "blob", "found")
    monkeypatch.setitem(secrets.RULES, "hex", (2, secrets.RULES["hex"][1]))
    _, more = secrets.scan_secrets(docs, ledger)
    assert {tuple(r) for r in more.select("rule", "version").distinct().collect()} == {("hex", 2)} and more.count() == blobs


# ---- 2 token files ----


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 31, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000, dtype=np.uint64).astype(np.uint32)
    data = token_files.pack(ids, bits)
    assert len(data) == math.ceil(1000 * bits / 8)
    for first, count in ((0, 1000), (3, 17), (999, 1), (500, 0)):
        assert (token_files.unpack(data, bits, count, first) == ids[first : first + count]).all()
    assert token_files.bits_for(1 << bits) == bits


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_files.default_tokenizer())


def test_chunk_encoder(tokenizer):
    texts = [t or "" for _, t, _ in brute.awkward_docs()]
    texts += ["a<|endoftext|>b", "It's a TEST... İstanbul ΑΣ ΟΔΟΣ x\x1cy naïve éa ﬁ", "12,3 4.5.", "don't won't,", "_. a._b", "ÀÉ.,! \U0001f600x", "été", "\xa0 x"]
    got = token_files.ChunkEncoder(token_files.default_tokenizer()).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_chunk_encoder_holds_little(tokenizer, monkeypatch):
    """Long chunks (no spaces, odd separators) are not remembered, few letters are encoded at once, and no id changes."""
    rng = random.Random(2)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(600)) for _ in range(20)]
    texts += [f"odd\x1c{brute.prose(rng, 100)} {i}" for i in range(20)]
    texts += [brute.prose(rng, 2000), "a<|endoftext|>b, c. " * 300, "word \u3000 e\u0301 \x1c \x85 \xa0\u0301\n" * 200, " " * 5000, "x" * 3000 + " y", ""]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for part in (token_files.PART, 100):
        monkeypatch.setattr(token_files, "PART", part)
        encoder = token_files.ChunkEncoder(token_files.default_tokenizer())
        kind, plain, sizes = token_files.ChunkEncoder, token_files.ChunkEncoder._plain, []
        monkeypatch.setattr(kind, "_plain", lambda self, t, plain=plain, sizes=sizes: sizes.append(sum(map(len, t))) or plain(self, t))
        assert [np.frombuffer(g, "<u4").tolist() for g in encoder.encode(texts)] == want
        monkeypatch.setattr(kind, "_plain", plain)
        assert max(map(len, encoder.chunks)) <= token_files.LONG
        assert max(sizes) <= 2 * part + 3000


@pytest.mark.parametrize("block", [64, 1 << 16])
def test_token_files(docs, rows, none, tokenizer, block):
    blocks = token_files.write_tokens(docs, block_ids=block)
    got = by_row(token_files.read_digests(blocks), "start", "doc_id", "n_tokens", "ids_crc32")
    want, start = [], 0
    for i, t in sorted((i, t or "") for i, t, _ in rows):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        want.append((start, i, len(ids), brute.crc(ids)))
        start += len(ids)
    assert got == want
    first = blocks.orderBy("shard", "block").first()
    some = token_files.read_tokens(blocks, first["shard"], 1, 3)
    assert some.tolist() == token_files.unpack(first["payload"], first["bits"], 3, 1).tolist()
    assert token_files.read_digests(token_files.write_tokens(none)).count() == 0


def test_many_rows_of_one_id_spread_over_shards(spark, tokenizer):
    rng = random.Random(4)
    texts = [brute.prose(rng, 30) for _ in range(400)]
    blocks = token_files.write_tokens(spark.createDataFrame([(5, t) for t in texts] + [(None, "x")] * 3, "doc_id bigint, text string"))
    got = sorted((r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_digests(blocks).collect())
    assert blocks.select("shard").distinct().count() > 1 and len(got) == 403
    assert [s for s, _, _ in got] == [sum(n for _, n, _ in got[:k]) for k in range(403)]
    ids = [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in [*texts, "x", "x", "x"]]
    assert sorted(c for _, _, c in got) == sorted(map(brute.crc, ids))


# ---- 3 toxicity ----


def toxic_sample(n=400, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y = int(rng.random() < 0.25)
        w = brute.prose(rng, rng.randint(20, 120)).split()
        if y:
            for k in range(len(w) // 8 + 2):
                w[rng.randrange(len(w))] = rng.choice(["vilest", "grubbing", "zugzwa" + brute.prose(rng, 1)])
        out.append((i, " ".join(w), y))
    return out


def test_toxicity(spark, none):
    sample = toxic_sample()
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t, _ in sample] + [(1000, None, "en", "s"), (1001, "", "en", "s"), (1002, "Vilest! " * 3000, "en", "s")], "doc_id bigint, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in sample] + [(5, 0, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(i, t, y) for i, t, y in sample if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in sample)
    assert sum(got[i]["predicted"] == y for i, _, y in held) >= 0.95 * len(held)
    assert got[1000]["score"] == got[1001]["score"] < 0.5 and got[1002]["predicted"] == 1 and len(got[1002]["spans"]) == 3000
    found = [t[s["start"] : s["end"]].lower()[:6] for i, t, _ in held for s in got[i]["spans"]]
    assert sum(w in ("vilest", "grubbi", "zugzwa") for w in found) > 0.9 * len(found) > 0
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}
    assert toxicity.score(none, model).count() == 0
    unlabelled = toxicity.train(docs, labels.limit(0))
    assert {r["predicted"] for r in toxicity.score(docs, unlabelled).collect()} == {0}


def plain_marginals(model, words):
    """Probability of the toxic state at every token, by a chain over all of them."""
    own = [model.weight(x) for x in words]
    emit = np.zeros((len(words), 2))
    for i in range(len(words)):
        emit[i, 1] = model.bias + own[i] + (model.beside[0] if i and own[i - 1] else 0) + (model.beside[1] if i + 1 < len(words) and own[i + 1] else 0)
    f, b = np.zeros((len(words), 2)), np.ones((len(words), 2))
    step = np.exp(model.moves)
    f[0] = np.ones(2) @ step * np.exp(emit[0])
    for t in range(1, len(words)):
        f[t] = f[t - 1] @ step * np.exp(emit[t])
        f[t] /= f[t].sum()
    for t in range(len(words) - 2, -1, -1):
        b[t] = step @ (np.exp(emit[t + 1]) * b[t + 1])
        b[t] /= b[t].sum()
    p = f * b
    return (p / p.sum(1, keepdims=True))[:, 1]


def test_marginals_match_a_full_chain():
    model = toxicity.Model({"bad": 2.0, "worse": 3.0, "badder": -1.0}, np.array([[0.5, -0.7], [-0.3, 0.4]]), -1.0, (0.4, -0.3))
    rng = random.Random(1)
    for n in (1, 2, 9, 40):
        w = [rng.choice(["ok", "fine", "bad", "worse", "badder"]) for _ in range(n)]
        marked = model.marked(w)
        p = plain_marginals(model, w)
        assert np.allclose(model.marginals(marked, n), [p[i] for i, _ in marked], atol=1e-9)


@pytest.mark.parametrize("gap", [511, 512, 513, 900, 1000, 2600])
def test_marginals_of_far_tokens(gap):
    model = toxicity.Model({"bad": 4.0}, np.array([[0.01, -6.0], [-6.0, 0.01]]), 0.0)
    words = ["bad", *["ok"] * (gap - 1), "bad", *["ok"] * 99]
    marked, p = model.marked(words), plain_marginals(model, words)
    assert np.allclose(model.marginals(marked, len(words)), [p[i] for i, _ in marked], atol=1e-9)


def test_spans_are_offsets_of_the_text():
    model = toxicity.Model({"vile": 9.0}, bias=-4.0, final=(0.0, 1.0, 0.0))
    for text in ("İstanbul vile end", "ẞ İİ Vile\u0307 vile", "VILE", "no"):
        want = [(m.start(), m.end()) for m in __import__("re").finditer("(?i)vile", text)]
        assert toxicity.spans_of(model, text)[1] == want
    assert len(toxicity.lowered("İẞΣ")) == 3


def test_toxicity_equals_a_plain_version(spark, docs, rows):
    sample = toxic_sample(200)
    model = toxicity.fit([t for _, t, _ in sample], [y for _, _, y in sample])
    assert model.weights and model.beside != (0.0, 0.0)
    texts = [(i, t) for i, t, _ in sample[:60]] + [(1000 + i, t) for i, (_, t, _) in enumerate(rows)]
    got = sorted((r["doc_id"], round(r["score"], 9), tuple((s["start"], s["end"]) for s in r["spans"])) for r in toxicity.score(spark.createDataFrame(texts, "doc_id bigint, text string"), model).collect())
    want = []
    for i, t in texts:
        t = (t or "").lower()
        at = [m.span() for m in __import__("re").finditer(r"\w+", t)]
        w = [t[a:b] for a, b in at]
        near = {j for k, x in enumerate(w) if model.weight(x) for j in (k - 1, k, k + 1) if 0 <= j < len(w)}
        p = plain_marginals(model, w) if w else []
        total = sum(p[k] for k in near)
        z = model.final[0] + model.final[1] * math.log1p(total) + model.final[2] * min(5.0, 100 * total / max(1, len(w)))
        want.append((i, round(1 / (1 + math.exp(-max(-30, min(30, z)))), 9), tuple(at[k] for k in sorted(near) if p[k] >= 0.5)))
    assert got == sorted(want)


def test_long_texts_and_repeated_ids_are_learned(spark):
    sample = toxic_sample(300, 4)
    long = [(i, t + " calm" * 9000 if y else t) for i, t, y in sample]
    frame = spark.createDataFrame(long + long[:50] + [(long[0][0], "another text")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in sample] * 2, "doc_id bigint, toxic int")
    model = toxicity.train(frame, labels)
    assert {"vilest", "grubbing"} <= set(model.weights)


# ---- 4 HTML ----

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Home</ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>A &amp; B&nbsp;C</h1><p>First <b>bold</b>
 text<br>more &#233;&lt;x&gt;<p>Second<div class="ad">Buy</div><section id="comments"><p>Nice post</p></section><script>var a="<p>no</p>";</script></article>
<aside>Side</aside><footer>Foot</footer>"""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""), (PAGE, "A & B C\nFirst bold text more é<x>\nSecond"), ("plain  text < 5 &unknown;", "plain text < 5 &unknown;"), ("<p>a<!-- x --><p>b<nav>c", "a\nb\nc"), ("<main><p>x</p></main>out", "x"),
        ("<article class='comment'>c</article><p>y</p>", "y"), ("<script>x", ""), ("<p title='a>b'>q</p>", "q"), ("<form>f</form><article><p>1<p>2</article><article>3</article>", "1\n2\n3"), ("<div hidden>h</div><p>v", "v"),
        ('<p>x</p><div role="main"><p>a</p><div>b<div>c</div></div></div><p>y', "a\nb\nc"), ('<article><p class="related-work">r</p><div class="entry-header">h</div><label>l</label><div class="ad-box">no</div></article>', "r\nh\nl"), ("<p>a<b <i>c</i></p>d", "ac\nd"), ("<nav>a</nav><nav>b<p>c", "b\nc"),
    ],
)
def test_page_lines(page, text):
    assert "\n".join(html_text.lines_of(page)[0]) == text


def test_common_lines(monkeypatch):
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = sorted(html_text.common_lines(a, b))
        left = iter(b)
        assert len(got) == best[-1][-1] and all(a[i] in left for i in got)
        monkeypatch.setattr(html_text, "SPLIT", 4)
        halved, left = sorted(html_text.common_lines(a, b)), iter(b)
        assert len(halved) == best[-1][-1] and all(a[i] in left for i in halved)
        monkeypatch.undo()


def test_awkward_pages_take_linear_time():
    import time

    start = time.perf_counter()
    assert len(html_text.common_lines(["x"] * 20_000, ["x"] * 19_000 + ["y"] * 50)) == 19_000
    assert html_text.common_lines([f"a{i}" for i in range(9000)], [f"b{i}" for i in range(9000)]) == set()
    for page in ("<a " * 200_000, "<a '" * 100_001, "<!x " * 200_000, "<nav>" * 100_000, "<textarea>" * 50_000, "<article>" * 300 + "<p>x" * 50_000, '<p a="' * 100_001, "<p " + "a" * 300_000, "&" * 200_000, "<p " + "a=" * 100_000):
        html_text.marked_lines(page)
    assert time.perf_counter() - start < 20


def test_page_differencing(spark):
    pages = [(1, "http://h.org/a/1", "<p>Menu<p>one<p>Foot"), (2, "http://H.org/a/2?x", "<p>Menu<p>two<p>Foot"), (3, "http://h.org/a/2", "<p>Menu<p>two<p>Foot"), (4, "http://other.org/", "<p>Menu<p>alone"), (5, None, None), (6, "http://h.org/b", "<article><p>Menu<p>kept</article>")]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id bigint, url string, html string, host string, path int").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    got = {r["page_id"]: r for r in html_text.extract_text(df).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {i: r["text"] for i, r in got.items()} == {1: "one", 2: "two", 3: "two", 4: "Menu\nalone", 5: "", 6: "Menu\nkept"}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and got[5]["url"] is None
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_marked_pages_are_differenced(spark):
    pages = [(1, "http://h.org/1", "<p>Top<main><p>same<p>one</main><p>only here<p>End"), (2, "http://h.org/2", "<p>Top<article><p>same<p>two</article><p>End"), (3, "http://h.org/3", "<p>Top<p>three<p>End"), (4, "http://lone.org/", "<p>Top<main><p>x</main>")]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1)).collect()}
    assert got == {1: "same\none\nonly here", 2: "same\ntwo", 3: "three", 4: "x"}


def plain_differencing(pages):
    """Texts by one pass over all classes of pages, without ranges."""
    marked = [(u.split("/")[2], u.split(u.split("/")[2], 1)[1], i, *html_text.marked_lines(h)) for i, u, h in pages]
    first = {}
    for host, path, i, lines, _, _ in sorted(marked):
        if lines:
            first.setdefault((host, tuple(lines)), (host, path, i))
    order = sorted(first, key=first.get)
    out = {}
    for host, _, i, lines, kinds, named in marked:
        n = order.index((host, tuple(lines))) if lines else 0
        near = [order[m][1] for m in (n - 1, n + 1) if lines and 0 <= m < len(order) and order[m][0] == host]
        shared = html_text.common_lines(lines, list(near[0])) if near else set()
        least = html_text.INSIDE if named and not near else html_text.PLAIN
        out[i] = "\n".join(x for k, x in enumerate(lines) if kinds[k] >= least and (kinds[k] == html_text.INSIDE or k not in shared))
    return out


def test_differencing_decides(spark):
    """On the given pages, the alignment itself deletes lines; its result equals one pass over all classes."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in html_text.extract_text(pages).collect()}
    assert sum(r["n_shared"] > 0 for r in got.values()) > 0
    plain = [(r["page_id"], r["url"] or "", r["html"] or "") for r in pages.collect()]
    want = plain_differencing([(i, u.split("?")[0].split("#")[0].lower(), h) for i, u, h in plain])
    assert {i: r["text"] for i, r in got.items()} == want


def test_copies_and_ranges_are_differenced(spark):
    pages = [(1, "http://h.org/a/1", "<p>Menu<p>one<p>Foot"), (2, "http://h.org/a/2", "<p>Menu<p>two<p>Foot"), *((i, f"http://h.org/a/{i}", "<p>Menu<p>two<p>Foot") for i in range(3, 40))]
    schema = "page_id bigint, url string, html string"
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(pages, schema)).collect()}
    assert got == {1: "one"} | {i: "two" for i in range(2, 40)}
    rng = random.Random(3)
    pages = []
    for i in range(300):
        host = rng.choice(["big.org"] * 4 + [f"s{j}.org" for j in range(40)])
        words = [f"{host} menu", *(f"w{rng.randint(0, 3)}" for _ in range(rng.randint(0, 3))), f"{host} foot"]
        mark = rng.random() < 0.3
        pages.append((i, f"http://{host}/{rng.randint(0, 50):02}", "" if rng.random() < 0.05 else "<p>".join(["", words[0]]) + ("<main>" if mark else "") + "".join(f"<p>{w}" for w in words[1:-1]) + ("</main>" if mark else "") + f"<p>{words[-1]}"))
    want = plain_differencing(pages)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n in (1, 4, 60, 400):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            assert {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(pages, schema)).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# ---- 5 decontamination ----


def plain_scores(index, query):
    total = {}
    for w in query:
        for n, x in zip(*index.postings[w], strict=True):
            total[n] = total.get(n, 0.0) + x
    return {n: s for n, s in total.items() if s >= decontamination.MIN_SCORE}


def test_block_max_wand_finds_all():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary[: rng.choice([10, 60])]) for _ in range(rng.randint(1, 12)))) for i in range(57)]
    df = decontamination.Counter(w for _, t in items for w in set(t.split()))
    index = decontamination.Index(items, df, len(items), 6.0)
    for _ in range(300):
        query = sorted(set(rng.sample(vocabulary, rng.randint(1, 25))) & set(index.terms))
        got = index.search(query)
        fewer = index.search(index.useful(query))
        assert [n for n, _ in fewer] == [n for n, _ in got] and np.allclose([x for _, x in fewer], [x for _, x in got])
        want = plain_scores(index, query)
        assert sorted(n for n, _ in got) == sorted(want) and all(abs(s - want[n]) < 1e-9 for n, s in got)


def test_contaminated(spark, docs, none, monkeypatch):
    rng = random.Random(6)
    items = [(i, f"{brute.prose(rng, 20)}?\n{brute.prose(rng, 6)}.") for i in range(30)] + [(100, None), (101, ""), (102, "one two three"), (102, "one two three")]
    frame = spark.createDataFrame([(*x, "q") for x in items], "item_id bigint, text string, extra string")
    long = items[7][1].split()
    long[10] = "edited"
    texts = [(1, f"{brute.prose(rng, 300)} {items[3][1].upper()} {brute.prose(rng, 90)}"), (2, brute.prose(rng, 500)), (3, " ".join(long)), (4, items[5][1].split("\n")[0]), (5, None), (6, "x one two three y"), (7, items[9][1] + " " + items[8][1])]
    found = decontamination.contaminated(spark.createDataFrame(texts, "doc_id bigint, text string"), frame)
    want = [(1, 3), (3, 7), (6, 102), (6, 102), (7, 8), (7, 9)]
    assert by_row(found, "doc_id", "item_id") == want
    monkeypatch.setattr(decontamination, "PART_BYTES", 900)
    assert by_row(decontamination.contaminated(spark.createDataFrame(texts, "doc_id bigint, text string"), frame), "doc_id", "item_id") == want
    assert decontamination.contaminated(none, frame).count() == decontamination.contaminated(docs, frame.limit(0)).count() == 0


def plain_contaminated(texts, items):
    """(doc, item, score) by scoring every passage against every item."""
    items = [(i, t, decontamination.words_of(t or "")) for i, t in items if decontamination.words_of(t or "")]
    df = collections.Counter(w for _, _, ws in items for w in set(ws))
    mean = sum(len(ws) for _, _, ws in items) / len(items)
    width = max(decontamination.PASSAGE, 2 * max(len(ws) for _, _, ws in items))
    out = []
    for d, text in texts:
        words = decontamination.words_of(text or "")
        starts = range(0, max(1, len(words) - width // 2), width // 2)
        for i, t, ws in items:
            impact = {w: math.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w, c in collections.Counter(ws).items()}
            best = max(sum(impact.get(w, 0) for w in set(words[at : at + width])) / sum(impact.values()) for at in starts)
            covered = []
            for part in decontamination.split_item(t):
                n = min(5, len(part))
                hit = set()
                for k in range(len(part) - n + 1 if part else 0):
                    if any(words[j : j + n] == part[k : k + n] for j in range(len(words) - n + 1)):
                        hit.update(range(k, k + n))
                covered.append(len(hit) / len(part) if part else 1.0)
            if best >= 0.5 and min(covered) >= 0.8:
                out.append((d, i, round(best, 6)))
    return sorted(out)


@pytest.mark.parametrize("size", [decontamination.PART_BYTES, 2500])
def test_contaminated_equals_a_plain_version(spark, rows, monkeypatch, size):
    monkeypatch.setattr(decontamination, "PART_BYTES", size)
    rng = random.Random(16)
    items = [(i, f"{brute.prose(rng, rng.randint(8, 40))}?\n{brute.prose(rng, rng.randint(1, 9))}.") for i in range(40)] + [(50, "a"), (51, None), (52, "!!")]
    texts = [(i, t) for i, t, _ in rows]
    for d in range(60):
        words = brute.prose(rng, rng.randint(10, 500)).split()
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(items[:40])[1].split()
            for _ in range(rng.randint(0, 4)):
                part[rng.randrange(len(part))] = "edited"
            at = rng.randrange(len(words))
            words[at:at] = part[rng.randint(0, 3) :]
        texts.append((100 + d, " ".join(words)))
    got = decontamination.contaminated(spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    want = plain_contaminated(texts, items)
    assert sorted((r["doc_id"], r["item_id"], round(r["score"], 6)) for r in got.collect()) == want and len(want) > 20


def index_of(items):
    words = [decontamination.words_of(t) for _, t in items]
    return items, collections.Counter(w for ws in words for w in set(ws)), len(items), sum(map(len, words)) / len(items)


def test_word_hashes_follow_the_words():
    texts = ["", "One,two_2 ONE", "ÀÉ… ñandú—ñANDÚ ΟΔΟΣ ΟΔΟΣ.", "\0\n", "İstanbul ß 東京 ١٢ x", "abcdefg abcdefgh abcdefghi abcdefghi abcdefghj", "e\u0301e " + "z" * 40]
    hashes, begin = decontamination.word_hashes(texts)
    words = [decontamination.words_of(t) for t in texts]
    assert np.diff(begin).tolist() == [len(w) for w in words]
    known = {}
    assert all(known.setdefault(w, h) == h for w, h in zip([w for ws in words for w in ws], hashes.tolist(), strict=True))
    assert len(set(known.values())) == len(known)
    assert decontamination.word_hashes([])[1].tolist() == [0]


@pytest.mark.parametrize("at_once", [decontamination.AT_ONCE, 3])
def test_promising_passages_are_all_found(monkeypatch, at_once):
    monkeypatch.setattr(decontamination, "AT_ONCE", at_once)
    rng = random.Random(26)
    long = [f"startofit{c}endofword" for c in "abc"]  # one hash
    vocabulary = [f"w{i}" for i in range(90)] + long + ["ñu", "Ö"]
    items = [(i, " ".join(rng.choice(vocabulary[: rng.choice([10, 95])]) for _ in range(rng.randint(1, 30)))) for i in range(57)]
    index = decontamination.Index(*index_of(items))
    texts = ["", "…", *(" ".join(rng.choice([f"x{rng.randint(0, 99)}", rng.choice(vocabulary).upper()]) for _ in range(rng.choice([1, 63, 64, 65, 128, 129, 192, 193, 500]))) for _ in range(120))]
    got, hits = index.promising(texts), 0
    for n, text in enumerate(texts):
        words = decontamination.words_of(text)
        for at in range(0, max(1, len(words) - index.width // 2), index.width // 2):
            query = sorted(set(words[at : at + index.width]) & index.terms.keys())
            if want := plain_scores(index, query):
                hits += 1
                assert set(want) <= set(got[n][at])
                assert [i for i, _ in index.search(query, got[n][at])] == sorted(want)
        assert all(at in range(0, max(1, len(words) - index.width // 2), index.width // 2) for at in got.get(n, []))
    assert hits > 50


def test_passages_with_frequent_words_alone_are_not_searched(monkeypatch):
    """Documents share the items' frequent words, in numbers that the bounds by blocks do not dismiss."""
    rng = random.Random(36)
    common = [f"the{i}" for i in range(12)]
    items = [(i, " ".join(common + [f"rare{i}x{j}" for j in range(12)]) + ".") for i in range(40)]
    texts = [" ".join(rng.choice([*common, f"rare{rng.randint(0, 39)}x{rng.randint(0, 11)}", "other", "more"]) for _ in range(300)) for _ in range(50)]
    texts[30] += " " + items[17][1]
    calls = []
    monkeypatch.setattr(decontamination.Index, "useful", lambda self, words, useful=decontamination.Index.useful: calls.append(words) or useful(self, words))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(50)), "text": texts})
    (found,) = decontamination._matcher(*index_of(items))([batch])
    assert [(r["doc_id"], r["item_id"]) for r in found.to_pylist()] == [(30, 17)]
    assert len(calls) <= 5


# ---- 6 suffix dedup ----


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_suffix_dedup(docs, rows, none, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    got = by_row(suffix_dedup.suffix_dedup(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted((r[0], *x) for r, x in zip(rows, brute.repeated(rows), strict=True))
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_suffix_dedup_of_random_overlaps(spark):
    rng = random.Random(8)
    pool = ["".join(rng.choice("abc ") for _ in range(rng.randint(150, 420))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [p[rng.randint(0, 60) : rng.randint(len(p) - 60, len(p))] for p in rng.choices(pool, k=rng.randint(1, 3))]
        rows.append((i, "".join(parts) + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 90))), "s"))
    got = by_row(suffix_dedup.suffix_dedup(brute.docs_frame(spark, rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted((r[0], *x) for r, x in zip(rows, brute.repeated(rows), strict=True))


def test_suffix_dedup_broadcasts_no_keys(spark):
    """Spark takes the files of the keys for the size of the rows that are made of them, one for each salt."""
    rng = random.Random(22)
    passage = brute.prose(rng, 45)
    docs = brute.docs_frame(spark, [(i, brute.prose(rng, 5) + passage + brute.prose(rng, 5), "s") for i in range(20)])
    keys = suffix_dedup._repeated(spark.range(100).selectExpr("id % 7 as anchor", "int(id % 8) as salt"), ["anchor"], "keys")
    for df in (keys, suffix_dedup.suffix_dedup(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_long_texts_are_cut(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_PIECE", 1000)
    rng = random.Random(9)
    body = "".join(rng.choice("abcdefgh") for _ in range(5000))
    texts = [(1, body), (2, "zz" + body[700:4300])]
    from collections import Counter

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in texts]), pa.array([d for d, _ in texts]), pa.array([t for _, t in texts])], names=["d1", "d2", "text"])
    starts = Counter()
    for b in suffix_dedup._find_runs(iter([batch])):
        for doc, first, count in zip(*(b.column(c).to_pylist() for c in ("d1", "first", "count")), strict=True):
            starts.update((doc, s) for s in range(first, first + count))
    assert set(starts.values()) == {1} and len(starts) == sum(len(t) - 199 for _, t in texts)


def test_many_equal_rows_and_a_shared_passage(spark):
    rng = random.Random(21)
    base, passage = brute.prose(rng, 90), brute.prose(rng, 45)
    rows = [(7, base, "s")] * 60 + [(i, base, "s") for i in range(100, 140)] + [(None, base, "s")] * 5 + [(i, brute.prose(rng, 5) + passage + brute.prose(rng, 5), "s") for i in range(200, 260)]
    got = [tuple(r) for r in suffix_dedup.suffix_dedup(brute.docs_frame(spark, rows).repartition(7)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=str) == sorted(((r[0], *x) for r, x in zip(rows, brute.repeated(rows), strict=True)), key=str)


def test_deep_shallow_order():
    rng = random.Random(1)
    for _ in range(300):
        s = [bytes(rng.choice(b"\0ab") for _ in range(24)) for _ in range(rng.randint(1, 12))]
        s += rng.choices(s, k=3) + [s[0][:17] + bytes(7)]
        rows = np.frombuffer(b"".join(s), np.uint8).reshape(-1, 24)
        group = np.array([rng.randrange(2) for _ in s])
        order = suffix_dedup.deep_shallow(rows, group)
        assert [(group[i], s[i]) for i in order] == sorted((g, x) for g, x in zip(group, s, strict=True))
        trie = suffix_dedup.BlindTrie(s)
        assert [s[i] for i in trie.order()] == sorted(s)
        words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
        order, part, depth = suffix_dedup._multikey_quicksort(words, group)
        assert [(group[i], s[i]) for i in order] == sorted((g, x) for g, x in zip(group, s, strict=True))
        assert all((part[a] == part[b]) == (group[order[a]] == group[order[b]] and s[order[a]] == s[order[b]]) for a in range(len(s)) for b in range(len(s)))


# ---- 7 line dedup, 8 mixing, 9 near duplicates: SQL and edge cases ----


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(llm_queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = llm_queries.queries()[name](spark, DATA).toPandas(), duck.execute(llm_queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    assert sorted(map(str, got[order].itertuples(index=False))) == sorted(map(str, want[order].itertuples(index=False)))


def test_line_dedup(spark):
    pages = [(i, f"http://h.org/{i}", f"<p>Menu</p><p>Menu</p><p>page {i}</p>") for i in range(5)] + [(5, "http://h.org/5", None), (6, None, "<p>Menu"), (7, "http://few.org/", "<p>Menu &amp; more"), (8, "http://few.org/2", "<p>Menu &amp; more"), (0, "http://h.org/0", "<p>Menu</p><p>Menu</p><p>page 0</p>")]
    df = spark.createDataFrame([(*p, 1, "x") for p in pages], "page_id bigint, url string, html string, n int, lines string")
    got = by_row(line_dedup.line_dedup(df), "page_id", "n_lines", "n_dropped", "text")
    assert got == sorted([(i, 3, 2, f"page {i}") for i in range(5)] + [(0, 3, 2, "page 0"), (5, 0, 0, ""), (6, 1, 0, "Menu"), (7, 1, 0, "Menu & more"), (8, 1, 0, "Menu & more")])
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_native_operators_run_no_python(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    for df in (line_dedup.line_dedup(pages), mixing.mix(spark.read.parquet(f"{DATA}/documents.parquet"))):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))


def test_mixing(docs, rows, none, monkeypatch):
    got = mixing.mix(docs).collect()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(brute.SPACE_WORD.findall(t or ""))
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, mixing.SHARE * sum(size.values()), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * size[s]]
        if not over:
            target.update({s: weight[s] * level for s in free})
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
            free.discard(s)
    assert len(got) == len(rows)
    taken = dict.fromkeys(names, 0)
    for r in got:
        assert math.isclose(r["target"], target[r["source"]]) and r["source_size"] == size[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(none).count() == mixing.mix(docs.where("doc_id = 0")).count() - 1 == 0
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    monkeypatch.setattr(mixing, "CELL_ROWS", 1)
    monkeypatch.setattr(mixing, "FAN", 1)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.undo()
    repeated = mixing.repeat_by_share(docs.where("doc_id > 6"))
    assert repeated.columns == docs.columns and repeated.count() > 0


def test_rows_without_an_id(spark):
    df = brute.docs_frame(spark, [(None, "one two three four five six", "s"), (None, "one two three four five six", "s"), (None, None, None), (4, "a b", None)])
    for query in (secrets.secret_digest, mixing.mix, suffix_dedup.suffix_dedup, near_duplicates.near_duplicates, transport.media_features, lambda d: token_files.read_digests(token_files.write_tokens(d)), lambda d: toxicity.score(d, toxicity.Model())):
        assert query(df).count() == 4
    assert near_duplicates.keep_one(df).count() == 4
    assert decontamination.contaminated(df, spark.createDataFrame([(None, "two three four five six")], "item_id bigint, text string")).count() == 2


def test_small_sources_reach_their_targets(spark):
    sources = [("big", 10_000_000), *((f"small-{i:02}", 100) for i in range(20)), ("none", 0)]
    goal = mixing.targets(spark.createDataFrame(sources, "source string, source_size bigint"))
    target = {r["rank"]: r["target"] for r in goal.collect()}
    assert sorted(target.values())[:2] == [0.0, 200.0] and len(target) == 22
    slots = mixing.schedule(goal).collect()
    assert len({r["slot"] for r in slots}) == len(slots)
    for rank, t in target.items():
        assert sorted(r["place"] for r in slots if r["rank"] == rank) == list(range(math.ceil(t / mixing.BLOCK)))
        order = sorted((r["slot"], r["place"]) for r in slots if r["rank"] == rank)
        assert [p for _, p in order] == list(range(len(order)))
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("if(id < 3980, 'big', 'small-' || id)").alias("source"), F.expr("if(id < 3980, repeat('w ', 2500), 'a b c')").alias("text"))
    got = mixing.mix(docs).collect()
    assert {r["taken"] for r in got if r["source"] != "big"} == {6}
    assert abs(sum(r["taken"] for r in got if r["source"] == "big") - next(r["target"] for r in got if r["source"] == "big")) <= 1


def test_van_der_corput(spark):
    slots = [r["p"] for r in spark.range(8).select(mixing.reversed_bits(F.col("id"), 3).alias("p")).collect()]
    assert slots == [0, 4, 2, 6, 1, 5, 3, 7]
    far = [(1 << 33) + 5, (1 << 61) + 3, (1 << 62) - 1]
    got = [r["p"] for r in spark.createDataFrame([(x,) for x in far], "k bigint").select(mixing.reversed_bits(F.col("k"), 62).alias("p")).collect()]
    assert got == [int(f"{x:062b}"[::-1], 2) for x in far]


@pytest.mark.parametrize(("width", "percent", "most"), [(3, 85, None), (5, 80, None), (3, 85, 0), (5, 80, 0)])
def test_near_duplicates(docs, rows, none, monkeypatch, width, percent, most):
    if most is not None:
        monkeypatch.setattr(near_duplicates, "MOST_PAIRS", most)
    want = brute.components(rows, width, percent)
    got = by_row(near_duplicates.near_duplicates(docs, width, percent), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted((i, len(brute.shingle_set(t, width)), want[i], i == want[i]) for i, t, _ in rows)
    assert near_duplicates.near_duplicates(none, width, percent).count() == 0


@pytest.mark.parametrize("most", [10_000, 0])
def test_near_group_of_many_edits(spark, monkeypatch, most):
    monkeypatch.setattr(near_duplicates, "MOST_PAIRS", most)
    rng = random.Random(12)
    base = brute.prose(rng, 160).split()
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 5, 6])):
            w[rng.randrange(len(w))] = brute.prose(rng, 1)
        rows.append((i, " ".join(w), "s"))
        if i % 40 == 39:
            base = w
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(brute.docs_frame(spark, rows), 3, 85).collect()}
    assert got == brute.components(rows, 3, 85)


def _around_a_passage(n):
    """Texts around one passage, of which some are a few words from their neighbour."""
    rng = random.Random(31)
    passage, rows = brute.prose(rng, 90), []
    for i in range(n):
        tail = brute.prose(rng, rng.choice([4, 10, 14, 20, 90])).split() if i % 5 else [*tail[:-1], brute.prose(rng, 1)] if i else ["end"]
        rows.append((i, f"{passage} {' '.join(tail)}" if i % 7 else f"{' '.join(tail)} {passage}", "s"))
    return rows


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_rare_shingles_lose_no_link(spark, width, percent):
    rows = _around_a_passage(120)
    frame = spark.createDataFrame([(i, i, t) for i, t, _ in [*rows, *rows[:3], (500, "", "s")]], "rep bigint, comp bigint, text string")
    got = {tuple(sorted(r)) for r in near_duplicates._by_rare_shingles(frame, width, percent).collect()}
    sets = [brute.shingle_set(t, width) for _, t, _ in rows]
    links = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}
    assert links and links <= got and len(got) < 120 * 119 / 2


def test_texts_around_one_passage(spark, monkeypatch):
    rows = _around_a_passage(300)
    by_rare, calls = near_duplicates._by_rare_shingles, []
    monkeypatch.setattr(near_duplicates, "MOST_PAIRS", 1_000)
    monkeypatch.setattr(near_duplicates, "_by_rare_shingles", lambda *args: calls.append(args[0].count()) or by_rare(*args))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(brute.docs_frame(spark, rows), 3, 85).collect()}
    assert got == brute.components(rows, 3, 85) and calls[0] > 40


def test_keep_one(docs, rows):
    kept = near_duplicates.keep_one(docs, 3, 85)
    want = brute.components(rows, 3, 85)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({i for i, r in want.items() if i == r})


def test_sketches_never_exclude_a_link():
    rng = np.random.default_rng(3)
    for n in (4, 40, 600):
        a = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = a.copy()
        b[: max(1, n // 14)] = rng.integers(0, 1 << 63, max(1, n // 14), dtype=np.uint64)
        sa, sb = (near_duplicates.odd_sketch(x, near_duplicates.SET_WORDS).view(np.uint64) for x in (a, b))
        assert sum(int(x ^ y).bit_count() for x, y in zip(sa, sb, strict=True)) <= 2 * max(1, n // 14)


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r["node"]: r["comp"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


# ---- 10 transport streams ----


@pytest.mark.parametrize("n", [0, 1, 162, 163, 191, 192, 193, 345, 346, 347, transport.AU, transport.AU + 1, 200_000])
def test_transport_round_trip(n):
    payload = transport.padded(os.urandom(n))
    media = transport.mux(payload)
    x = transport.demux(media)
    assert x["payload"] == payload and x["cc_errors"] == 0 and len(media) % transport.PACKET == 0
    assert x["pts"] == [i * transport.AU * transport.CLOCK // transport.RATE for i in range(-(-len(payload) // transport.AU))]
    assert x["rap"] == x["pts"][:: transport.RAP_EVERY]


def test_broken_streams_are_reported():
    media = transport.mux(transport.padded(os.urandom(5000)))
    cut = media[: 188 * 5] + media[188 * 6 :]
    assert transport.demux(cut)["cc_errors"] == 1
    assert transport.demux(b"")["pid"] == transport.demux(media[188:])["pid"] == -1
    assert transport.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_media_features(docs, rows, none):
    got = by_row(transport.media_features(docs), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    want = []
    for i, t, _ in rows:
        raw = (t or "").encode()
        p = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert got == sorted(want)
    assert transport.media_features(none).count() == 0
