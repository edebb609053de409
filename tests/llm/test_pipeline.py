"""Each stage of the pipeline against a plain version, on its own input."""

import collections

import corpus_pipeline
import numpy as np
from nearfield.llm import components, decontamination, near_duplicates, token_files
from nearfield.llm.common import stored
from tests.llm import brute

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    first = docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, docs, DATA), f"test-{name}")
        assert after.columns == first.columns
        seen.append((sorted((r["doc_id"], r["text"]) for r in docs.collect()), sorted((r["doc_id"], r["text"]) for r in after.collect())))
        docs = after
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 0").collect()}
    before, after = seen[0]
    assert toxic <= {i for i, _ in after} and set(after) <= set(before)

    before, after = seen[1]
    groups = brute.components([(i, t, None) for i, t in before], 5, 80)
    assert [i for i, _ in after] == sorted({i for i, r in groups.items() if i == r})

    before, after = seen[2]
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    wanted = [grams(decontamination.words_of(t)) for t in items]
    leaks = {i for i, t in before if any(w and len(w & grams(decontamination.words_of(t))) >= 0.8 * len(w) for w in wanted)}
    assert [i for i, _ in after] == [i for i, _ in before if i not in leaks]

    before, after = seen[3]
    copies = collections.Counter(i for i, _ in after)
    assert set(after) <= set(before) and max(copies.values()) <= 2

    blocks = stored(corpus_pipeline.STAGES[-1][1](spark, docs, DATA), "test-tokens").collect()
    encode = token_files.ChunkEncoder(token_files.default_tokenizer()).encode
    start, want = 0, []
    for i, t in after:
        ids = [*np.frombuffer(encode([t])[0], "<u4").tolist(), 1]
        want.append((i, start, len(ids), brute.crc(ids)))
        start += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in blocks) == want
    assert corpus_pipeline.run(spark, DATA).count() == len(want)


def test_rows_without_an_id_and_clashing_columns(spark):
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").limit(2).collect()]
    names = ("__place", "__pass", "__passes", "__id", "part", "copies", "key")
    given = [(1, items[0]), (None, items[0]), (None, "a clean text of some words"), (2, "another clean text"), (2, items[1]), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *[100 * n + j for j in range(len(names))]) for n, (i, t) in enumerate(given)], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} int" for n in names)).coalesce(1)
    shown = lambda df: sorted(tuple(r[n] for n in names) for r in df.collect())
    rows = {n: tuple(100 * n + j for j in range(len(names))) for n in range(len(given))}
    clean = corpus_pipeline.drop_benchmark(spark, docs, DATA)
    assert clean.columns == docs.columns and shown(clean) == [rows[2], rows[3], rows[5]]
    one = corpus_pipeline.drop_near_duplicates(spark, docs, DATA)
    assert one.columns == docs.columns and set(shown(one)) <= set(rows.values()) and {rows[1], rows[2]} <= set(shown(one))
    mixed = corpus_pipeline.mix_sources(spark, docs, DATA)
    assert mixed.columns == docs.columns and set(shown(mixed)) <= set(rows.values())


def test_the_driver_is_spared(spark, monkeypatch):
    """The driver loads no tokenizer, and components that are stars, or were not linked further, take no round more."""
    import tokenizers

    def refused(*_):
        raise AssertionError("loaded by the driver")

    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id bigint, text string")
    monkeypatch.setattr(tokenizers.Tokenizer, "from_file", refused)
    assert {r["bits"] for r in token_files.write_tokens(docs).collect()} == {16}

    kind, rounds = type(docs), []
    plain = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a: rounds.append(1) or plain(self, *a))
    comps = lambda edges: {r["node"]: r["comp"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert comps([(9, 2), (2, 7), (5, 4)]) == {2: 2, 7: 2, 9: 2, 4: 4, 5: 4}
    assert len(rounds) == 1
    rounds.clear()
    assert comps([(1, 3), (3, 2), (8, 8)]) == {1: 1, 2: 1, 3: 1}
    assert len(rounds) == 2

    rounds.clear()
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words, "x"]), " ".join([*words, "y"]), "others " * 3]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id bigint, text string")
    assert [r["component_id"] for r in near_duplicates.near_duplicates(docs).orderBy("doc_id").collect()] == [1, 1, 1, 4]
    assert len(rounds) <= 2
