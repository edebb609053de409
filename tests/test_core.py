import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import vectors as V
from nearfield.operators import kmeans, ranges
from nearfield.operators.search import post_filtered, search, search_batch
from nearfield.plans import evaluate
from nearfield.plans.planner import code_of, plan_search
from nearfield.sources import ingest, table
from nearfield.sources.inspect import inspect, main
from nearfield.sources.scratch import remove, scratch
from nearfield.streaming import append
from nearfield.streaming.append import append_batches, open_batches
from tests.helpers import frame, ids, make_vectors, nearest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def vec(*values):
    return V.vector_literal(values).cast("array<float>")


def test_scalar_math(spark):
    assert one(spark, V.dot(vec(1, 2, 3), vec(4, 5, 6))) == 32
    assert one(spark, V.euclidean(vec(0, 0), vec(3, 4))) == 5
    assert one(spark, V.cosine(vec(1, 0), vec(-2, 0))) == -1
    assert one(spark, V.cosine(vec(0, 0), vec(1, 2))) == 0
    assert np.allclose(one(spark, V.l2_normalize(vec(3, 4))), [0.6, 0.8])
    assert one(spark, V.l2_normalize(vec(0, 0))) == [0, 0]
    for f in (V.dot, V.cosine, V.euclidean):
        with pytest.raises(Exception, match="lengths differ"):
            one(spark, f(vec(1, 2), vec(1, 2, 3)))


@pytest.mark.parametrize("dim", [1, 7, 24, 40, 64, 65, 100])
def test_codes_of_any_dimension(spark, dim):
    rows = make_vectors(20, dim, 3)
    rows[0] = (0, "vec-0", [0.0] * dim)
    rows[1] = (1, "vec-1", [-0.0] * dim)
    got = frame(spark, rows).select("n", V.sign_code(F.col("vector"), dim).alias("c")).withColumn("bits", V.code_bits(F.col("c"), dim)).orderBy("n").collect()
    q = code_of(rows[5][2])
    for r, (_, _, v) in zip(got, rows, strict=True):
        assert r["bits"] == "".join("1" if x >= 0 else "0" for x in v)
        assert [w % (1 << 64) for w in r["c"]] == code_of(v)
    far = frame(spark, rows).select("n", V.hamming(V.sign_code(F.col("vector"), dim), kmeans.code_literal(q)).alias("h")).orderBy("n").collect()
    assert [r["h"] for r in far] == [sum((x >= 0) != (y >= 0) for x, y in zip(v, rows[5][2], strict=True)) for _, _, v in rows]


def test_nan_sets_no_bit(spark):
    assert one(spark, V.code_bits(V.sign_code(vec(float("nan"), 1, -1), 3), 3)) == "010"


def test_sql_functions(spark):
    rows = make_vectors(30, 8, 4)
    frame(spark, rows).withColumnRenamed("n", "row_index").createOrReplaceTempView("some_vectors")
    V.register_sql(spark, "some_vectors")
    got = spark.sql("select * from vector_search((select vector from some_vectors where row_index = 3), 4)").orderBy("rank").collect()
    assert [r["id"] for r in got] == nearest(rows, rows[3][2], 4)
    assert spark.sql("select vector_hamming(array(5L, 1L), array(1L, 3L)) as h").first()["h"] == 2


def test_float_bytes_round_trip(spark):
    values = [0.0, -0.0, 1.5, -2.25, 1e-40, 3.0e38, -7.25e-12]
    df = spark.createDataFrame([("a", values)], "id string, vector array<float>")
    back = ingest.from_bytes(df.select("id", V.pack_floats(F.col("vector")).alias("raw")), "id", "raw", len(values)).first()["vector"]
    assert back == df.first()["vector"]
    with pytest.raises(Exception, match="vector bytes"):
        ingest.from_bytes(df.select("id", V.pack_floats(F.col("vector")).alias("raw")), "id", "raw", 3).collect()


@pytest.mark.parametrize("metric", V.METRICS)
def test_exact_search_matches_plain_search(spark, metric):
    rows = make_vectors(100, 32, 7)
    rows += [(100, "twin", rows[42][2]), (101, "zero", [0.0] * 32)]
    t = table.build(frame(spark, rows), 32, order_by=("n",), normalize=False, binary=False, metric=metric)
    got = search(t, rows[42][2], 6)
    assert ids(got) == nearest(rows, rows[42][2], 6, metric)
    assert got.columns == ["rank", "id", "score", "row_index"]
    assert len(ids(search(t, rows[42][2], 500))) == 102


def test_metric_override(spark):
    rows = [(0, "a", [1.0, 0.0, 0.0, 0.0]), (1, "b", [0.0, 1.0, 0.0, 0.0]), (2, "c", [0.9, 0.1, 0.0, 0.0])]
    t = table.build(frame(spark, rows), 4, order_by=("n",), normalize=False)
    assert ids(search(t, [1, 0, 0, 0], 3, metric="euclidean")) == ["a", "c", "b"]


@pytest.mark.parametrize("lazy", [True, False])
def test_rerank_and_limits(spark, lazy):
    rows = make_vectors(200, 64, 23)
    t = table.build(frame(spark, rows), 64, order_by=("n",), binary=True)
    q = rows[42][2]
    exact = ids(search(t, q, 10, rerank_factor=0))
    assert exact == ids(search(t, q, 10, algorithm="exact"))
    assert ids(search(t, q, 10, rerank_factor=20, lazy=lazy)) == exact  # the pool holds all rows
    assert ids(search(t, q, 1, lazy=lazy)) == ["vec-42"]
    assert plan_search(t, q, 3, rerank_factor=1.5).pool == 5
    assert plan_search(t, q, 3, rerank_factor=0.1).pool == 3


def test_clustered_search_written_and_prefetched(spark):
    rows = make_vectors(500, 64, 11)
    path = scratch(spark, "test")
    t = table.write_vectors(frame(spark, rows), path, 64, order_by=("n",), clusters=8)
    opened = table.open_table(spark, path)
    assert opened.meta == table.Meta(64, "cosine", True, True, 8) and sum(opened.counts) == 500
    assert [r["row_index"] for r in opened.rows.select("row_index").orderBy("row_index").collect()] == list(range(500))
    for i in (3, 199, 444):
        plain = ids(search(t, rows[i][2], 5))
        assert plain[0] == f"vec-{i}" and plain == ids(search(table.prefetch_codes(opened), rows[i][2], 5)) == ids(search(opened, rows[i][2], 5, lazy=False))
        assert ids(search(opened, rows[i][2], 5, probe=1.0, rerank_factor=100)) == ids(search(opened, rows[i][2], 5, algorithm="exact"))
    plan = search(opened, rows[3][2], 5)._jdf.queryExecution().executedPlan().toString()
    assert "cluster_id" in plan and "PartitionFilters: [cluster_id" in plan.replace("isnotnull(cluster_id#", "cluster_id") or "IN (" in plan
    shown = {r["property"]: r["value"] for r in inspect(spark, path).collect()}
    assert shown["clusters"] == "8" and shown["vectors"] == "500" and shown["raw_bytes"] == str(500 * 256)


def test_write_options(spark):
    df = frame(spark, make_vectors(50, 8))
    with pytest.raises(ValueError, match="invalid dimension"):
        table.build(df, 0)
    with pytest.raises(ValueError, match="clusters need codes"):
        table.build(df, 8, clusters=2, binary=False)
    with pytest.raises(ValueError, match="unsupported metric"):
        table.build(df, 8, metric="manhattan")
    one_bad = spark.createDataFrame([(i, f"vec-{i}", [1.0] * (3 if i == 7 else 4)) for i in range(20)], "n bigint, id string, vector array<float>")
    with pytest.raises(Exception, match="vec-7 has not 4"):
        table.build(one_bad, 4, order_by=("n",)).rows.collect()
    bad = spark.createDataFrame([(0, "x", [1.0, None])], "n bigint, id string, vector array<float>")
    with pytest.raises(Exception, match="x has a null or NaN"):
        table.build(bad, 2, order_by=("n",)).rows.collect()
    assert table.auto_codes(50, None, None) == (False, 0)
    assert table.auto_codes(10_000, None, None) == (True, 50)
    assert table.auto_codes(300, None, 4) == (True, 4)
    assert table.auto_codes(20_000, True, None) == (True, 0)
    with pytest.raises(ValueError, match="no vector table"):
        path = scratch(spark, "plain")
        df.write.parquet(f"{path}/rows")
        table.open_table(spark, path)


def test_round_trip_and_slices(spark):
    rows = make_vectors(25, 16, 42)
    path = scratch(spark, "slices")
    t = table.write_vectors(frame(spark, rows).withColumn("tag", F.col("n") % 3), path, 16, order_by=("n",), normalize=False, binary=True, keep=("tag",))
    got = table.read_vectors(t, 5, 9).orderBy("row_index").collect()
    assert [(r["id"], r["vector"], r["metadata"]["tag"]) for r in got] == [(i, v, n % 3) for n, i, v in rows[5:9]]
    assert "metadata" not in table.read_vectors(t, include_metadata=False).columns


def test_empty_table(spark):
    t = table.build(frame(spark, []), 4, order_by=("n",), binary=True)
    assert ids(search(t, [1, 2, 3, 4], 3)) == []
    t = table.build(frame(spark, []), 4, order_by=("n",), clusters=3)
    assert t.rows.count() == 0


def test_multi_source(spark):
    rows = make_vectors(100, 32, 9)
    whole = table.build(frame(spark, rows), 32, order_by=("n",))
    parts = [table.build(frame(spark, p), 32, order_by=("n",)) for p in (rows[:50], rows[50:])]
    got = search(parts, rows[37][2], 7)
    assert ids(got) == ids(search(whole, rows[37][2], 7)) and "source_index" in got.columns
    assert "source_index" not in search([whole], rows[37][2], 3).columns
    tied = search([whole, whole], rows[37][2], 2).orderBy("rank").collect()
    assert [r["source_index"] for r in tied] == [0, 1]
    other = table.build(frame(spark, rows), 32, order_by=("n",), metric="dot")
    with pytest.raises(ValueError, match="different metrics"):
        search([whole, other], rows[0][2])


def test_option_errors(spark):
    t = table.build(frame(spark, make_vectors(20, 16)), 16, order_by=("n",))
    for call, message in ((lambda: search(None, [1]), "source"), (lambda: search([], [1]), "empty"), (lambda: search(t, [1]), "dimension"), (lambda: search(t, [1] * 16, 0), "top_k"), (lambda: search(t, [1] * 16, algorithm="x"), "algorithm"), (lambda: search(t, [1] * 16, algorithm="binary"), "codes"), (lambda: search(t, [1] * 16, metric="x"), "metric"), (lambda: search(t, [math.nan] * 16), "NaN")):
        with pytest.raises(ValueError, match=message):
            call()


def test_batch_equals_single(spark):
    rows = make_vectors(120, 24, 5)
    t = table.build(frame(spark, rows), 24, order_by=("n",), binary=True)
    q = frame(spark, rows[:7]).select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    for how in ({}, {"algorithm": "binary", "rerank_factor": 3}):
        got = {}
        for r in search_batch(t, q, 4, **how).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["id"])
        for _, i, v in rows[:7]:
            assert got[i] == ids(search(t, v, 4, **(how or {"algorithm": "exact"})))
    alone = search_batch(t, q, 2, exclude_self=True).where("query_id = id").count()
    assert alone == 0 and search_batch(t, q.limit(0), 2).count() == 0


def test_filters(spark):
    rows = make_vectors(60, 16, 6)
    t = table.build(frame(spark, rows).withColumn("tag", F.col("n") % 4), 16, order_by=("n",), binary=True, keep=("tag",))
    own = [r for r in rows if r[0] % 4 == 1]
    assert ids(search(t, rows[1][2], 5, where=F.col("tag") == 1, algorithm="exact")) == nearest(own, rows[1][2], 5)
    assert ids(post_filtered(t, rows[1][2], 5, F.col("tag") == 1, 12, keep=("tag",), algorithm="exact")) == nearest(own, rows[1][2], 5)


def plain_kmeans(codes, dim, k, iterations, seed):
    n, rng = len(codes), kmeans.Lcg(seed)
    bits = np.array([[(c[i // 64] >> i % 64) & 1 for i in range(dim)] for c in codes])
    cent = bits[rng.distinct(n, min(k, n))]
    label = np.zeros(n, int)
    for it in range(iterations):
        label = np.array([int(np.argmin((b != cent).sum(1))) for b in bits])
        if it == iterations - 1:
            break
        cent = np.array([bits[rng.below(n)] if not (label == c).any() else (bits[label == c].sum(0) > (label == c).sum() // 2).astype(int) for c in range(len(cent))])
    return label.tolist()


@pytest.mark.parametrize(("n", "dim", "k", "seed"), [(60, 40, 5, 1), (30, 65, 12, 3), (12, 8, 12, 0), (9, 16, 20, 2)])
def test_kmeans_matches_a_plain_one(spark, n, dim, k, seed):
    rows = make_vectors(n, dim, 2)
    if dim == 8:
        rows = [(i, s, rows[i % 3][2]) for i, s, _ in rows]  # equal codes leave clusters empty
    codes = [code_of(v) for _, _, v in rows]
    df = frame(spark, rows).select(F.col("n").alias("ordinal"), V.sign_code(F.col("vector"), dim).alias("code"))
    got = kmeans.binary_kmeans(df, dim, k, 4, seed).assigned.orderBy("ordinal").collect()
    assert [r["cluster"] for r in got] == plain_kmeans(codes, dim, k, 4, seed)


def test_centroid_walk():
    assert kmeans.reorder([[0b1111], [0], [0b0111], [0b1]]) == [3, 0, 2, 1]
    assert kmeans.reorder([]) == []


def test_ranges(spark):
    assert [ranges.probe_count(*a) for a in ((500,), (100,), (500, 0.25), (500, 200), (40,), (8, 1), (8, 0), (8, 1.5))] == [48, 25, 125, 200, 10, 8, 1, 2]
    df = spark.createDataFrame([(0, 3), (3, 5), (7, 9), (8, 8), (20, 21)], "row_start bigint, row_end bigint")
    assert sorted(map(tuple, ranges.merge_ranges(df).collect())) == [(0, 5), (7, 9), (20, 21)]
    rows = spark.createDataFrame([(x,) for x in (1, 2, 66, 67, 200)], "row_index bigint")
    assert sorted(map(tuple, ranges.coalesce_runs(rows).collect())) == ranges.runs_of([200, 1, 2, 66, 67]) == [(1, 68), (200, 201)]


def test_evaluation(spark):
    truth = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "query_id string, rank int, id string")
    found = spark.createDataFrame([("a", 1, "y"), ("b", 1, "q")], "query_id string, rank int, id string")
    assert evaluate.recall_macro(truth, found, 10).first()["recall"] == 0.25
    assert evaluate.recall_micro(truth, found, 10).first()["recall"] == pytest.approx(1 / 3)
    targets = spark.createDataFrame([("a", "y"), ("b", "none")], "query_id string, target_id string")
    assert tuple(evaluate.hits_and_mrr(truth, targets).first()) == (0.0, 0.5, 0.25)
    values = spark.createDataFrame([(float(x % 37),) for x in range(500)], "value double")
    data = sorted(float(x % 37) for x in range(500))
    assert tuple(evaluate.nearest_rank_percentiles(values, "value", (0.0, 0.5, 0.99, 1.0)).first()) == (data[0], data[250], data[495], data[499])
    assert [r["row_index"] for r in evaluate.sample_queries(spark.range(100).withColumnRenamed("id", "row_index"), 4).orderBy("row_index").collect()] == [20, 40, 60, 80]


def test_conversation_pairs(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c"), (1, 4, "assistant", "d"), (2, 0, "assistant", "e"), (2, 1, "user", ""), (2, 2, "assistant", "f")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    assert [tuple(r) for r in evaluate.conversation_pairs(df).collect()] == [(1, 2, 3)]
    assert evaluate.conversation_messages(df).count() == 6


def test_streaming_append(spark):
    source, index = scratch(spark, "stream-in"), scratch(spark, "stream-out")
    rows = make_vectors(40, 8, 3)
    for part in (rows[:20], rows[20:]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("n bigint, id string, vector array<float>").option("maxFilesPerTrigger", 1).parquet(source)
    append_batches(stream, index, 8, scratch(spark, "stream-state"), order_by=("n",), binary=True).awaitTermination()
    tables = open_batches(spark, index)
    assert len(tables) == 2
    assert ids(search(tables, rows[31][2], 3, rerank_factor=0))[0] == "vec-31"


def test_command_line(spark, capsys):
    path = scratch(spark, "cli")
    table.write_vectors(frame(spark, make_vectors(10, 8)), path, 8, order_by=("n",))
    assert main(["inspect", path]) == 0
    assert "dimension: 8" in capsys.readouterr().out
    assert main(["inspect", path + "-missing"]) == 1 and main([]) == 1


def test_exact_plan_has_no_shuffle(spark):
    t = table.from_rows(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("row_index"), F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector")), 64)
    from nearfield.operators.search import search_exact

    plan = search_exact(t, plan_search(t, [0.1] * 64), 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_random_vectors(spark):
    from nearfield.functions.generate import random_vectors

    got = random_vectors(spark, 30, 7, 9).orderBy("row_index").collect()
    assert [(r["row_index"], r["id"], r["vector"]) for r in got] == make_vectors(30, 7, 9)


def test_cancel(spark):
    from nearfield.plans.cancel import cancel, tagged

    with tagged(spark, "some-search"):
        assert spark.range(5).count() == 5
    assert cancel(spark, "some-search") == []


def test_evaluations_take_the_stated_queries(spark):
    from nearfield import queries

    assert sorted(int(r["query_id"]) for r in queries._stated(spark, "/root/testdata/sf0.1").collect()) == list(range(0, 2000, 50))


def test_streaming_write_is_narrow(spark):
    rows = make_vectors(300, 24, 1)
    path = scratch(spark, "narrow")
    df = frame(spark, rows).repartitionByRange(5, "n").sortWithinPartitions("n")
    t = table.write_stream(df.withColumn("tag", F.col("n") % 3), path, 24, normalize=False, binary=True, keep=("tag",))
    got = t.rows.orderBy("row_index").collect()
    assert [(r["row_index"], r["id"], r["vector"], r["tag"]) for r in got] == [(n, i, v, n % 3) for n, i, v in rows]
    assert t.meta == table.Meta(24, "cosine", False, True, 0)
    assert ids(search(t, rows[9][2], 3, rerank_factor=100)) == nearest(rows, rows[9][2], 3)


def test_writing_leaves_nothing_cached(spark):
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    table.write_vectors(frame(spark, make_vectors(60, 8)), scratch(spark, "leak"), 8, order_by=("n",))
    table.write_vectors(frame(spark, make_vectors(60, 8)), scratch(spark, "leak"), 8, order_by=("n",), clusters=3)
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before


def test_rerank_of_files_reads_candidate_ranges(spark):
    from nearfield.operators.search import search_rerank

    rows = make_vectors(400, 32, 2)
    t = table.write_vectors(frame(spark, rows), scratch(spark, "ranges"), 32, order_by=("n",), binary=True, row_group_bytes=8192, page_size=1024)
    plan = search_rerank(t, plan_search(t, rows[5][2], 3, rerank_factor=2), 3, lazy=False)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(row_index" in plan and "LessThanOrEqual(row_index" in plan and "vector_bin" not in plan
    assert ids(search(t, rows[5][2], 3)) == ids(search(t, rows[5][2], 3, lazy=True))


def test_ranges_over_many_parts(spark):
    rng = np.random.default_rng(5)
    rows = [(str(rng.integers(3)) if rng.random() < 0.9 else None, int(a), int(a + rng.integers(1, 30))) for a in rng.integers(0, 4000, 900)] + [("0", 0, 3500)]
    df = spark.createDataFrame(rows, "k string, row_start bigint, row_end bigint").repartition(7)
    want = []
    for k in {r[0] for r in rows}:
        last = None
        for _, a, b in sorted(r for r in rows if r[0] == k):
            if last and a <= last[2]:
                last[2] = max(last[2], b)
            else:
                last = [k, a, b]
                want.append(last)
    got = ranges.merge_ranges(df, "k").select("k", "row_start", "row_end").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(tuple(w)) for w in want)


def test_sql_functions_want_equal_lengths(spark):
    V.register_sql(spark)
    for call in ("vector_dot(array(1f), array(1f, 2f))", "vector_l2(array(1f), array(1f, 2f))", "vector_hamming(array(1L), array(1L, 2L))"):
        with pytest.raises(Exception, match="lengths differ"):
            spark.sql(f"select {call}").collect()


def test_walk_of_many_centroids():
    rng = np.random.default_rng(1)
    codes = [[int(x) for x in rng.integers(0, 1 << 63, 2)] for _ in range(70)]
    left, here, want = dict(enumerate(codes)), [0, 0], [0] * 70
    for place in range(70):
        c = min(left, key=lambda i: (kmeans.distance(left[i], here), i))
        want[c], here = place, left.pop(c)
    assert kmeans.reorder(codes) == want


def test_batch_by_cluster_is_many_searches(spark):
    rows = make_vectors(300, 16, 5)
    t = table.write_vectors(frame(spark, rows), scratch(spark, "batch-clusters"), 16, order_by=("n",), clusters=6)
    asked = rows[::50]
    got = search_batch(t, spark.createDataFrame([(i, v) for _, i, v in asked], "query_id string, query array<float>"), 5, algorithm="binary", rerank_factor=2, probe=0.4, by_cluster=True).collect()
    for _, i, v in asked:
        assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i] == ids(search(t, v, 5, rerank_factor=2, probe=0.4))


def test_recall_is_reached(spark):
    from nearfield import queries

    for name in ("recall_rerank", "recall_clustered"):
        r = queries.QUERY_MAP[name](spark, "/root/testdata/sf0.1").first()
        assert r["queries"] == 40 and r["recall"] >= 0.9 and r["rerank_factor"] > 10


def shuffled_inputs(spark):
    """Inputs that end in a shuffle, each of 4,000 rows."""
    rows = spark.range(4000, numPartitions=8).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: (F.col("k") * 31 + i).cast("float")).alias("vector"), (100 + F.col("k") % 20).alias("part"))
    return {
        "aggregate": rows.groupBy("k").agg(*[F.first(c).alias(c) for c in ("id", "vector", "part")]),
        "join": rows.drop("part").join(rows.select("k", "part").hint("merge"), "k"),
        "repartition": rows.repartition("k"),
        "distinct": rows.dropDuplicates(["id"]),
        "sorted": rows.orderBy("part"),
    }


@pytest.mark.parametrize("name", ["aggregate", "join", "repartition", "distinct", "sorted"])
@pytest.mark.parametrize("conf", [{}, {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k"}, {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "37"}])
def test_narrow_write_loses_nothing(spark, name, conf):
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        t = table.write_stream(shuffled_inputs(spark)[name], scratch(spark, "shuffled"), 32, normalize=False, keep=("part", "k"))
        got = t.rows.select("row_index", "id", "part", "k", F.col("vector")[0].alias("v")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(r["row_index"] for r in got) == list(range(4000))
    assert sorted((r["id"], r["part"], r["v"]) for r in got) == sorted((f"v{k}", 100 + k % 20, float(k * 31)) for k in range(4000))


CLASHING = ("part", "place", "start", "ordinal", "code", "cluster", "n", "count", "rank")


@pytest.mark.parametrize("how", ["narrow", "plain", "clustered"])
def test_kept_columns_may_have_any_other_name(spark, how):
    df = frame(spark, make_vectors(60, 16)).withColumnsRenamed({"n": "at"}).select("*", *[(F.col("at") * 10 + i).alias(c) for i, c in enumerate(CLASHING)])
    if how == "narrow":
        t = table.write_stream(df, scratch(spark, how), 16, keep=CLASHING)
    else:
        t = table.write_vectors(df, scratch(spark, how), 16, order_by=("at",), keep=CLASHING, **({"clusters": 4} if how == "clustered" else {}))
    for r in t.rows.collect():
        n = int(r["id"].removeprefix("vec-"))
        assert [r[c] for c in CLASHING] == [10 * n + i for i in range(len(CLASHING))]
    for own in ("id", "row_index", "vector_bin"):
        with pytest.raises(ValueError, match="must not be named"):
            table.write_stream(df.withColumn(own, F.lit("x")), scratch(spark, how), 16, keep=(own,))


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
@pytest.mark.parametrize("cells", [(7, 30), (500, 11)])
def test_many_queries_stay_distributed(spark, monkeypatch, metric, cells):
    from nearfield.operators import search as S

    rows = make_vectors(90, 24, 5)
    t = table.build(frame(spark, rows), 24, order_by=("n",), normalize=False, clusters=4, metric=metric)
    queries = frame(spark, rows).where("n % 2 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    key = lambda df: sorted(map(tuple, df.collect()))
    for options in ({}, {"exclude_self": True}, {"algorithm": "binary", "rerank_factor": 2}, {"algorithm": "binary", "rerank_factor": 2, "by_cluster": True, "probe": 0.5, "exclude_self": True}, {"where": F.col("row_index") % 3 > 0}):
        monkeypatch.setattr(S, "BLOCK", 2048)
        few = key(S.search_batch(t, queries, 4, **options))
        monkeypatch.setattr(S, "BLOCK", 10)
        monkeypatch.setattr(S, "CELL_QUERIES", cells[0])
        monkeypatch.setattr(S, "CELL_ROWS", cells[1])
        many = S.search_batch(t, queries, 4, **options)
        assert key(many) == few and len(few) == 45 * 4
    t.release()


def test_many_queries_are_one_plan(spark, monkeypatch):
    from nearfield.operators import search as S

    t = table.build(frame(spark, make_vectors(20, 8)), 8, order_by=("n",), binary=True)
    queries = spark.range(100_000).select(F.col("id").cast("string").alias("query_id"), F.array(*[(F.rand(i) - 0.5) for i in range(8)]).alias("query"))
    plan = S.search_batch(t, queries, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CoGroup") == 1 and "Union" not in plan


def test_late_ids_and_coalescing_change_nothing(spark):
    rows = make_vectors(400, 32, 9)
    paths = [scratch(spark, "toggles") for _ in range(3)]
    tables = [table.write_vectors(frame(spark, rows[a:b]), p, 32, order_by=("n",), binary=True) for p, (a, b) in zip(paths, ((0, 400), (0, 200), (200, 400)), strict=True)]
    shown = lambda source, **o: [tuple(r) for r in search(source, rows[7][2], 5, rerank_factor=8, **o).collect()]
    for source in (tables[0], tables[1:]):
        want = shown(source, lazy=True)
        assert len(want) == 5
        for o in ({}, {"coalesce": False}, {"late_ids": True}, {"late_ids": True, "lazy": True}, {"late_ids": True, "coalesce": False}):
            assert shown(source, **o) == want


def test_candidates_of_many_tables_come_from_one_job(spark):
    rows = make_vectors(60, 16, 2)
    tables = [table.write_vectors(frame(spark, rows[i : i + 10]), scratch(spark, "many"), 16, order_by=("n",), binary=True) for i in range(0, 60, 10)]
    tracker = spark.sparkContext.statusTracker()
    jobs = []
    for source in (tables[:2], tables):
        group = f"jobs-{len(source)}"
        spark.sparkContext.setJobGroup(group, group)
        assert ids(search(source, rows[13][2], 3, rerank_factor=100))[0] == "vec-13"
        jobs.append(len(tracker.getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_exact_search_of_files_equals_that_of_rows(spark, metric):
    """Rows pass through numpy first there; scores, ties, filters and kept columns of any name are the same."""
    rows = make_vectors(300, 20, 5)
    rows += [(300 + i, f"copy-{i}", rows[7][2]) for i in range(30)] + [(330, "zero", [0.0] * 20)]
    df = frame(spark, rows).withColumn("q", F.col("n") % 3).withColumnRenamed("n", "row")
    t = table.write_vectors(df, scratch(spark, "exact"), 20, order_by=("row",), metric=metric, normalize=False, keep=("q",))
    plain = table.from_rows(t.rows, 20, metric)
    for where, k in ((None, 10), (F.col("q") == 1, 40), (F.col("q") == 9, 5), (None, 1000)):
        got = search(t, rows[7][2], k, algorithm="exact", where=where, keep=("q",)).collect()
        assert got == search(plain, rows[7][2], k, algorithm="exact", where=where, keep=("q",)).collect()
        assert len(got) == min(k, t.rows.where(where if where is not None else F.lit(True)).count())
    from nearfield.operators.search import search_exact

    plan = search_exact(t, plan_search(t, rows[7][2]), 10)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_unrolled_hamming(spark):
    df = spark.createDataFrame([([5, -1, 0], [3, 1, -(1 << 63)]), ([0, 0, 0], [0, 0, 0])], "a array<bigint>, b array<bigint>")
    got = df.select(V.hamming(F.col("a"), F.col("b"), 3).alias("x"), V.hamming(F.col("a"), F.col("b")).alias("y")).collect()
    assert [r["x"] for r in got] == [r["y"] for r in got] == [2 + 63 + 1, 0]
    with pytest.raises(Exception, match="words are due"):
        df.select(V.hamming(F.col("a"), F.slice("b", 1, 2), 3)).collect()


def test_compaction(spark):
    """Tiers, order, kept columns, meta, replayed and half-written batches, two compactions at once, and what vacuum deletes."""
    path, rows = scratch(spark, "tiers"), make_vectors(130, 16, 9)
    q = rows[64][2]
    for b in range(13):
        batch = frame(spark, rows[b * 10 : b * 10 + 10]).withColumn("part", F.col("n") + 100)
        append.append_batch(batch.drop("part") if b == 4 else batch, path, b + (b > 5), 16, narrow=True, binary=b < 3, keep=() if b == 4 else ("part",))  # no batch 6
    before = search(append.open_batches(spark, path), q, 12, algorithm="exact").select("rank", "id", "score").collect()
    live = append.compact(spark, path, fan_in=3)
    assert [(t.tier, t.first, t.last) for t in live] == [(2, 0, 9), (1, 10, 12), (0, 13, 13)]
    tables = append.open_batches(spark, path)
    assert tables[0].meta.normalized and tables[0].meta.binary and not tables[1].meta.binary
    assert [r["id"] for r in tables[0].rows.orderBy("row_index").collect()] == [f"vec-{i}" for i in range(90)]
    assert [r["row_index"] for r in tables[0].rows.orderBy("row_index").collect()] == list(range(90))
    assert [r["part"] for r in tables[0].rows.orderBy("row_index").collect()] == [None if 40 <= i < 50 else i + 100 for i in range(90)]
    after = search(tables, q, 12, algorithm="exact")
    assert after.select("rank", "id", "score").collect() == before
    assert append.compact(spark, path, fan_in=3) == live  # nothing left to merge
    with pytest.raises(Exception, match="exist"):
        append._commit(spark, path, append._manifest(spark, path)[0], live)  # a number is taken once
    append.append_batch(frame(spark, rows[:10]), path, 0, 16)  # run again after it was merged
    table.write_stream(frame(spark, rows[:10]), f"{path}/batch-00000014", 16)
    remove(spark, f"{path}/batch-00000014/clusters")  # not yet ended
    assert append.live_tables(spark, path) == live
    assert after.select("rank", "id", "score").collect() == before  # opened before: still there
    gone = append.vacuum(spark, path)
    assert len(gone) == 12 + 3 and "batch-00000014" not in gone and "batch-00000013" not in gone
    assert search(append.open_batches(spark, path), q, 12, algorithm="exact").select("rank", "id", "score").collect() == before
    with pytest.raises(ValueError, match="fan_in"):
        append.compact(spark, path, fan_in=1)


def test_compaction_clusters_what_had_clusters(spark):
    path, rows = scratch(spark, "tiers"), make_vectors(60, 16, 2)
    for b in range(2):
        append.append_batch(frame(spark, rows[b * 30 : b * 30 + 30]), path, b, 16, order_by=("n",), clusters=3)
    append.compact(spark, path, fan_in=2, clusters=4)
    (t,) = append.open_batches(spark, path)
    assert t.meta.clusters > 1 and sum(t.counts) == 60
    assert ids(search(t, rows[41][2], 3, probe=1.0))[0] == "vec-41"


def test_stream_compacts_as_it_goes(spark):
    source, index = scratch(spark, "stream-in"), scratch(spark, "stream-out")
    rows = make_vectors(40, 8, 3)
    for at in range(0, 40, 10):
        frame(spark, rows[at : at + 10]).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("n bigint, id string, vector array<float>").option("maxFilesPerTrigger", 1).parquet(source)
    append_batches(stream, index, 8, scratch(spark, "stream-state"), fan_in=2, narrow=True).awaitTermination()
    assert [(t.tier, t.first, t.last) for t in append.live_tables(spark, index)] == [(2, 0, 3)]
    assert ids(search(append.open_batches(spark, index), rows[31][2], 3))[0] == "vec-31"


@pytest.mark.parametrize("width", [1, 7, 8, 1000])
def test_range_join(spark, width):
    """Ranges that overlap, repeat, are empty or null or lie across blocks; rows without a number; keys, and columns of equal names as keys only."""
    rng = np.random.default_rng(width)
    rows = [(int(rng.integers(-30, 200)), "ab"[i % 2], i) for i in range(120)] + [(None, "a", 900), (5, None, 901)]
    spans = [(int(a), int(a + rng.integers(-3, 60)), "ab"[i % 2], i) for i, a in enumerate(rng.integers(-40, 200, 60))] + [(None, 5, "a", 80), (0, None, "a", 81), (-40, 220, "b", 82), (-40, 220, "b", 82)]
    left = spark.createDataFrame(rows, "row_index bigint, k string, x int")
    right = spark.createDataFrame(spans, "row_start bigint, row_end bigint, k string, y int")
    joined = ranges.range_join(left, right, "k", width=width)
    assert joined.columns == ["row_index", "k", "x", "row_start", "row_end", "y"]
    fits = [(r, s) for r in rows for s in spans if None not in (r[0], s[0], s[1]) and s[0] <= r[0] < s[1]]
    assert sorted((r["x"], r["y"]) for r in joined.collect()) == sorted((r[2], s[3]) for r, s in fits if r[1] == s[2])
    free = ranges.range_join(left.drop("k"), right.drop("k"), width=width)
    assert sorted((r["x"], r["y"]) for r in free.collect()) == sorted((r[2], s[3]) for r, s in fits)
    plan = free._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_large_pool_reads_the_blocks_that_it_touches(spark, monkeypatch):
    """Beyond DRIVER_POOL the pool is joined; the scan is cut to its blocks, and the result is that of one plan with a semi-join."""
    from nearfield.operators import search as S

    rows = make_vectors(400, 16, 4)
    t = table.write_vectors(frame(spark, rows), scratch(spark, "pool"), 16, order_by=("n",), binary=True, row_group_bytes=2048)
    q = rows[17][2]
    want = search(t, q, 10, rerank_factor=4, lazy=True).collect()
    monkeypatch.setattr(S, "DRIVER_POOL", 5)
    got = search(t, q, 10, rerank_factor=4)
    assert got.collect() == want
    assert search(t, q, 10, rerank_factor=4, where=F.col("row_index") < 0).collect() == []
    monkeypatch.setattr(ranges, "BLOCKS", 10)
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    try:
        plan = search(t, q, 10, rerank_factor=4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "LessThanOrEqual(row_index" in plan.split("PushedFilters")[1] and "LeftSemi" in plan
    chosen = spark.createDataFrame([(3,), (4,), (55,), (399,)], "row_index bigint")
    assert ranges.block_ranges(chosen, 3, 399, 5) == [(3, 83), (363, 400)]
    assert ranges.block_ranges(chosen, 3, 399, 1) == [(3, 400)]


@pytest.mark.parametrize("dim", [1, 63, 64, 65, 200])
def test_codes_of_batches(spark, dim):
    """The same bits as the expression has, also for 0, -0 and infinities; columns that Arrow does not carry come along."""
    rows = make_vectors(50, dim, dim)
    rows += [(90 + i, None, [x] * dim) for i, x in enumerate((0.0, -0.0, float("inf"), float("-inf"), float("nan")))]
    df = frame(spark, rows).withColumn("extra", F.create_map(F.lit("a"), F.col("n")))
    want = df.select("n", V.sign_code(F.col("vector"), dim).alias("vector_bin")).collect()
    assert V.with_codes(df, dim).select("n", "vector_bin").collect() == want
    other = V.with_codes(df.withColumn("odd", F.make_interval(F.lit(1))), dim)
    assert other.select("n", "vector_bin").collect() == want
    assert V.with_codes(df.limit(0), dim).count() == 0


def test_a_large_cluster_is_split(spark):
    same = make_vectors(1, 16)[0][2]
    rows = [(i, s, same if i % 2 else v) for i, s, v in make_vectors(4000, 16)]
    before = table.build(frame(spark, rows).repartition(7), 16, order_by=("n",), normalize=False, clusters=6)
    expected = before.rows.orderBy("cluster_id", F.col("id").substr(5, 9).cast("int")).select("id", "row_index").collect()
    assert [r["row_index"] for r in expected] == list(range(4000))
    written = table.save(before, scratch(spark, "hot"))
    hot = max(written.counts)
    assert sum(written.counts) == 4000 and hot >= 2000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        split = table.write_vectors(frame(spark, rows), scratch(spark, "hot"), 16, order_by=("n",), normalize=False, clusters=6)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in split.rows.groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) < hot / 1.5 and sum(sizes) == 4000  # 4 partitions share the rows
    assert ids(search(split, rows[8][2], 5, probe=1.0, rerank_factor=4000)) == nearest(rows, rows[8][2], 5)


def plain_two_level(codes, dim, k, iterations, seed):
    """Loops over bits; clusters of the codes, by number."""
    far = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b))
    least = lambda c, cents: min(range(len(cents)), key=lambda i: (far(c, cents[i]), i))

    def majority(members):
        bits = [sum(m[i // 64] >> i % 64 & 1 for m in members) for i in range(dim)]
        return [sum(1 << i % 64 for i in range(dim) if i // 64 == w and bits[i] > len(members) // 2) for w in range(len(members[0]))]

    codes = [[w % (1 << 64) for w in c] for c in codes]
    rng, n, few = kmeans.Lcg(seed), len(codes), round(k**0.5)
    coarse = [codes[p] for p in rng.distinct(n, few)]
    for _ in range(iterations - 1):
        near = [least(c, coarse) for c in codes]
        for p in range(few):
            mine = [c for c, x in zip(codes, near) if x == p]
            coarse[p] = majority(mine) if mine else codes[rng.below(n)]
    drawn = [codes[p] for p in kmeans.Lcg(seed + 1).distinct(n, min(n, kmeans.FIRST * k))]
    own = [[c for c in drawn if least(c, coarse) == p] for p in range(few)]
    exact = [len(o) * (k - few) / len(drawn) for o in own]
    share = [1 + int(x) for x in exact]
    for p in sorted(range(few), key=lambda p: (-(exact[p] % 1), p))[: k - sum(share)]:
        share[p] += 1
    fine = []
    for p in range(few):
        unique = []
        for c in own[p]:
            if c not in unique:
                unique.append(c)
        fine.append(unique[: share[p]] or [coarse[p]])
    base = [sum(map(len, fine[:p])) for p in range(few)]

    def assign():
        return [(p, least(c, fine[p])) for c in codes for p in [least(c, coarse)]]

    for _ in range(iterations - 1):
        near = assign()
        fine = [[majority(m) if (m := [c for c, x in zip(codes, near) if x == (p, i)]) else f for i, f in enumerate(fs)] for p, fs in enumerate(fine)]
    return [base[p] + i for p, i in assign()]


@pytest.mark.parametrize("n,dim,k,seed,repeated", [(300, 24, 9, 1, False), (200, 70, 16, 3, False), (120, 8, 12, 2, True), (30, 16, 30, 1, False), (20, 16, 3, 1, False)])
def test_two_level_kmeans_matches_a_plain_one(spark, n, dim, k, seed, repeated):
    rows = make_vectors(n, dim, 2)
    if repeated:
        rows = [(i, s, rows[i % 5][2]) for i, s, _ in rows]
    codes = [code_of(v) for _, _, v in rows]
    df = frame(spark, rows).repartition(3).select(F.col("n").alias("ordinal"), V.sign_code(F.col("vector"), dim).alias("code"))
    found = kmeans.two_level_kmeans(df, dim, k, 3, seed)
    got = [r["cluster"] for r in found.assigned.orderBy("ordinal").collect()]
    assert got == (plain_two_level(codes, dim, k, 3, seed) if k >= 4 else plain_kmeans(codes, dim, k, 3, seed))
    assert max(got) < len(found.centroids) <= k


def test_two_levels_find_what_one_finds(spark):
    centres = make_vectors(40, 32, 9)
    rows = [(i, s, [float(np.float32(0.6 * a + b)) for a, b in zip(v, centres[i % 40][2])]) for i, s, v in make_vectors(3000, 32, 4)]
    recall = {}
    for levels in (1, 2):
        t = table.write_vectors(frame(spark, rows), scratch(spark, "levels"), 32, order_by=("n",), normalize=False, clusters=36, cluster_levels=levels)
        assert sum(t.counts) == t.rows.count() == 3000
        hits = [len(set(ids(search(t, rows[q][2], 10, probe=0.25, rerank_factor=30))) & set(nearest(rows, rows[q][2], 10))) for q in range(0, 3000, 300)]
        recall[levels] = sum(hits) / (10 * len(hits))
    assert recall[2] >= recall[1] - 0.02, recall
    with pytest.raises(ValueError, match="cluster_levels"):
        table.build(frame(spark, rows), 32, clusters=4, cluster_levels=3)
    assert table.build(frame(spark, rows[:0]), 32, clusters=8, cluster_levels=2).rows.count() == 0


def test_reads_of_a_search(spark):
    rows = make_vectors(6000, 64)
    t = table.write_vectors(frame(spark, rows), scratch(spark, "reads"), 64, order_by=("n",), normalize=False, clusters=20)
    found = {r["way"]: r for r in evaluate.search_reads(t, rows[7][2], 10, rerank_factor=1).collect()}
    assert set(found) == {"exact", "rerank", "clustered"} and all(r["results"] == 10 for r in found.values())
    assert found["exact"]["rows"] == 6000 and found["exact"]["bytes"] >= 6000 * 64 * 4
    assert found["clustered"]["bytes"] < found["rerank"]["bytes"] and found["clustered"]["rows"] < 6000
    assert evaluate.reads(spark, lambda: spark.range(5))["bytes"] == 0


def test_sql_search_of_a_pool_and_of_clusters(spark):
    rows = [(i, s, v if i % 3 else [0.5] * 70) for i, s, v in make_vectors(90, 70)]  # equal vectors tie
    t = table.build(frame(spark, rows), 70, order_by=("n",), normalize=False, clusters=5)
    t.rows.createOrReplaceTempView("sql_rows")
    table.clusters_frame(spark, t).createOrReplaceTempView("sql_clusters")
    frame(spark, [rows[0], rows[4], rows[3]]).createOrReplaceTempView("sql_asked")  # two of them equal
    t.rows.drop("vector_bin", "cluster_id").createOrReplaceTempView("sql_plain")
    names = V.register_sql(spark, "sql_rows", "sql_clusters")
    assert {"vector_search_rerank", "vector_search_probe"} <= set(names)
    assert "vector_search_probe" not in V.register_sql(spark, "sql_rows") and "vector_search_rerank" not in V.register_sql(spark, "sql_plain")
    V.register_sql(spark, "sql_rows", "sql_clusters")
    for call, probe in (("vector_search_rerank(a.vector, 6, 12)", 1.0), ("vector_search_probe(a.vector, 6, 12, 2)", 0.4)):
        got = spark.sql(f"select a.n, r.* from sql_asked a, lateral {call} r").collect()
        for i in (0, 3, 4):
            mine = [(r["rank"], r["id"], r["row_index"]) for r in sorted(got, key=lambda r: r["rank"]) if r["n"] == i]
            wanted = search(t, rows[i][2], 6, probe=probe, rerank_factor=2).select("rank", "id", "row_index").collect()
            assert mine == [tuple(r) for r in wanted]
    codes = spark.sql("select vector_code(vector) as c, row_index from sql_rows").join(t.rows, "row_index")
    assert codes.where(F.col("c") != F.col("vector_bin")).count() == 0


def test_sql_search_pairs_queries_with_blocks_of_codes(spark, monkeypatch):
    monkeypatch.setattr(V, "SQL_ROWS", 16)
    monkeypatch.setattr(V, "SQL_PARTS", 2)
    rows = [(i, s, v if i % 3 else [0.5] * 40) for i, s, v in make_vectors(300, 40, 9)]  # equal vectors tie across blocks
    t = table.build(frame(spark, rows), 40, order_by=("n",), normalize=False, clusters=4)
    t.rows.createOrReplaceTempView("block_rows")
    table.clusters_frame(spark, t).createOrReplaceTempView("block_clusters")
    frame(spark, rows[:5]).createOrReplaceTempView("block_asked")
    V.register_sql(spark, "block_rows", "block_clusters")
    for call, probe in (("vector_search_rerank(a.vector, 6, 12)", 1.0), ("vector_search_probe(a.vector, 6, 12, 2)", 0.5)):
        found = spark.sql(f"select a.n, r.* from block_asked a, lateral {call} r")
        got = found.collect()
        for i in range(5):
            mine = [(r["rank"], r["id"], r["row_index"]) for r in sorted(got, key=lambda r: r["rank"]) if r["n"] == i]
            assert mine == [tuple(r) for r in search(t, rows[i][2], 6, probe=probe, rerank_factor=2).select("rank", "id", "row_index").collect()]
        assert "collect_list" in found._jdf.queryExecution().optimizedPlan().toString()
    t.release()


def test_cold_and_warm_searches_in_rounds(spark, monkeypatch):
    rows = make_vectors(80, 16, 4)
    t = table.write_vectors(frame(spark, rows), scratch(spark, "rounds"), 16, order_by=("n",), binary=True)
    searches, real = [], evaluate.search_batch
    monkeypatch.setattr(evaluate, "search_batch", lambda t, *a, **b: searches.append(t.prefetched is not None) or real(t, *a, **b))
    asked = frame(spark, rows[:33]).select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    got = evaluate.cold_and_warm(t, asked, 4).collect()
    assert [(r["codes"], r["queries"], r["results"]) for r in got] == [("cold", 33, 132), ("warm", 33, 132)]
    assert searches.count(True) == searches.count(False) <= evaluate.ROUNDS and all(r["p50_ms"] <= r["p99_ms"] for r in got)
    assert evaluate.cold_and_warm(t, asked.limit(0), 4).first()["results"] == 0


@pytest.mark.parametrize("cells", [(4096, 1 << 16), (16, 3)])
def test_places_in_pools_give_the_recall_of_searches(spark, monkeypatch, cells):
    from nearfield.operators import search as S

    monkeypatch.setattr(S, "CELL_QUERIES", cells[0])
    monkeypatch.setattr(S, "CELL_ROWS", cells[1])
    monkeypatch.setattr(S, "STEP_ROWS", 7)
    rows = [(i, s, v if i % 7 else [0.5] * 70) for i, s, v in make_vectors(120, 70, 3)]  # equal vectors tie
    rows += [(120 + i, f"twice-{i}", [2 * x for x in v]) for i, (_, _, v) in enumerate(rows[:30])]
    plain = table.from_rows(frame(spark, rows).select(F.col("n").alias("row_index"), "id", "vector", V.sign_code(F.col("vector"), 70).alias("vector_bin")), 70)
    clustered = table.build(frame(spark, rows), 70, order_by=("n",), normalize=False, clusters=5)
    q = frame(spark, rows[::9]).select(F.col("id").alias("query_id"), F.col("vector").alias("query")).persist()
    truth = S.search_batch(plain, q, 8).persist()
    settings = [(k, f, p) for k in (3, 8) for f in (1, 2, 5) for p in (0.2, 0.5, 1.0)]
    for t, got in ((plain, evaluate.pool_recalls(plain, q, truth, settings)), (clustered, evaluate.sweep_recalls(clustered, q, truth, settings))):
        for (k, f, p), r in list(zip(settings, got, strict=True))[:: 1 if cells[1] > 3 else 5]:
            found = S.search_batch(t, q, k, algorithm="binary", rerank_factor=f, probe=p, by_cluster=True)
            assert r == pytest.approx(evaluate.recall_micro(truth, found, k).first()["recall"], abs=1e-12)
    clustered.release()


def test_recall_makes_no_pools(spark, monkeypatch):
    rows = make_vectors(200, 64, 6)
    t = table.build(frame(spark, rows), 64, order_by=("n",), binary=True)
    q = frame(spark, rows[::20]).select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    truth = search_batch(t, q, 5).persist()
    wanted = [(f, evaluate.recall_micro(truth, search_batch(t, q, 5, algorithm="binary", rerank_factor=f), 5).first()["recall"]) for f in (10, 20, 40)]
    monkeypatch.setattr(evaluate, "search_batch", None)
    assert evaluate.factor_for(t, q, truth, 5, 0.9) == next(x for x in wanted if x[1] >= 0.9)


def test_filtered_truth_pairs_rows_and_queries_of_one_value(spark):
    from nearfield.operators.search import search_within

    rows = make_vectors(90, 16, 8)
    df = frame(spark, rows).withColumn("label", F.when(F.col("n") % 10 < 9, F.col("n") % 3))
    t = table.write_vectors(df, scratch(spark, "labelled"), 16, order_by=("n",), keep=("label",))
    q = df.where("n % 8 = 1").select(F.col("id").alias("query_id"), F.col("vector").alias("query"), F.col("label").alias("value"))
    found = search_within(t, q, "label", 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    got, asked = found.collect(), [r for r in rows if r[0] % 8 == 1]
    for i, name, v in asked:
        mine = [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == name]
        assert mine == ([] if i % 10 == 9 else ids(search(t, v, 5, where=F.col("label") == i % 3)))
    assert "CoGroup" in plan
