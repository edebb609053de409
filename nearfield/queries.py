"""The queries of the library over the driver's tables, and the same in DuckDB SQL.

Vectors are those of `embeddings` (64 elements); row numbers are vec_id. Scores are ranked unrounded and shown rounded.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import vectors as V
from nearfield.functions.generate import random_vectors
from nearfield.operators import kmeans, ranges, search
from nearfield.plans import evaluate
from nearfield.plans.planner import code_of, plan_search
from nearfield.sources import ingest, table
from nearfield.sources.inspect import inspect
from nearfield.sources.scratch import scratch
from nearfield.sources.table import VectorTable
from nearfield.streaming import append

DIM, K, PLACES = 64, 10, 6
CLUSTERS, CLUSTER_SEED = 8, 1
#: The stated query set: every row whose id is divisible by 50.
STATED = 50

QUERY_MAP: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if there is any."""

    def add(f):
        QUERY_MAP[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- tables -------------------------------------------------------------------------------------------------------


def _rows(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("row_index"), F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("vector"), "label")


def _coded(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).withColumn("vector_bin", V.sign_code(F.col("vector"), DIM))


def _vector(spark: SparkSession, d: str, vec_id: int) -> list[float]:
    return list(_rows(spark, d).where(F.col("row_index") == vec_id).first()["vector"])


def _table(rows: DataFrame) -> VectorTable:
    return table.from_rows(rows, DIM, "cosine", normalized=False)


def _clustered(spark: SparkSession, d: str) -> VectorTable:
    return table.build(_rows(spark, d).withColumn("n", F.col("row_index")), DIM, order_by=("n",), normalize=False, clusters=CLUSTERS, cluster_seed=CLUSTER_SEED)


def _stated(spark: SparkSession, d: str) -> DataFrame:
    """Every row whose id is divisible by 50."""
    return _rows(spark, d).where(F.col("row_index") % STATED == 0).select(F.col("id").alias("query_id"), F.col("vector").alias("query"))


def _shown(df: DataFrame, *columns: str) -> DataFrame:
    df = df.withColumn("score", F.round("score", PLACES)) if "score" in df.columns else df
    return df.select(*columns) if columns else df


# ---- SQL parts ----------------------------------------------------------------------------------------------------

_Q0 = "q as (select embedding::double[] as q from embeddings where vec_id = 0)"
_COS = "case when sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) = 0 then 0 else list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) end"
_SCORES = {"cosine": _COS.format(a="embedding::double[]", b="q"), "dot": "list_dot_product(embedding::double[], q)", "euclidean": "list_distance(embedding::double[], q)"}
_CODE = "array_to_string(list_transform({v}, lambda x: case when x >= 0 then '1' else '0' end), '')"
_BIT = "bit_count(xor(({a})::bit, ({b})::bit))::int"
_HAM = _BIT.format(a=_CODE.format(v="embedding"), b=_CODE.format(v="q"))
_POOL = f"pool as (select vec_id from embeddings, q order by {_HAM}, vec_id limit {{n}})"


def _ranked(scored: str, k: int = K, desc: bool = True) -> str:
    order = f"score {'desc' if desc else 'asc'}, row_index"
    return f"select (row_number() over (order by {order}))::int as rank, id, round(score, {PLACES}) as score, row_index from ({scored}) order by rank limit {k}"


def _scored(metric: str, source: str = "embeddings, q", extra: str = "") -> str:
    return f"select vec_id::varchar as id, {_SCORES[metric]} as score, vec_id as row_index{extra} from {source}"


# ---- functions ----------------------------------------------------------------------------------------------------


def _function(name: str, metric: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        q = V.vector_literal(_vector(spark, d, 0))
        return _rows(spark, d).select(F.col("row_index").alias("vec_id"), F.round(V.score(F.col("vector"), q, metric), PLACES).alias("score"))

    QUERY_MAP[name] = run
    ORACLES[name] = f"with {_Q0} select vec_id, round({_SCORES[metric]}, {PLACES}) as score from embeddings, q"


def _exact(name: str, metric: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _shown(search.search(_table(_rows(spark, d)), _vector(spark, d, 0), K, metric=metric))

    QUERY_MAP[name] = run
    ORACLES[name] = f"with {_Q0} {_ranked(_scored(metric), desc=metric != 'euclidean')}"


for _m in V.METRICS:
    _function(f"fn_{_m}", _m)
    _exact(f"knn_exact_{_m}", _m)


@query(f"select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), {PLACES}) as norm from embeddings")
def fn_l2_norm(spark, d):
    return _rows(spark, d).select(F.col("row_index").alias("vec_id"), F.round(V.l2_norm(F.col("vector")), PLACES).alias("norm"))


_DOUBLED = "list_transform(embedding, lambda x: (x * 3)::float)"


@query(
    f"with n as (select vec_id, {_DOUBLED} as v, sqrt(list_dot_product({_DOUBLED}::double[], {_DOUBLED}::double[])) as norm from embeddings), "
    f"p as (select vec_id, norm, unnest(range(0, {DIM}))::int as pos, v from n) select vec_id, pos, round(((v[pos + 1])::double / norm)::float::double, {PLACES}) as val from p"
)
def fn_l2_normalize(spark, d):
    rows = _rows(spark, d).select(F.col("row_index").alias("vec_id"), V.l2_normalize(F.transform("vector", lambda x: (x * 3).cast("float"))).alias("v"))
    return rows.select("vec_id", F.posexplode("v").alias("pos", "val")).withColumn("val", F.round(F.col("val").cast("double"), PLACES))


@query(f"select vec_id, {_CODE.format(v='embedding')} as code from embeddings")
def fn_sign_code(spark, d):
    return _coded(spark, d).select(F.col("row_index").alias("vec_id"), V.code_bits(F.col("vector_bin"), DIM).alias("code"))


@query(f"with {_Q0} select vec_id, {_HAM} as hamming from embeddings, q")
def fn_hamming(spark, d):
    q = kmeans.code_literal(code_of(_vector(spark, d, 0)))
    return _coded(spark, d).select(F.col("row_index").alias("vec_id"), V.hamming(F.col("vector_bin"), q).alias("hamming"))


@query("select l_orderkey, l_linenumber, case when l_discount * 100 = floor(l_discount * 100) then (l_discount * 100)::bigint::varchar else (l_discount * 100)::varchar end as id from lineitem")
def fn_id_string(spark, d):
    x = F.col("l_discount") * 100
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", V.id_string(x, "double").alias("id"))


@query(f"with {_Q0} select vec_id, round({_SCORES['cosine']}, {PLACES}) as cosine, round({_SCORES['dot']}, {PLACES}) as dot, round({_SCORES['euclidean']}, {PLACES}) as l2 from embeddings, q")
def fn_sql_functions(spark, d):
    V.register_sql(spark)
    _rows(spark, d).createOrReplaceTempView("nearfield_vectors")
    return spark.sql(f"select row_index as vec_id, round(vector_cosine(vector, q), {PLACES}) as cosine, round(vector_dot(vector, q), {PLACES}) as dot, round(vector_l2(vector, q), {PLACES}) as l2 from nearfield_vectors, (select vector as q from nearfield_vectors where row_index = 0)")


@query(f"with {_Q0} {_ranked(_scored('cosine'), 5)}")
def fn_sql_search(spark, d):
    _rows(spark, d).createOrReplaceTempView("nearfield_vectors")
    V.register_sql(spark, "nearfield_vectors")
    return _shown(spark.sql("select * from vector_search((select vector from nearfield_vectors where row_index = 0), 5)"))


@query(
    "with recursive g(i, st) as (select 1::bigint, (1 * 1664525 + 1013904223) % 4294967296 union all select i + 1, (st * 1664525 + 1013904223) % 4294967296 from g where i < 320) "
    "select (i - 1) // 16 as row_index, ((i - 1) % 16)::int as pos, round((st / 4294967296.0 * 2 - 1)::float::double, 6) as val from g"
)
def lcg_vectors(spark, d):
    rng = kmeans.Lcg(1)
    rows = [(r, [rng.uniform() for _ in range(16)]) for r in range(20)]
    df = spark.createDataFrame(rows, "row_index bigint, v array<double>")
    return df.select("row_index", F.posexplode(F.col("v").cast("array<float>")).alias("pos", "val")).withColumn("val", F.round(F.col("val").cast("double"), PLACES))


@query(
    "with recursive g(i, st) as (select 1::bigint, (7 * 1664525 + 1013904223) % 4294967296 union all select i + 1, (st * 1664525 + 1013904223) % 4294967296 from g where i < 64), "
    "u as (select list((st / 4294967296.0 * 2 - 1) * 0.05 order by i) as u from g), "
    "v as (select vec_id, list_transform(range(1, 65), lambda i: (embedding[i]::double + u[i])::float) as v from embeddings, u) "
    "select vec_id, round(list_dot_product(embedding::double[], list_transform(v, lambda x: (x::double / sqrt(list_dot_product(v::double[], v::double[])))::float)::double[]), 6) as score from v join embeddings using (vec_id)"
)
def perturbed_stated(spark, d):
    rng = kmeans.Lcg(7)
    noise = V.vector_literal([rng.uniform() * 0.05 for _ in range(DIM)])
    rows = _rows(spark, d).withColumn("q", V.l2_normalize(F.zip_with("vector", noise, lambda x, u: (x.cast("double") + u).cast("float"))))
    return rows.select(F.col("row_index").alias("vec_id"), F.round(V.dot(F.col("vector"), F.col("q")), PLACES).alias("score"))


# ---- search -------------------------------------------------------------------------------------------------------


@query(
    f"with {_Q0}, n as (select vec_id, list_transform(embedding, lambda x: (x::double / sqrt(list_dot_product(embedding::double[], embedding::double[])))::float) as embedding from embeddings), "
    f"q2 as (select list_transform(q, lambda x: (x * 2)::float::double) as q from q) {_ranked(_scored('dot', 'n, q2'))}"
)
def knn_metric_override_normalized(spark, d):
    t = table.build(_rows(spark, d).withColumn("n", F.col("row_index")), DIM, order_by=("n",), binary=False)
    return _shown(search.search(t, [2 * x for x in _vector(spark, d, 0)], K, metric="dot"))


@query(f"with {_Q0} select vec_id as row_index, {_HAM} as hamming from embeddings, q order by hamming, row_index limit 100")
def hamming_candidates(spark, d):
    t = _table(_coded(spark, d))
    return search.hamming_candidates(t, plan_search(t, _vector(spark, d, 0), K))


@query(f"with {_Q0}, {_POOL.format(n=100)} {_ranked(_scored('cosine', 'embeddings semi join pool using (vec_id), q'))}")
def knn_rerank(spark, d):
    return _shown(search.search(_table(_coded(spark, d)), _vector(spark, d, 0), K))


@query(f"with {_Q0}, {_POOL.format(n=100)} {_ranked(_scored('cosine', 'embeddings semi join pool using (vec_id), q'))}")
def knn_rerank_by_ranges(spark, d):
    return _shown(search.search(_table(_coded(spark, d)), _vector(spark, d, 0), K, lazy=False))


@query(f"with {_Q0}, {_POOL.format(n=100)} {_ranked(_scored('euclidean', 'embeddings semi join pool using (vec_id), q'), desc=False)}")
def knn_rerank_euclidean(spark, d):
    return _shown(search.search(_table(_coded(spark, d)), _vector(spark, d, 0), K, metric="euclidean", algorithm="binary"))


@query(f"with {_Q0}, {_POOL.format(n=100)} {_ranked(_scored('cosine', 'embeddings semi join pool using (vec_id), q'))}")
def knn_prefetched(spark, d):
    return _shown(search.search(table.prefetch_codes(_table(_coded(spark, d))), _vector(spark, d, 0), K))


def _sweep_sql() -> str:
    parts = [f"select {rf} as rf, rank, id from ({_ranked(_scored('cosine', f'embeddings semi join p{rf} using (vec_id), q'))})" for rf in (1, 2, 5, 20)]
    pools = ", ".join(_POOL.format(n=K * rf).replace("pool as", f"p{rf} as") for rf in (1, 2, 5, 20))
    return f"with {_Q0}, {pools} " + " union all ".join(parts)


@query(_sweep_sql())
def knn_rerank_factor_sweep(spark, d):
    t, q = _table(_coded(spark, d)), _vector(spark, d, 0)
    out = None
    for rf in (1, 2, 5, 20):
        one = search.search(t, q, K, rerank_factor=rf).select(F.lit(rf).alias("rf"), "rank", "id")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"with {_Q0}, h as (select count(*) // 2 as h from embeddings), s as ({_scored('cosine', 'embeddings, q, h', ', (vec_id >= h)::int as source_index')}) "
    f"select (row_number() over (order by score desc, source_index, row_index))::int as rank, id, round(score, {PLACES}) as score, row_index, source_index from s order by rank limit {K}"
)
def knn_multi_source(spark, d):
    rows = _rows(spark, d)
    half = rows.count() // 2
    return _shown(search.search([_table(rows.where(F.col("row_index") < half)), _table(rows.where(F.col("row_index") >= half))], _vector(spark, d, 0), K))


_BATCH = (
    f"select q.vec_id::varchar as query_id, e.vec_id::varchar as id, e.vec_id as row_index, {_COS.format(a='e.embedding::double[]', b='q.embedding::double[]')} as score "
    f"from embeddings e, embeddings q where q.vec_id % {STATED} = 0"
)
_BATCH_RANKED = "select query_id, (row_number() over (partition by query_id order by score desc, row_index))::int as rank, id, score, row_index from ({}) qualify rank <= {}"


@query(f"select query_id, rank, id, round(score, {PLACES}) as score, row_index from ({_BATCH_RANKED.format(_BATCH, K)})")
def knn_batch(spark, d):
    return _shown(search.search_batch(_table(_rows(spark, d)), _stated(spark, d), K))


@query(f"select query_id, rank, id, round(score, {PLACES}) as score, row_index from ({_BATCH_RANKED.format(_BATCH + ' and e.vec_id <> q.vec_id', K)})")
def knn_exclude_self(spark, d):
    return _shown(search.search_batch(_table(_rows(spark, d)), _stated(spark, d), K, exclude_self=True))


_BATCH_POOL = (
    f"select q.vec_id as qid, e.vec_id as vec_id from embeddings e, embeddings q where q.vec_id % {STATED} = 0 "
    f"qualify row_number() over (partition by q.vec_id order by {_BIT.format(a=_CODE.format(v='e.embedding'), b=_CODE.format(v='q.embedding'))}, e.vec_id) <= {{}}"
)
_BATCH_RERANK = _BATCH.replace("from embeddings e, embeddings q where", "from pool join embeddings e using (vec_id) join embeddings q on q.vec_id = qid where")


@query(f"with pool as ({_BATCH_POOL.format(100)}) select query_id, rank, id, round(score, {PLACES}) as score, row_index from ({_BATCH_RANKED.format(_BATCH_RERANK, K)})")
def knn_batch_rerank(spark, d):
    return _shown(search.search_batch(_table(_coded(spark, d)), _stated(spark, d), K, algorithm="binary"))


@query(f"with {_Q0}, s as ({_scored('cosine', 'embeddings, q where label = 3', ', label')}) select (row_number() over (order by score desc, row_index))::int as rank, id, round(score, {PLACES}) as score, row_index, label from s order by rank limit {K}")
def knn_prefilter_label(spark, d):
    return _shown(search.search(_table(_rows(spark, d)), _vector(spark, d, 0), K, where=F.col("label") == 3, keep=("label",)))


@query(
    f"with {_Q0}, s as ({_scored('cosine', extra=', label')}), w as (select * from s order by score desc, row_index limit {5 * K}) "
    f"select (row_number() over (order by score desc, row_index))::int as rank, id, round(score, {PLACES}) as score, row_index, label from w where label = 3 order by rank limit {K}"
)
def knn_postfilter_overfetch(spark, d):
    return _shown(search.post_filtered(_table(_rows(spark, d)), _vector(spark, d, 0), K, F.col("label") == 3, 5, keep=("label",)))


# ---- clustering ---------------------------------------------------------------------------------------------------

_LCG = f"""g(i, st) as (select 1::bigint, ({CLUSTER_SEED} * 1664525 + 1013904223) % 4294967296 union all select i + 1, (st * 1664525 + 1013904223) % 4294967296 from g where i < 64),
n as (select count(*) as n from embeddings),
drawn as (select st % n as vec_id, min(i) as i from g, n group by 1),
init as (select (row_number() over (order by i) - 1)::int as cl, vec_id from drawn order by i limit {CLUSTERS}),
bits as materialized (select vec_id, unnest(range(0, {DIM})) as bi, unnest(list_transform(embedding, lambda x: (x >= 0)::int)) as bit from embeddings),
c0 as materialized (select cl, bi, bit from init join bits using (vec_id))"""


def _steps(n: int) -> str:
    out = []
    for i in range(n):
        out.append(
            f"a{i} as materialized (select vec_id, cl from (select b.vec_id, c.cl, sum((b.bit <> c.bit)::int) as d from bits b join c{i} c using (bi) group by 1, 2) qualify row_number() over (partition by vec_id order by d, cl) = 1)"
        )
        if i < n - 1:
            out.append(f"c{i + 1} as materialized (select cl, bi, (sum(bit) > count(*) // 2)::int as bit from a{i} join bits using (vec_id) group by 1, 2)")
    return ",\n".join(out)


_FULL = f"with recursive {_LCG},\n{_steps(6)}"
_CENTROIDS = "cent as (select cl, string_agg(bit::varchar, '' order by bi)::bit as code from c5 group by cl)"
_WALK = f"""{_CENTROIDS},
walk(place, cl, seen) as (
  select 0, (select cl from cent order by bit_count(code), cl limit 1), [(select cl from cent order by bit_count(code), cl limit 1)]
  union all
  select place + 1, nxt, list_append(seen, nxt) from (
    select w.place, w.seen, (select arg_min(c.cl, bit_count(xor(c.code, h.code)) * 1000 + c.cl) from cent c, cent h where h.cl = w.cl and not list_contains(w.seen, c.cl)) as nxt
    from walk w where w.place < {CLUSTERS - 1})),
clustered as (select e.vec_id, w.place as cluster_id from a5 e join walk w using (cl)),
numbered as (select vec_id, cluster_id, row_number() over (order by cluster_id, vec_id) - 1 as row_index from clustered),
sizes as (select cluster_id, count(*) as row_count from clustered group by 1),
offsets as (select cluster_id, row_count, (sum(row_count) over (order by cluster_id) - row_count)::bigint as row_start from sizes)"""


@query(f"with recursive {_LCG} select cl as cluster, vec_id as row_index from init")
def kmeans_init(spark, d):
    places = kmeans.Lcg(CLUSTER_SEED).distinct(_rows(spark, d).count(), CLUSTERS)
    return spark.createDataFrame(list(enumerate(places)), "cluster int, row_index bigint")


def _kmeans(spark: SparkSession, d: str, iterations: int) -> DataFrame:
    rows = _coded(spark, d).select(F.col("row_index").alias("ordinal"), F.col("vector_bin").alias("code"))
    return kmeans.binary_kmeans(rows, DIM, CLUSTERS, iterations, CLUSTER_SEED).assigned.select(F.col("ordinal").alias("vec_id"), "cluster")


@query(f"with recursive {_LCG}, {_steps(1)} select vec_id, cl as cluster from a0")
def kmeans_assign_1(spark, d):
    return _kmeans(spark, d, 1)


@query(f"{_FULL} select vec_id, cl as cluster from a5")
def kmeans_full(spark, d):
    return _kmeans(spark, d, 6)


@query(f"{_FULL} select a.cl as cluster, b.bi::int as bit, count(*) as n, sum(b.bit)::bigint as ones from a5 a join bits b using (vec_id) group by 1, 2")
def cluster_bit_counts(spark, d):
    rows = _coded(spark, d).select(F.col("row_index").alias("ordinal"), F.col("vector_bin").alias("code"))
    found = kmeans.binary_kmeans(rows, DIM, CLUSTERS, 6, CLUSTER_SEED)
    counts = kmeans.cluster_counts(rows, DIM, found.centroids)
    return spark.createDataFrame([(c, n, ones) for c, (n, ones) in counts.items()], "cluster int, n bigint, ones array<bigint>").select("cluster", "n", F.posexplode("ones").alias("bit", "ones"))


@query(f"{_FULL}, {_WALK} select cl as old_cluster, place::int as cluster_id from walk")
def centroid_reorder(spark, d):
    rows = _coded(spark, d).select(F.col("row_index").alias("ordinal"), F.col("vector_bin").alias("code"))
    found = kmeans.binary_kmeans(rows, DIM, CLUSTERS, 6, CLUSTER_SEED)
    return spark.createDataFrame(list(enumerate(kmeans.reorder(found.centroids))), "old_cluster int, cluster_id int")


@query(f"{_FULL}, {_WALK} select vec_id::varchar as id, row_index, cluster_id::int as cluster_id from numbered")
def cluster_row_order(spark, d):
    return _clustered(spark, d).rows.select("id", "row_index", "cluster_id")


@query(f"{_FULL}, {_WALK} select cluster_id::int as cluster_id, row_count, row_start from offsets")
def cluster_counts_offsets(spark, d):
    return table.clusters_frame(spark, _clustered(spark, d)).select("cluster_id", "row_count", "row_start")


_NEAR = f"{_WALK}, {_Q0}, qc as (select {_CODE.format(v='q')}::bit as code from q), near as (select w.place as cluster_id, row_number() over (order by bit_count(xor(c.code, qc.code)), w.place) as nr from walk w join cent c using (cl), qc)"


@query(f"{_FULL}, {_NEAR} select probe, cluster_id::int as cluster_id from near, (values (0.25, 2), (0.5, 4), (1.0, 8), (2.5, 3), (3.0, 3), (0.0, 1)) as p(probe, n) where nr <= n".replace("select probe,", "select probe::double as probe,"))
def cluster_select_probe(spark, d):
    t, code = _clustered(spark, d), code_of(_vector(spark, d, 0))
    rows = [(p, c) for p in (0.25, 0.5, 1.0, 2.5, 3.0, 0.0) for c in ranges.select_clusters(t.centroids, code, p)]
    return spark.createDataFrame(rows, "probe double, cluster_id int")


_CLUSTER_POOL = f"pool as (select n.vec_id from numbered n join near using (cluster_id) join embeddings e on e.vec_id = n.vec_id, q where nr <= {{n}} order by {_HAM.replace('embedding', 'e.embedding')}, n.row_index limit 100)"


@query(
    f"{_FULL}, {_NEAR}, {_CLUSTER_POOL.format(n=4)} select (row_number() over (order by score desc, row_index))::int as rank, id, round(score, {PLACES}) as score, row_index from "
    f"(select n.vec_id::varchar as id, {_SCORES['cosine'].replace('embedding', 'e.embedding')} as score, n.row_index from pool join numbered n using (vec_id) join embeddings e on e.vec_id = pool.vec_id, q) order by rank limit {K}"
)
def knn_clustered(spark, d):
    return _shown(search.search(_clustered(spark, d), _vector(spark, d, 0), K, probe=0.5))


@query(
    f"{_FULL}, {_NEAR}, {_CLUSTER_POOL.format(n=2)} select (row_number() over (order by score desc, row_index))::int as rank, id, round(score, {PLACES}) as score, row_index from "
    f"(select n.vec_id::varchar as id, {_SCORES['cosine'].replace('embedding', 'e.embedding')} as score, n.row_index from pool join numbered n using (vec_id) join embeddings e on e.vec_id = pool.vec_id, q) order by rank limit {K}"
)
def knn_clustered_written(spark, d):
    path = scratch(spark, "clustered")
    table.write_vectors(_rows(spark, d).withColumn("n", F.col("row_index")), path, DIM, order_by=("n",), normalize=False, clusters=CLUSTERS, cluster_seed=CLUSTER_SEED)
    return _shown(search.search(table.open_table(spark, path), _vector(spark, d, 0), K))


@query("select n::bigint as n, k::int as k from (values (500, 48), (100, 25), (40, 10), (3, 1)) as t(n, k)")
def probe_default(spark, d):
    return spark.createDataFrame([(n, ranges.probe_count(n)) for n in (500, 100, 40, 3)], "n bigint, k int")


@query("select n::bigint as n, (n >= 10000) as codes, case when n >= 10000 then greatest(1, round(sqrt(n) / 2))::int else 0 end as clusters from (values (50), (9999), (10000), (1000000)) as t(n)")
def auto_tuning(spark, d):
    return spark.createDataFrame([(n, *table.auto_codes(n, None, None)) for n in (50, 9999, 10000, 1000000)], "n bigint, codes boolean, clusters int")


# ---- ranges -------------------------------------------------------------------------------------------------------

_ISLANDS = "select {key}, min({a})::bigint as row_start, max({b})::bigint as row_end from (select *, sum(new) over (partition by {key} order by {a}, {b}) as island from ({marked})) group by {key}, island"


@query(
    _ISLANDS.format(
        key="l_returnflag", a="a", b="b", marked="select *, case when a <= max(b) over (partition by l_returnflag order by a, b rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from (select l_returnflag, l_orderkey * 8 as a, l_orderkey * 8 + l_linenumber as b from lineitem)"
    )
)
def merge_ranges(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", (F.col("l_orderkey") * 8).alias("row_start"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_end"))
    return ranges.merge_ranges(rows, "l_returnflag")


@query(
    _ISLANDS.format(key="o_orderstatus", a="k", b="e", marked="select *, case when k - lag(k) over (partition by o_orderstatus order by k) - 1 <= 8 then 0 else 1 end as new from (select o_orderstatus, o_orderkey as k, o_orderkey + 1 as e from orders)")
)
def coalesce_runs(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderstatus", F.col("o_orderkey").alias("row_index"))
    return ranges.coalesce_runs(rows, 8, "o_orderstatus")


# ---- reading and writing ------------------------------------------------------------------------------------------


@query(f"select vec_id::varchar as id, pos, round(embedding[pos + 1]::double, {PLACES}) as val from (select vec_id, embedding, unnest(range(0, {DIM}))::int as pos from embeddings where vec_id >= 100 and vec_id < 110)")
def read_slice(spark, d):
    found = table.read_vectors(_table(_rows(spark, d)), 100, 110)
    return found.select("id", F.posexplode("vector").alias("pos", "val")).withColumn("val", F.round(F.col("val").cast("double"), PLACES))


@query("select vec_id::varchar as id, label from embeddings")
def read_passthrough(spark, d):
    return table.read_vectors(_table(_rows(spark, d))).select("id", F.col("metadata.label").alias("label"))


@query(f"select vec_id as row_index, vec_id::varchar as id, label, round(list_sum(embedding::double[]), {PLACES - 1}) as total from embeddings")
def write_round_trip(spark, d):
    t = table.write_vectors(_rows(spark, d).withColumn("n", F.col("row_index")), scratch(spark, "round-trip"), DIM, order_by=("n",), normalize=False, binary=True, keep=("label",), codec="snappy")
    return t.rows.select("row_index", "id", "label", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), PLACES - 1).alias("total"))


@query("select 'dimension' as property, '64' as value union all select 'metric', 'cosine' union all select 'normalized', 'true' union all select 'codes', 'true' union all select 'clusters', '0' union all select 'vectors', count(*)::varchar from embeddings union all select 'raw_bytes', (count(*) * 256)::varchar from embeddings")
def inspect_stats(spark, d):
    path = scratch(spark, "inspect")
    table.write_vectors(_rows(spark, d), path, DIM, binary=True)
    return inspect(spark, path).where(~F.col("property").isin("path", "bytes", "files", "percent_of_raw"))


@query("select l_orderkey::varchar || ':' || l_linenumber::varchar as id, 1 + l_quantity::float::double as first from lineitem".replace("1 + l_quantity::float::double as first", "l_quantity::float::double as first"))
def ingest_numbers(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("key", F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    return ingest.from_numbers(rows, "key", "l_quantity", "l_extendedprice", "l_discount", "l_tax").select("id", F.get("vector", F.lit(0)).cast("double").alias("first"))


@query(f"with {_Q0} select vec_id::varchar as id, round({_SCORES['dot']}, {PLACES}) as score from embeddings, q")
def ingest_bytes(spark, d):
    stored = _rows(spark, d).select("id", V.pack_floats(F.col("vector")).alias("raw"))
    return ingest.from_bytes(stored, "id", "raw", DIM).select("id", F.round(V.dot(F.col("vector"), V.vector_literal(_vector(spark, d, 0))), PLACES).alias("score"))


@query("select conv_id::varchar || ':' || turn::varchar as id, [length(text)::double, (length(text) - length(replace(text, ' ', '')))::double] as vector from conversations".replace("[length(text)::double, (length(text) - length(replace(text, ' ', '')))::double] as vector", "length(text)::double as chars, (length(text) - length(replace(text, ' ', '')))::double as blanks"))
def ingest_embedder(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet").withColumn("key", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    found = ingest.embed(rows, "key", "text", lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts])
    return found.select("id", F.get("vector", F.lit(0)).cast("double").alias("chars"), F.get("vector", F.lit(1)).cast("double").alias("blanks"))


# ---- evaluation ---------------------------------------------------------------------------------------------------

_TRUTH = f"truth as ({_BATCH_RANKED.format(_BATCH, K)}), pool as ({_BATCH_POOL.format(30)}), found as ({_BATCH_RANKED.format(_BATCH_RERANK, K)})"
_HITS = "hits as (select t.query_id, count(f.id) as hits, count(*) as total from truth t left join found f on t.query_id = f.query_id and t.id = f.id group by 1)"


def _truth_found(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t, q = _table(_coded(spark, d)), _stated(spark, d)
    return search.search_batch(t, q, K), search.search_batch(t, q, K, algorithm="binary", rerank_factor=3)


@query(f"with {_TRUTH}, {_HITS} select {K} as k, round(avg(hits / total), {PLACES}) as recall from hits")
def recall_macro(spark, d):
    return evaluate.recall_macro(*_truth_found(spark, d), K).withColumn("recall", F.round("recall", PLACES))


@query(f"with {_TRUTH}, {_HITS} select {K} as k, round(sum(hits) / sum(total), {PLACES}) as recall from hits")
def recall_micro(spark, d):
    return evaluate.recall_micro(*_truth_found(spark, d), K).withColumn("recall", F.round("recall", PLACES))


def _reached(spark: SparkSession, d: str, t: VectorTable, *probes: float) -> DataFrame:
    """The first probe, and the least factor with it, whose recall over the stated queries is 0.9; the last probe reads all clusters."""
    q = _stated(spark, d).persist()
    truth = search.search_batch(t, q, K).persist()
    for probe in probes:
        factor, recall = evaluate.factor_for(t, q, truth, K, probe=probe, by_cluster=bool(t.meta.clusters))
        if recall >= 0.9:
            break
    return spark.createDataFrame([(K, q.count(), t.meta.clusters, probe, factor, recall)], "k int, queries bigint, clusters int, probe double, rerank_factor int, recall double")


@query()
def recall_rerank(spark, d):
    return _reached(spark, d, _table(_coded(spark, d)), 1.0)


@query()
def recall_clustered(spark, d):
    return _reached(spark, d, _clustered(spark, d), 0.875, 1.0)


@query(
    f"with r as ({_BATCH_RANKED.format(_BATCH + ' and e.vec_id <> q.vec_id', K)}), t as (select q.vec_id::varchar as query_id, min(e.vec_id)::varchar as target_id from embeddings q join embeddings e on e.label = q.label and e.vec_id <> q.vec_id where q.vec_id % {STATED} = 0 group by 1), "
    f"j as (select t.query_id, r.rank from t left join r on r.query_id = t.query_id and r.id = t.target_id) select round(avg((coalesce(rank, 0) = 1)::int::double), {PLACES}) as hits1, round(avg((rank is not null)::int::double), {PLACES}) as hits10, round(avg(coalesce(1.0 / rank, 0)), {PLACES}) as mrr10 from j"
)
def hits_mrr(spark, d):
    rows = _rows(spark, d)
    q = rows.where(F.col("row_index") % STATED == 0).select(F.col("row_index").alias("q"), "label")
    # The two least rows of each label: the target of a query is the first that it is not itself.
    least = rows.groupBy("label").agg(F.min("row_index").alias("first"))
    second = rows.join(least, "label").where("row_index > first").groupBy("label").agg(F.min("row_index").alias("second"))
    least = least.join(second, "label", "left")
    target = F.when(F.col("first") != F.col("q"), F.col("first")).otherwise(F.col("second"))
    targets = q.join(least, "label").select(F.col("q").cast("string").alias("query_id"), target.cast("string").alias("target_id")).where("target_id is not null")
    found = evaluate.hits_and_mrr(search.search_batch(_table(rows), _stated(spark, d), K, exclude_self=True), targets)
    return found.select(*[F.round(c, PLACES).alias(c) for c in found.columns])


def _round_trip(df: DataFrame) -> DataFrame:
    t = table.write_stream(df, scratch(df.sparkSession, "round-trip"), DIM, normalize=False, binary=True, keep=("label", "part"))
    return t.rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_index").alias("numbers"), F.min("row_index").alias("low"), F.max("row_index").alias("high"), F.count_distinct("id").alias("ids"), F.sum("part").alias("parts"), F.sum("label").alias("labels"))


@query(
    "select shape, count(*) as n, count(*) as numbers, 0::bigint as low, (count(*) - 1)::bigint as high, count(distinct vec_id) as ids, sum(100 + vec_id % 20)::bigint as parts, sum(label)::bigint as labels "
    "from embeddings, (values ('aggregate'), ('join'), ('repartition')) as s(shape) group by shape"
)
def write_stream_round_trip(spark, d):
    """Written whole, and numbered 0..N-1, from inputs that end in a shuffle; a kept column may have any name but those of a table."""
    rows = _rows(spark, d).withColumn("part", 100 + F.col("row_index") % 20)
    made = {
        "aggregate": rows.groupBy("id").agg(*[F.first(c).alias(c) for c in ("vector", "label", "part")]),
        "join": rows.drop("part").join(rows.select("id", "part").hint("merge"), "id"),
        "repartition": rows.repartition("label"),
    }
    return reduce(DataFrame.unionByName, [_round_trip(df.select("id", "vector", "label", "part")).select(F.lit(k).alias("shape"), "*") for k, df in made.items()])


@query("select conv_id, turn, conv_id::varchar || ':' || turn::varchar as id, role, text from conversations where role <> 'system' and length(text) > 0")
def conversation_messages(spark, d):
    return evaluate.conversation_messages(spark.read.parquet(f"{d}/conversations.parquet"))


@query(
    "with m as (select * from conversations where role in ('user', 'assistant') and length(text) > 0), w as (select *, max(case when role = 'user' then turn end) over b as u, max(case when role = 'assistant' then turn end) over b as a from m "
    "window b as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)) select conv_id, u as user_turn, turn as answer_turn from w where role = 'assistant' and u is not null and (a is null or a < u)"
)
def conversation_pairs(spark, d):
    return evaluate.conversation_pairs(spark.read.parquet(f"{d}/conversations.parquet"))


@query("select vec_id as row_index from embeddings, (select greatest(1, count(*) // 6) as step from embeddings) where vec_id % step = 0 and vec_id between step and 5 * step")
def query_sampling(spark, d):
    return evaluate.sample_queries(_rows(spark, d), 5).select("row_index")


@query("select l[(least(n - 1, floor(0.5 * n)) + 1)::int] as p50, l[(least(n - 1, floor(0.9 * n)) + 1)::int] as p90, l[(least(n - 1, floor(0.99 * n)) + 1)::int] as p99 from (select list(value order by value) as l, count(value) as n from events where value is not null)")
def latency_percentiles(spark, d):
    return evaluate.nearest_rank_percentiles(spark.read.parquet(f"{d}/events.parquet"), "value")


@query(
    f"with {_BATCH_RANKED.format(_BATCH, 50 * K).join(('w as (', ')'))}, l as (select w.*, e.label, q.label as own from w join embeddings e on e.vec_id = w.row_index join embeddings q on q.vec_id = w.query_id::bigint), "
    f"t as ({_BATCH_RANKED.format(_BATCH + ' and e.label = q.label', K)}), "
    f"f as (select f, query_id, id from l, (values (1), (10)) as o(f) where rank <= {K} * f and label = own qualify row_number() over (partition by f, query_id order by rank) <= {K}), "
    f"r as (select o.f, t.query_id, count(f.id) / count(*) as recall from t cross join (values (1), (10)) as o(f) left join f on f.f = o.f and f.query_id = t.query_id and f.id = t.id group by 1, 2) "
    f"select f as overfetch, round(avg(recall), {PLACES}) as recall from r group by f"
)
def filtered_recall(spark, d):
    rows = _rows(spark, d)
    q = rows.where(F.col("row_index") % STATED == 0).select(F.col("id").alias("query_id"), F.col("vector").alias("query"), F.col("label").alias("value"))
    return evaluate.filtered_recall(_table(rows), q, K, "label", (1, 10)).withColumn("recall", F.round("recall", PLACES))


# Every stated query with every row: distance of codes and score. Clusters are numbered and ranked per query as in _WALK.
_PAIRS = (
    f"pairs as materialized (select q.vec_id as qid, e.vec_id, {_BIT.format(a=_CODE.format(v='e.embedding'), b=_CODE.format(v='q.embedding'))} as far, {_COS.format(a='e.embedding::double[]', b='q.embedding::double[]')} as score "
    f"from embeddings e, embeddings q where q.vec_id % {STATED} = 0)"
)
_PAIRS_CLUSTERED = (
    f"{_PAIRS}, qcodes as (select vec_id as qid, {_CODE.format(v='embedding')}::bit as code from embeddings where vec_id % {STATED} = 0), "
    "order_of as (select qid, w.place as cluster_id, row_number() over (partition by qid order by bit_count(xor(c.code, q.code)), w.place) as nr from walk w join cent c using (cl), qcodes q), "
    "plain as materialized (select qid, vec_id, far, score, vec_id as row_index, 0 as nr from pairs), "
    "clustered_pairs as materialized (select p.qid, p.vec_id, far, score, n.row_index, o.nr from pairs p join numbered n using (vec_id) join order_of o on o.qid = p.qid and o.cluster_id = n.cluster_id)"
)


def _recall_sql(source: str, k: int, pool: int | None, probed: int = CLUSTERS) -> str:
    """The micro recall of the first k of a pool of the nearest codes in the probed clusters; no pool: of all rows."""
    chosen = f"select * from {source} where nr <= {probed}" + ("" if pool is None else f" qualify row_number() over (partition by qid order by far, row_index) <= {pool}")
    found = f"select qid, vec_id from ({chosen}) qualify row_number() over (partition by qid order by score desc, row_index) <= {k}"
    truth = f"select qid, vec_id from plain qualify row_number() over (partition by qid order by score desc, vec_id) <= {k}"
    return f"(select round(count(f.vec_id) / count(*), {PLACES}) from ({truth}) t left join ({found}) f using (qid, vec_id))"


_POOLS = "pools as (select qid, row_index, row_index - lag(row_index) over (partition by qid order by row_index) - 1 as gap from (select * from plain qualify row_number() over (partition by qid order by far, row_index) <= 100))"
_COVERED = "(select count(*) + coalesce(sum(case when gap <= 64 then gap end), 0) from pools)::bigint"


@query(
    f"with {_PAIRS}, plain as materialized (select qid, vec_id, far, score, vec_id as row_index, 0 as nr from pairs), {_POOLS} select 'exact' as step, 1.0::double as recall, (select count(*) from plain)::bigint as vector_rows, (select count(*) from plain)::bigint as id_rows "
    f"union all select 'codes', {_recall_sql('plain', K, 100)}, (select count(*) from pools)::bigint, (select count(*) from pools)::bigint "
    f"union all select 'coalesced', {_recall_sql('plain', K, 100)}, {_COVERED}, {_COVERED} "
    f"union all select 'late_ids', {_recall_sql('plain', K, 100)}, {_COVERED}, (select {K} * count(distinct qid) from plain)::bigint"
)
def search_ablation(spark, d):
    out = evaluate.search_ablation(_table(_coded(spark, d)), _stated(spark, d), K)
    return out.withColumn("recall", F.round("recall", PLACES))


#: (rerank factor, probe) with and without clusters, for the first 10 and the first 100.
SWEEP_K, SWEEP_FACTORS, SWEEP_PROBES = (10, 100), (1, 3, 10), (0.25, 0.5, 1.0)


def _parameter_sweep_sql() -> str:
    rows = []
    for k in SWEEP_K:
        rows.append(f"select 'exact' as algorithm, {10.0}::double as rerank_factor, {0.25}::double as probe, 0 as clusters, {k} as k, {_recall_sql('plain', k, None)} as recall")
        for f in SWEEP_FACTORS:
            rows.append(f"select 'auto', {f}::double, 0.25::double, 0, {k}, {_recall_sql('plain', k, k * f)}")
            rows += [f"select 'auto', {f}::double, {p}::double, {CLUSTERS}, {k}, {_recall_sql('clustered_pairs', k, k * f, round(CLUSTERS * p))}" for p in SWEEP_PROBES]
    return f"{_FULL}, {_WALK}, {_PAIRS_CLUSTERED} " + " union all ".join(rows)


@query(_parameter_sweep_sql())
def parameter_sweep(spark, d):
    """Clusters x rerank factor x probe, recall at 10 and 100, from the places of the true neighbours; evaluate.sweep searches and gives milliseconds."""
    plain, clustered, q = _table(_coded(spark, d)), _clustered(spark, d), _stated(spark, d)
    truth = search.search_batch(plain, q, max(SWEEP_K)).persist()
    settings = [(k, f) for k in SWEEP_K for f in SWEEP_FACTORS]
    probed = [(k, f, p) for k, f in settings for p in SWEEP_PROBES]
    out = [("exact", 10.0, 0.25, 0, k, evaluate.recall_micro(truth, truth, k).first()["recall"]) for k in SWEEP_K]  # the search that truth is
    out += [("auto", float(f), 0.25, 0, k, r) for (k, f), r in zip(settings, evaluate.pool_recalls(plain, q, truth, [(k, f, None) for k, f in settings]), strict=True)]
    out += [("auto", float(f), p, CLUSTERS, k, r) for (k, f, p), r in zip(probed, evaluate.sweep_recalls(clustered, q, truth, probed), strict=True)]
    clustered.release()
    found = spark.createDataFrame(out, "algorithm string, rerank_factor double, probe double, clusters int, k int, recall double")
    return found.withColumn("recall", F.round("recall", PLACES))


@query(f"{_FULL}, {_WALK}, {_PAIRS_CLUSTERED} select 'base' as \"table\", {_recall_sql('plain', K, None)} as recall union all select 'codes', {_recall_sql('plain', K, 10 * K)} union all select 'clusters', {_recall_sql('clustered_pairs', K, 10 * K, 2)}")
def write_ablation(spark, d):
    found = evaluate.build_ablation(_rows(spark, d).withColumn("n", F.col("row_index")), DIM, scratch(spark, "ablation"), _stated(spark, d), K, CLUSTERS, order_by=("n",), normalize=False)
    return found.select("table", F.round("recall", PLACES).alias("recall"))


STORAGE = {"uncompressed": {}, "snappy": {"codec": "snappy"}, "zstd": {"codec": "zstd"}, "dictionary": {"encodings": {"vector": True, "vector_bin": True}}, "plain ids": {"encodings": {"id": False}}, "small pages": {"page_size": 4096}, "large pages": {"page_size": 1 << 20}}


@query(" union all ".join(f"select '{name}' as setting, count(*) as vectors, round(sum(list_sum(embedding::double[])), 2) as total, true as smaller_than_text from embeddings" for name in STORAGE))
def storage_codecs(spark, d):
    """Codecs, encodings per column and page sizes: what comes back, and if the files are smaller than the numbers as text."""
    text = _rows(spark, d).agg(F.sum(F.length(F.to_json(F.struct("vector"))))).first()[0]
    out = []
    for name, how in STORAGE.items():
        path = scratch(spark, "storage")
        rows = table.write_vectors(_rows(spark, d), path, DIM, binary=True, normalize=False, **how).rows
        size = int(inspect(spark, path).where("property = 'bytes'").first()["value"])
        total = rows.select(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("v"))
        out.append(total.agg(F.lit(name).alias("setting"), F.count(F.lit(1)).alias("vectors"), F.round(F.sum("v"), 2).alias("total"), F.lit(size < text).alias("smaller_than_text")))
    return reduce(DataFrame.unionByName, out)


@query(
    "with recursive g(i, st) as (select 1::bigint, (5 * 1664525 + 1013904223) % 4294967296 union all select i + 1, (st * 1664525 + 1013904223) % 4294967296 from g where i < 480), "
    "v as (select (i - 1) // 24 as row_index, list((st / 4294967296.0 * 2 - 1)::float order by i) as v from g group by 1) "
    "select row_index, 'vec-' || row_index as id, round(list_sum(list_transform(v, lambda x: (x::double / sqrt(list_dot_product(v::double[], v::double[])))::float::double)), 5) as total from v"
)
def random_unit_vectors(spark, d):
    made = random_vectors(spark, 20, 24, 5, unit=True)
    return made.select("row_index", "id", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), PLACES - 1).alias("total"))


def _model_sql(name: str, dim: int) -> str:
    batch = _BATCH.replace("e.embedding", f"e.embedding[:{dim}]").replace("q.embedding", f"q.embedding[:{dim}]") + " and e.vec_id <> q.vec_id"
    return (
        f"select '{name}' as model, {dim} as dimension, round(avg((coalesce(rank, 0) = 1)::int::double), {PLACES}) as hits1, round(avg((rank is not null)::int::double), {PLACES}) as hits10, round(avg(coalesce(1.0 / rank, 0)), {PLACES}) as mrr10 "
        f"from (select p.vec_id::varchar as query_id, ((p.vec_id + 1) % n)::varchar as target_id from embeddings p, (select count(*) as n from embeddings) where p.vec_id % {STATED} = 0) t left join ({_BATCH_RANKED.format(batch, K)}) r on r.query_id = t.query_id and r.id = t.target_id"
    )


@query(" union all ".join((_model_sql("whole", DIM), _model_sql("half", DIM // 2))))
def model_comparison(spark, d):
    rows = _rows(spark, d)
    n = rows.count()
    pairs = rows.where(F.col("row_index") % STATED == 0).select(F.col("id").alias("query_id"), ((F.col("row_index") + 1) % n).cast("string").alias("target_id"))
    half = table.from_rows(rows.withColumn("vector", F.slice("vector", 1, DIM // 2)), DIM // 2)
    found = evaluate.compare_models({"whole": _table(rows), "half": half}, pairs)
    return found.select("model", "dimension", *[F.round(c, PLACES).alias(c) for c in ("hits1", "hits10", "mrr10")])


def _scale_sql() -> str:
    parts = []
    for share in (4, 2, 1):
        near = f"select * from plain where vec_id < n // {share} and qid < n // {share}"
        truth = f"select qid, vec_id from ({near}) qualify row_number() over (partition by qid order by score desc, vec_id) <= {K}"
        pool = f"select * from ({near}) qualify row_number() over (partition by qid order by far, vec_id) <= {10 * K}"
        found = f"select qid, vec_id from ({pool}) qualify row_number() over (partition by qid order by score desc, vec_id) <= {K}"
        parts.append(f"select (select max(n) // {share} from plain) as rows, round(count(f.vec_id) / count(*), {PLACES}) as recall from ({truth}) t left join ({found}) f using (qid, vec_id)")
    return f"with {_PAIRS}, plain as (select *, (select count(*) from embeddings) as n from pairs) " + " union all ".join(parts)


@query(_scale_sql())
def scale_sweep(spark, d):
    """A quarter, half and all of the rows; evaluate.scale_sweep also gives bytes and milliseconds."""
    rows = _rows(spark, d).drop("label")
    n = rows.count()
    asked = rows.where(F.col("row_index") % STATED == 0).select(F.col("id").alias("query_id"), F.col("vector").alias("query"), "row_index")
    found = evaluate.scale_sweep(rows, DIM, scratch(spark, "scale"), [n // 4, n // 2, n], asked, normalize=False)
    return found.select("rows", F.round("recall", PLACES).alias("recall"))


@query(f"select unnest(['cold', 'warm']) as codes, count(*) as queries, count(*) * {K} as results from embeddings where vec_id % {STATED} = 0")
def cold_and_warm(spark, d):
    """How many results came back; evaluate.cold_and_warm also gives percentiles of milliseconds."""
    path = scratch(spark, "cold")
    t = table.write_vectors(_rows(spark, d), path, DIM, binary=True)
    return evaluate.cold_and_warm(t, _stated(spark, d)).select("codes", "queries", "results")


@query(f"{_FULL}, {_WALK}, {_PAIRS_CLUSTERED} " + " union all ".join(f"select {n} as probed, {_recall_sql('clustered_pairs', K, 10 * K, n)} as recall" for n in (1, 2, 4, 8)))
def probe_sweep(spark, d):
    """Recall by the number of clusters that a search reads."""
    clustered, q = _clustered(spark, d), _stated(spark, d)
    truth = search.search_batch(_table(_rows(spark, d)), q, K).persist()
    found = evaluate.sweep(clustered, q, truth, K, [{"probe": n / CLUSTERS} for n in (1, 2, 4, 8)])
    return found.select((F.col("probe") * CLUSTERS).cast("int").alias("probed"), F.round("recall", PLACES).alias("recall"))


def _reached_sql(source: str, clusters: int, *probes: float) -> str:
    """The first probe and factor (10, doubled up to 10,240) that reach a recall of 0.9."""
    tried = [f"select {p}::double as probe, {10 << i}::int as rerank_factor, {_recall_sql(source, K, K * (10 << i), round(CLUSTERS * p))} as recall" for p in probes for i in range(11)]
    stated = "(select count(distinct qid) from plain)::bigint as queries"
    return f"{_FULL}, {_WALK}, {_PAIRS_CLUSTERED}, tried as ({' union all '.join(tried)}) select {K}::int as k, {stated}, {clusters}::int as clusters, probe, rerank_factor, recall from tried where recall >= 0.9 order by probe, rerank_factor limit 1"


ORACLES["recall_rerank"] = _reached_sql("plain", 0, 1.0)
ORACLES["recall_clustered"] = _reached_sql("clustered_pairs", CLUSTERS, 0.875, 1.0)


@query("select s_suppkey, count(*) as n, sum(label)::bigint as labels from supplier join embeddings on vec_id >= s_suppkey and vec_id < s_suppkey + 4 * s_nationkey group by s_suppkey")
def range_join(spark, d):
    """Rows of one row range for each supplier."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    given = s.select("s_suppkey", F.col("s_suppkey").cast("bigint").alias("row_start"), (F.col("s_suppkey") + 4 * F.col("s_nationkey")).cast("bigint").alias("row_end"))
    return ranges.range_join(_rows(spark, d).select("row_index", "label"), given, width=256).groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("labels"))


@query(f"with {_Q0} {_ranked(_scored('cosine'))}")
def knn_rerank_large_pool(spark, d):
    """A pool too large for the driver, on a table in files: here all rows, so the exact result."""
    path, q = scratch(spark, "large-pool"), _vector(spark, d, 0)
    n = _rows(spark, d).count()
    t = table.write_vectors(_rows(spark, d).withColumn("n", F.col("row_index")), path, DIM, order_by=("n",), normalize=False, binary=True)
    return _shown(search.search(t, q, K, rerank_factor=max(n, 10_001) / K))


#: Batches of compacted_search, and neighbours of a tier that become one table.
BATCHES, FAN_IN = 9, 3


@query(
    f"with {_Q0}, s as (select * exclude (row_index) from (select vec_id::varchar as id, {_SCORES['cosine']} as score, vec_id % {BATCHES} as batch, vec_id as row_index from embeddings, q)), "
    f"r as (select (row_number() over (order by score desc, batch, id::bigint))::int as rank, id, round(score, {PLACES}) as score from s qualify rank <= {K}) "
    f"select step, tables, rank, id, score from r, (values ('appended', {BATCHES}), ('compacted', 1), ('vacuumed', 1)) as v(step, tables)"
)
def compacted_search(spark, d):
    """The same search over all rows, appended in batches, then merged in tiers, then without the replaced files."""
    path, rows, q = scratch(spark, "batches"), _rows(spark, d), _vector(spark, d, 0)
    for b in range(BATCHES):
        append.append_batch(rows.where(F.col("row_index") % BATCHES == b).coalesce(1).sortWithinPartitions("row_index"), path, b, DIM, narrow=True, normalize=False)
    out = []
    for step, change in (("appended", lambda: None), ("compacted", lambda: append.compact(spark, path, fan_in=FAN_IN)), ("vacuumed", lambda: append.vacuum(spark, path))):
        change()
        tables = append.open_batches(spark, path)
        found = search.search(tables, q, K, algorithm="exact").select("rank", "id", F.round("score", PLACES).alias("score"))
        kept = scratch(spark, "found")
        found.select(F.lit(step).alias("step"), F.lit(len(tables)).alias("tables"), "*").write.parquet(kept)  # vacuum deletes what it reads
        out.append(spark.read.parquet(kept))
    return reduce(DataFrame.unionByName, out)


def _lateral(spark: SparkSession, d: str, t: VectorTable, call: str) -> DataFrame:
    """A table function for each stated query. The views have names of their own, so they outlive later calls."""
    names = [f"nearfield_{x}_{uuid.uuid4().hex}" for x in ("rows", "clusters", "asked")]
    for name, df in zip(names, (t.rows, table.clusters_frame(spark, t), _stated(spark, d)), strict=True):
        df.createOrReplaceTempView(name)
    V.register_sql(spark, *names[:2])
    return _shown(spark.sql(f"select a.query_id, r.* from {names[2]} a, lateral {call} r"))


@query(ORACLES["knn_batch_rerank"])
def fn_sql_lateral(spark, d):
    return _lateral(spark, d, _table(_coded(spark, d)), f"vector_search_rerank(a.query, {K}, 100)")


@query(
    f"{_FULL}, {_WALK}, {_PAIRS_CLUSTERED}, pool as (select * from clustered_pairs where nr <= 4 qualify row_number() over (partition by qid order by far, row_index) <= 100) "
    f"select qid::varchar as query_id, (row_number() over (partition by qid order by score desc, row_index))::int as rank, vec_id::varchar as id, round(score, {PLACES}) as score, row_index from pool qualify rank <= {K}"
)
def fn_sql_lateral_probe(spark, d):
    return _lateral(spark, d, _clustered(spark, d), f"vector_search_probe(a.query, {K}, 100, 4)")


@query()
def kmeans_two_level(spark, d):
    """Clusters of all rows by two levels of centroids; a test compares them with plain loops."""
    rows = _coded(spark, d).select(F.col("row_index").alias("ordinal"), F.col("vector_bin").alias("code"))
    return kmeans.two_level_kmeans(rows, DIM, 2 * CLUSTERS, seed=CLUSTER_SEED).assigned.select(F.col("ordinal").alias("vec_id"), "cluster")


@query()
def search_reads(spark, d):
    """Bytes and rows read by each way to search a table in files."""
    rows = _rows(spark, d).withColumn("n", F.col("row_index"))
    t = table.write_vectors(rows, scratch(spark, "reads"), DIM, order_by=("n",), normalize=False, clusters=CLUSTERS, cluster_seed=CLUSTER_SEED)
    return evaluate.search_reads(t, _vector(spark, d, 0), K).drop("ms")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return _shown(search.search(_table(_rows(spark, d)), _vector(spark, d, 0), K))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERY_MAP)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
