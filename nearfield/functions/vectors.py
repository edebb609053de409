"""Vector functions as Column expressions. All of them stay in the JVM: higher-order functions, no Python workers.

Arithmetic is in double whatever the element type. Lengths that differ raise an error, as zip_with would pad with nulls.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

METRICS = ("cosine", "dot", "euclidean")
WORD_BITS = 64
#: Words of a code that are compared in one expression without a loop; longer codes take the loop.
UNROLLED = 64


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _paired(a: Column, b: Column, f: Callable[[Column, Column], Column], zero: Column) -> Column:
    """Sum of f over pairs of elements; an error if the lengths differ."""
    total = F.aggregate(F.zip_with(a, b, f), zero, lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.raise_error(F.concat(F.lit("vector lengths differ: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"))))


def dot(a: Column, b: Column) -> Column:
    return _paired(a, b, lambda x, y: x.cast("double") * y.cast("double"), F.lit(0.0))


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either norm is 0."""
    norms = l2_norm(a) * l2_norm(b)
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_paired(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")), F.lit(0.0)))


def l2_normalize(v: Column) -> Column:
    """v over its norm, elements rounded to float; the zero vector stays."""
    norm = l2_norm(v)
    return F.when(norm == 0, v.cast("array<float>")).otherwise(F.transform(v, lambda x: (x.cast("double") / norm).cast("float")))


def sign_code(v: Column, dimension: int) -> Column:
    """One bit for each element, 1 if it is 0 or above and no NaN: bit i % 64 of word i / 64."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def word(at: int) -> Column:
        bits = F.transform(F.slice(v, at + 1, WORD_BITS), lambda x, i: F.when((x >= 0) & ~F.isnan(x), F.call_function("shiftleft", one, i)).otherwise(zero))
        return F.aggregate(bits, zero, lambda acc, x: acc.bitwiseOR(x))

    return F.array(*[word(at) for at in range(0, dimension, WORD_BITS)])


def with_codes(df: DataFrame, dimension: int, vector: str = "vector", code: str = "vector_bin") -> DataFrame:
    """df with the sign codes of its vectors, which must have dimension elements each: whole batches of Arrow at once, the same bits as sign_code.

    Where a column has a type that Arrow does not carry, sign_code does it.
    """
    try:
        to_arrow_schema(df.schema)
    except (PySparkException, TypeError):
        return df.withColumn(code, sign_code(F.col(vector), dimension))
    words = -(-dimension // WORD_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(vector).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dimension)
            bits = np.zeros((batch.num_rows, words * WORD_BITS), bool)
            np.greater_equal(v, 0, out=bits[:, :dimension])  # false for NaN
            packed = np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()
            codes = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * words), pa.array(packed))
            yield pa.RecordBatch.from_arrays([*batch.columns, codes], names=[*batch.schema.names, code])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(code, ArrayType(LongType()))]))


def code_bits(code: Column, dimension: int) -> Column:
    """A code as a string of 0 and 1, element 0 first."""
    bit = lambda i: F.call_function("shiftright", F.get(code, (i / WORD_BITS).cast("int")), i % WORD_BITS).bitwiseAND(F.lit(1).cast("bigint"))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: bit(i).cast("string")), "")


def hamming(a: Column, b: Column, words: int | None = None) -> Column:
    """Bits in which two codes differ; all bits of all words count. words, if known: their number, which spares the loop over arrays."""
    if words and words <= UNROLLED:
        total = reduce(lambda x, y: x + y, [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))).cast("int") for i in range(words)])
        wrong = F.concat(F.lit(f"codes of {words} words are due, not of "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"))
        return F.when((F.size(a) == words) & (F.size(b) == words), total).otherwise(F.raise_error(wrong))
    return _paired(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int"), F.lit(0))


def score(a: Column, b: Column, metric: str) -> Column:
    check_metric(metric)
    return {"cosine": cosine, "dot": dot, "euclidean": euclidean}[metric](a, b)


def check_metric(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"unsupported metric {metric!r}: one of {', '.join(METRICS)}")


def best_first(column: str, metric: str) -> Column:
    """The sort order of scores: euclidean distances rise, similarities fall."""
    check_metric(metric)
    return F.col(column).asc() if metric == "euclidean" else F.col(column).desc()


def id_string(column: Column, data_type: str) -> Column:
    """An id as a string; whole numbers print without a fraction."""
    if data_type in ("double", "float"):
        return F.when(column == F.floor(column), column.cast("bigint").cast("string")).otherwise(column.cast("string"))
    return column.cast("string")


def unpack_floats(column: Column, dimension: int) -> Column:
    """Little-endian float32 bytes as an array, for tables of other writers. Built from hex digits, in the JVM."""
    def element(i: Column) -> Column:
        byte = lambda k: F.conv(F.hex(F.substring(column, i * 4 + k + 1, F.lit(1))), 16, 10).cast("bigint")
        raw = byte(0) + byte(1) * 256 + byte(2) * 65536 + byte(3) * 16777216
        exponent = (F.floor(raw / 8388608) % 256).cast("int")
        fraction = raw % 8388608
        size = F.when(exponent == 0, fraction * F.pow(F.lit(2.0), F.lit(-149))).otherwise((fraction + 8388608) * F.pow(F.lit(2.0), exponent - 150))
        return F.when(raw >= 2147483648, -size).otherwise(size).cast("float")

    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), element)


def pack_floats(v: Column) -> Column:
    """An array of floats as one little-endian float32 string of bytes (needs a Python worker; for export only)."""
    @F.pandas_udf("binary")
    def packed(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return packed(v)


_SAME = "if(size(a) = size(b), {}, raise_error(concat('vector lengths differ: ', size(a), ' and ', size(b))))"
_SUM = _SAME.format("aggregate(zip_with(a, b, (x, y) -> {}), 0D, (p, q) -> p + q)")
_SQL = {
    "vector_dot": ("a array<float>, b array<float>", "double", _SUM.format("cast(x as double) * cast(y as double)")),
    "vector_l2": ("a array<float>, b array<float>", "double", f"sqrt({_SUM.format('power(cast(x as double) - cast(y as double), 2)')})"),
    "vector_norm": ("a array<float>", "double", "sqrt(aggregate(a, 0D, (p, x) -> p + cast(x as double) * cast(x as double)))"),
    "vector_hamming": ("a array<bigint>, b array<bigint>", "int", _SAME.format("aggregate(zip_with(a, b, (x, y) -> cast(bit_count(x ^ y) as int)), 0, (p, q) -> p + q)")),
    "vector_code": ("a array<float>", "array<bigint>", "transform(sequence(0, (size(a) - 1) div 64), w -> aggregate(sequence(0, 63), 0L, (p, i) -> if(coalesce(get(a, int(w * 64 + i)) >= 0, false), p | shiftleft(1L, i), p)))"),
    "vector_cosine": ("a array<float>, b array<float>", "double", "if(vector_norm(a) * vector_norm(b) = 0, 0D, vector_dot(a, b) / (vector_norm(a) * vector_norm(b)))"),
    "vector_normalize": ("a array<float>", "array<float>", "if(vector_norm(a) = 0, a, transform(a, x -> cast(cast(x as double) / vector_norm(a) as float)))"),
}


#: Rows whose codes lie in one array, blocks whose pools are merged at once, and parts that the blocks of a cluster are dealt to.
SQL_ROWS, SQL_BLOCKS, SQL_PARTS = 4096, 64, 8
#: A distance and a row number in one number, and the distances of a block's codes to a code, as such numbers. One word is compared without a loop.
_KEYS = (
    "if(size(code) = 1, transform(codes, x -> shiftleft(bigint(bit_count({word} ^ code[0])), 44) | x.r), "
    "transform(codes, x -> shiftleft(bigint(if(size(x.c) = size(code), aggregate(zip_with(x.c, code, (a, b) -> int(bit_count(a ^ b))), 0, (p, y) -> p + y), "
    "raise_error(concat('vector lengths differ: ', size(x.c), ' and ', size(code))))), 44) | x.r))"
).format(word="if(size(x.c) = 1, x.c[0], raise_error(concat('vector lengths differ: ', size(x.c), ' and 1')))")


def _inlined(name: str, **names: str) -> str:
    """The body of a function of _SQL with the functions that it calls: Spark 4.1 does not resolve them all beside a generator."""
    body = re.sub(r"\b(\w+)\(([ab](?:, b)?)\)", lambda m: f"({_inlined(m[1], **dict(zip('ab', m[2].split(', '), strict=False)))})" if m[1] in _SQL else m[0], _SQL[name][2])
    return re.sub(r"\b[ab]\b", lambda m: names.get(m[0], m[0]), body)


_FIRST = "slice(sort_array({}), 1, pool)"
#: A pool of row numbers by the distance of codes, then the vectors of the pool alone by cosine; equal values go by row number. Queries meet blocks of codes,
#: not rows: each pair gives the pool of its block, the pools of SQL_BLOCKS blocks are merged, and only row numbers of these become rows again.
_RERANKED = (
    "select rn as rank, id, score, row_index from (select id, score, row_index, row_number() over (order by score desc, row_index) as rn from (select id, row_index, {{cosine}} as score from {view} join "
    f"(select key & 17592186044415 as row_index from (select key, row_number() over (order by key) as place from (select explode(near) as key from (select {_FIRST.format('near')} as near from ("
    f"select flatten(collect_list(near)) as near from (select block, {_FIRST.format(_KEYS)} as near from (select block, codes, {{code}} as code from {{source}})) group by block div {SQL_BLOCKS}"
    ")))) where place <= pool) using (row_index))) where rn <= k"
).replace("{{cosine}}", _inlined("vector_cosine", a="vector", b="q")).replace("{code}", _inlined("vector_code", a="q"))


def _blocks(view: str, parts: int, *keys: str) -> str:
    """The codes of a view by blocks of row numbers, one row each, in any case in so many partitions: there are few of them, and each is much work."""
    own = "".join(f"{c}, " for c in keys)
    number = f"if(row_index >= 0 and row_index < {1 << 44}, row_index, raise_error('row numbers must be below 2**44'))"
    return f"(select /*+ repartition({parts}) */ {own}row_index div {SQL_ROWS} as block, collect_list(struct({number} as r, vector_bin as c)) as codes from {view} group by {own}row_index div {SQL_ROWS})"


def register_sql(spark: SparkSession, view: str | None = None, clusters: str | None = None) -> list[str]:
    """Temporary SQL functions vector_*; with a view of (row_index, id, vector) also the table functions vector_search(query, k)
    by cosine, vector_search_dot and vector_search_l2. If the view has vector_bin, also vector_search_rerank(query, k, pool); if it has cluster_id
    and there is a view of clusters (cluster_id, centroid), also vector_search_probe(query, k, pool, n) over the n nearest clusters.

    For a table of queries: from queries, lateral vector_search_rerank(query, 10, 100). Spark joins each different query with blocks of codes: all
    for the rerank, those of the chosen clusters (an equality join) for the probe. Only the pools of blocks are shuffled; vectors are read for the
    pools of queries.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name, (args, kind, body) in _SQL.items():
        spark.sql(f"create or replace temporary function {name}({args}) returns {kind} return {body}")
    names = list(_SQL)
    for name, by, order in (("vector_search", "cosine", "desc"), ("vector_search_dot", "dot", "desc"), ("vector_search_l2", "l2", "asc")) if view else ():
        spark.sql(
            f"create or replace temporary function {name}(q array<float>, k int) returns table(rank int, id string, score double, row_index bigint) "
            f"return select rn as rank, id, score, row_index from (select *, row_number() over (order by score {order}, row_index) as rn from (select id, row_index, vector_{by}(vector, q) as score from {view})) where rn <= k"
        )
        names.append(name)
    columns = spark.table(view).columns if view else []
    out = "returns table(rank int, id string, score double, row_index bigint)"
    if "vector_bin" in columns:
        body = _RERANKED.format(view=view, source=_blocks(view, parts))
        spark.sql(f"create or replace temporary function vector_search_rerank(q array<float>, k int, pool int) {out} return {body}")
        names.append("vector_search_rerank")
    if "cluster_id" in columns and clusters:
        chosen = f"(select cluster_id from (select cluster_id, row_number() over (order by {_inlined('vector_hamming', a='centroid', b=_inlined('vector_code', a='q'))}, cluster_id) as nr from {clusters}) where nr <= n)"
        dealt = f"(select cluster_id, explode(sequence(0, {SQL_PARTS - 1})) as part from {chosen})"
        blocks = f"(select *, int(pmod(block, {SQL_PARTS})) as part from {_blocks(view, parts, 'cluster_id')})"
        body = _RERANKED.format(view=view, source=f"{blocks} join {dealt} using (cluster_id, part)")
        spark.sql(f"create or replace temporary function vector_search_probe(q array<float>, k int, pool int, n int) {out} return {body}")
        names.append("vector_search_probe")
    return names
