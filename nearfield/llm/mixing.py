"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame operations only.

Each source's documents are laid end to end in a shuffled order (MD5 of the id) on a line of words that
repeats; the part of the line that a source's target needs is cut into blocks of BLOCK words. The blocks of all sources
are shares of one circle: slot i of the schedule maps the base-2 van der Corput point of i through the cumulative
numbers of blocks to a source, the slots of a source are ranked, and slot rank r takes block r. A document's share is
the overlap of its intervals with the taken blocks.

Targets: total = SHARE x all words, shared by weight; a source's target stops at EPOCHS times its size and the
excess is shared again by weight until no target is above.

No source is lost: the schedule has 2**bits points, at least as many as there are blocks, so the share of a source
with n blocks holds n points or more; its first n slots are used, and a block without a slot is an error. The points
of a share are found from its bounds: the points are k / 2**bits, and k reversed bit by bit is the slot.

Scale: places on the line come from sums per (source, cell of the shuffled order), cells of cells where there are many,
so a source with a third of all rows is spread. The order of sources and the sums over them go by range partitions. The
table of sources is broadcast only up to BROADCAST_SOURCES rows; beyond, it is joined with SALTS copies of each row.

Edge cases: null text and empty text have size 0 and take 0; a null source is a source of its own and the last;
rows that repeat each have their own interval; a source without words has target 0; an empty table gives an empty
result; other columns are kept aside by name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import WORD, stored, text_of

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, EPOCHS = 1.5, 2.0
BLOCK = 4096
#: Mean rows of a cell of documents at most (a power of 16 of them), slots of a cell, and cells of a cell of cells.
CELL_ROWS, CELL_SLOTS, FAN = 256, 4096, 3
BROADCAST_SOURCES, SALTS = 20_000, 16
#: Points that one row of a share is expanded to.
CHUNK = 1 << 14


def words_of(text: Column) -> Column:
    """Number of words, without making an array of them: word starts are what remains of each word."""
    return F.length(F.regexp_replace(F.regexp_replace(text, WORD, "w"), "[^w]", "")).cast("long")


def _prefix(df: DataFrame, keys: list[str], cells: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """name: sum of value over the rows before, by keys, in the order (*cells, *order).

    cells: columns from coarse to fine, each constant within the next. Sums per finest cell come first, then their own
    prefix sums by the coarser cells, then those inside a cell: no window holds all rows of a key.
    """
    *coarse, _ = cells
    sums = df.groupBy(*keys, *cells).agg(F.sum(value).alias("cell_sum"))
    if coarse:
        sums = _prefix(sums, keys, coarse, cells[-1:], "cell_sum", "cell_start")
    else:
        before = Window.partitionBy(*keys).orderBy(*cells).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("cell_start", F.coalesce(F.sum("cell_sum").over(before), F.lit(0)))
    inside = Window.partitionBy(*keys, *cells).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("cell_place", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return out.join(sums.drop("cell_sum"), [*keys, *cells]).withColumn("prefix", F.col("cell_start") + F.col("cell_place")).drop("cell_start", "cell_place").withColumnRenamed("prefix", name)


def _in_order(df: DataFrame, *order: str) -> DataFrame:
    """df, a row per source, with `cell`: its range partitions in the given order, stored so that they stay."""
    return stored(df.repartitionByRange(*order).withColumn("cell", F.spark_partition_id()), "sources")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """source, source_size, rank, target. sources: a row per source with source_size.

    Water filling in one pass: a source stops at its cap when the words per weight reach cap / weight. With the
    sources in that order, the words left divided by the weight left rise, and the first source that does not
    reach its cap fixes the level for all after it.
    """
    named = sources.select("source", "source_size", F.col("source").isNull().alias("last"), F.encode("source", "utf-8").alias("name"), F.lit(1).alias("one"))
    ranked = _prefix(_in_order(named, "last", "name"), [], ["cell"], ["last", "name"], "one", "rank").drop("cell", "one", "last", "name")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(epochs))).withColumn("ratio", F.col("cap") / F.col("weight"))
    ranked = _in_order(ranked, "ratio", "rank")
    whole = ranked.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    capped = _prefix(_prefix(ranked, [], ["cell"], ["ratio", "rank"], "cap", "caps"), [], ["cell"], ["ratio", "rank"], "weight", "weights")
    level = (F.lit(float(whole["words"] or 0)) * F.lit(float(share)) - F.col("caps")) / (F.lit(float(whole["weight"] or 0)) - F.col("weights"))
    capped = stored(capped.withColumn("level", level), "levels")
    free = capped.where(F.col("ratio") > F.col("level")).agg(F.min(F.struct("ratio", "rank", "level")).alias("free")).first()["free"]
    target = F.col("cap")
    if free:
        above = (F.col("ratio") > F.lit(free["ratio"])) | ((F.col("ratio") == F.lit(free["ratio"])) & (F.col("rank") >= F.lit(free["rank"])))
        target = F.when(above, F.col("weight") * F.lit(free["level"])).otherwise(target)
    return capped.select("source", F.col("rank").cast("bigint").alias("rank"), "source_size", target.alias("target"))


def reversed_bits(k: Column, bits: int) -> Column:
    """The low bits of k in reverse: k / 2**bits is the van der Corput point of this slot, and the other way round."""
    return F.conv(F.reverse(F.lpad(F.bin(k), bits, "0")), 2, 10).cast("long")


def schedule(goal: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, rank (of the source), place: the first ceil(target / block) slots of each source of goal(rank, target)."""
    counted = goal.select("rank", F.ceil(F.col("target") / block).cast("long").alias("blocks")).where("blocks > 0")
    counted = _in_order(counted, "rank")
    total = counted.agg(F.sum("blocks")).first()[0] or 0
    bits = max(1, (total - 1).bit_length())
    bounds = _prefix(counted, [], ["cell"], ["rank"], "blocks", "low")
    at = lambda x: F.expr(f"({x} * cast({1 << bits} as decimal(19,0)) + {max(0, total - 1)}) div {max(1, total)}")
    shares = bounds.select("rank", "blocks", F.col("low").cast("decimal(19,0)").alias("low"), (F.col("low") + F.col("blocks")).cast("decimal(19,0)").alias("high"))
    shares = shares.select("rank", "blocks", at("low").alias("first"), (at("high") - 1).alias("last"))
    chunks = shares.withColumn("chunk", F.explode(F.sequence(F.expr(f"first div {CHUNK}"), F.expr(f"last div {CHUNK}")))).repartition("rank", "chunk")
    points = chunks.select("rank", "blocks", F.explode(F.sequence(F.greatest("first", F.col("chunk") * CHUNK), F.least("last", (F.col("chunk") + 1) * CHUNK - 1))).alias("k"))
    slots = points.select("rank", "blocks", reversed_bits(F.col("k"), bits).alias("slot"), F.lit(1).alias("one"))
    slots = slots.withColumn("cell", F.expr(f"slot div {CELL_SLOTS}")).withColumn("cells", F.expr(f"slot div {CELL_SLOTS**2}"))
    return _prefix(slots, ["rank"], ["cells", "cell"], ["slot"], "one", "place").where("place < blocks").select("slot", "rank", "place")


def _named(rows: DataFrame, goal: DataFrame, sources: int) -> DataFrame:
    """rows with the columns of their source's goal."""
    goal = goal.withColumnRenamed("source", "goal_source")
    same = rows["source"].eqNullSafe(goal["goal_source"])
    if sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(goal), same).drop("goal_source")
    salted = goal.withColumn("goal_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("order"), F.lit(SALTS)).cast("int"))
    return rows.join(salted.hint("merge"), rows["source"].eqNullSafe(salted["goal_source"]) & (rows["salt"] == salted["goal_salt"])).drop("goal_source", "goal_salt", "salt")


def mix(docs: DataFrame, text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, and first_slot (of the first block that takes words of it, or -1)."""
    # The shuffled order: MD5 of the id. Rows with the same id follow by size; those of equal size are alike.
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = stored(docs.select("doc_id", F.col("source"), words_of(text_of(text_col)).alias("size"), order.alias("order")), "sizes")
    sizes = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")), "source-sizes")
    known = sizes.agg(F.max("source_rows").alias("r"), F.count(F.lit(1)).alias("n")).first()
    goal = stored(targets(sizes.drop("source_rows")), "targets")
    digits = 1
    while (known["r"] or 0) / 16**digits > CELL_ROWS:
        digits += 1
    cells = {f"hash_{n}": F.substring("order", 1, n) for n in range(digits, 0, -FAN)}
    named = _named(rows, goal, known["n"]).withColumns(cells)
    placed = stored(_prefix(named, ["rank"], list(cells)[::-1], ["order", "doc_id", "size"], "size", "start").drop("order", *cells), "placed")
    passes = F.array(*[F.col("start") + F.col("source_size") * k for k in range(int(EPOCHS))])
    cut = placed.where("size > 0").select("rank", "start", "size", "target", F.explode(passes).alias("low"))
    cut = cut.where(F.col("low") < F.col("target")).withColumn("high", F.least(F.col("low") + F.col("size"), F.col("target").cast("long")))
    cut = cut.withColumn("place", F.explode(F.sequence((F.col("low") / block).cast("long"), F.greatest((F.col("low") / block).cast("long"), ((F.col("high") - 1) / block).cast("long")))))
    share = F.greatest(F.lit(0), F.least("high", (F.col("place") + 1) * block) - F.greatest("low", F.col("place") * block))
    slot = F.coalesce("slot", F.raise_error(F.concat(F.lit("no slot for block "), F.col("place").cast("string"))).cast("long"))
    taken = cut.withColumn("share", share).join(schedule(goal, block), ["rank", "place"], "left").withColumn("slot", slot)
    taken = taken.groupBy("rank", "start").agg(F.sum("share").alias("taken"), F.min("slot").alias("first_slot"))
    return (
        placed.withColumn("start_key", F.when(F.col("size") > 0, F.col("start")))
        .join(taken.select(F.col("rank").alias("r"), F.col("start").alias("start_key2"), "taken", "first_slot"), (F.col("rank") == F.col("r")) & (F.col("start_key") == F.col("start_key2")), "left")
        .select("doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("first_slot", F.lit(-1)).cast("long").alias("first_slot"))
    )


def repeat_by_share(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, as often as the schedule begins to take them; those it does not take go.

    At most one document of a source is taken in part, at the end of its target. Rows that share an id, a null id
    too, are taken equally often.
    """
    own, passes, one = (f"{x}_{uuid.uuid4().hex}" for x in ("id", "passes", "pass"))
    share = F.ceil(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).cast("int")
    shares = stored(mix(docs, text_col).groupBy(F.col("doc_id").alias(own)).agg(share.alias(passes)).where(F.col(passes) > 0), "shares")
    # A merge join at any size: the shares grow with the documents.
    out = docs.join(shares.hint("merge"), docs["doc_id"].eqNullSafe(shares[own]))
    return out.withColumn(one, F.explode(F.sequence(F.lit(1), F.col(passes)))).select(*docs.columns)
