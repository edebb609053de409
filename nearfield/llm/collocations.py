"""Phrase collocations: exact counts of frequent phrases by a minimal perfect hash, and their weakest cuts.

Texts (A-Z in lower case) are cut into pieces at PIECE and into words at spaces and tabs; everything is per language. Numpy cuts and hashes
many texts at once; a phrase's key is a 64-bit hash of its language and words.

1. Candidates, level by level (1 to WIDTH words): tasks count keys in blocks of texts, Spark sums them by key, keys with LEAST or more stay. A
   phrase is only counted if its two parts one word shorter passed the level before, as far as a bitmap of fixed size (FILTER_BITS) tells: Apriori.
   A false positive or two phrases of one key only make a sum larger, so no frequent phrase is lost.
2. The keys are dealt to shards of about SHARD by their hash; a task per shard builds its minimal perfect hash by displacement.
   Each slot stores its key, by which foreign phrases are turned away.
3. Tasks look up all phrases of a block in the hash, at most ROUND keys of it at once (broadcast, some 40 MB), bincount the slots and pass on, for
   each shard, a bitmap of the slots that they have seen and their counts; these arrays are summed as a tree. More than ROUND candidates
   cost a further pass over the texts for each ROUND.
   One task in NAMERS, by the key, also names the phrase of a slot; one more pass over the texts names the slots that no such task has seen.
4. Cuts: the keys of a candidate's parts come from its words, their counts from the slots; scores are exact decimals.

Verification: a slot stores its 64-bit key. Occurrences also add a 16-bit check of their words, by another hash, to their slot. If two
phrases are named for a key, or a slot's sum is not its count times the check of its phrase, two phrases shared a key and all is done again with another seed.

Broadcasts: the bitmap (8 MB) and one round of the hash; neither grows with the data.

Edge cases: null text is empty, null language is `und`; phrases do not cross pieces or documents; equal rows count each; very long texts are
one block; a language without candidates has no rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import stored, text_of
from nearfield.llm.shingles import _BYTE, _powers, mix, stream

LEAST, WIDTH, TOP, SHARE = 10, 3, 2000, 50
#: Bytes that end a piece, and those between words.
PIECE, BLANK = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Bytes of text that a task takes at once, bits of the bitmap, keys of a shard and of a round.
BLOCK, FILTER_BITS, SHARD, ROUND = 4 << 20, 1 << 26, 1 << 16, 1 << 22
#: Branches of the tree of sums; of how many tasks one names a phrase.
BRANCHES, NAMERS = 16, 8
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(BLANK)], _CLASS[list(PIECE)] = 1, 2
_PLACE = stream(3, 16) | np.uint64(1)
_BUCKET_SEED = stream(4, 1)[0]


def language_key(lang: str, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{lang}".encode(), digest_size=8).digest(), "little")


class Block:
    """Words of many texts: where they are, the language of each, and the keys and checks of phrases."""

    def __init__(self, texts: list[bytes], langs: list[str], seed: int, checked: bool = False) -> None:
        self.buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        kind = _CLASS[self.buf]
        inside = kind == 0
        self.begins = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]])) if len(inside) else np.empty(0, np.int64)
        self.ends = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1 if len(inside) else np.empty(0, np.int64)
        sizes = self.ends - self.begins
        first = np.cumsum(sizes) - sizes
        self.langs = sorted(set(langs))
        at = {x: i for i, x in enumerate(self.langs)}
        borders = np.cumsum([0, *(len(t) + 1 for t in texts)])
        doc = np.searchsorted(borders, self.begins, side="right") - 1
        self.lang = np.array([at[x] for x in langs], np.int64)[doc] if len(langs) else np.empty(0, np.int64)
        self.piece = np.cumsum(kind == 2)[self.begins]
        if not len(sizes):
            self.words = self.signs = np.empty(0, np.uint64)
            return
        letters = self.buf[inside]
        offset = np.arange(len(letters)) - np.repeat(first, sizes)
        hashes = mix(np.add.reduceat(_BYTE[letters] * _powers(int(sizes.max()) + 1)[offset], first) + sizes.astype(np.uint64))
        spoken = np.array([language_key(x, seed) for x in self.langs], np.uint64)[self.lang]
        self.words = mix(hashes ^ spoken)
        self.signs = mix(np.add.reduceat(mix(_BYTE[letters] + offset.astype(np.uint64)), first) ^ spoken) if checked else None

    def keys(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the phrases that start at each word, and which of them lie inside one piece."""
        n = max(0, len(self.words) - width + 1)
        if width == 1:
            return self.words, np.ones(n, bool)
        total = np.full(n, width, np.uint64)
        for j in range(width):
            total += self.words[j : n + j] * _PLACE[j]
        return mix(total), self.piece[:n] == self.piece[width - 1 : n + width - 1]

    def checks(self, width: int) -> np.ndarray:
        """16 bits of each phrase that starts at a word, by another hash than the keys."""
        n = max(0, len(self.signs) - width + 1)
        total = np.full(n, width, np.uint64)
        for j in range(width):
            total += self.signs[j : n + j] * _PLACE[4 + j]
        return (mix(total) & np.uint64(0xFFFF)).astype(np.int64)

    def phrases(self, at: np.ndarray, width: int) -> pa.Array:
        """The phrases that start at the given words, joined by a space, in lower case."""
        words = (at[:, None] + np.arange(width)).ravel()
        sizes = self.ends[words] - self.begins[words]
        letters = np.append(self.buf, np.uint8(32))
        starts, counts = np.stack([self.begins[words], np.full(len(words), len(self.buf))], 1).ravel(), np.stack([sizes, np.ones_like(sizes)], 1).ravel()
        counts[2 * width - 1 :: 2 * width] = 0  # no space behind the last word
        before = np.cumsum(counts) - counts
        out = letters[np.repeat(starts - before, counts) + np.arange(int(counts.sum()))]
        out = np.where((out >= 65) & (out <= 90), out + 32, out).astype(np.uint8)
        ends = np.concatenate([[0], np.cumsum(counts.reshape(len(at), -1).sum(1))]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(out)).cast(pa.string())


def blocks(batches: Iterator[pa.RecordBatch], seed: int, most: int, checked: bool = False) -> Iterator[Block]:
    texts: list[bytes] = []
    langs: list[str] = []
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            value = text.as_py()
            if texts and size + len(value) > most:
                yield Block(texts, langs, seed, checked)
                texts, langs, size = [], [], 0
            texts.append(value)
            langs.append(lang)
            size += len(value)
    if texts:
        yield Block(texts, langs, seed, checked)


def _bits(keys: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    place = keys >> np.uint64(58 - words.bit_length() + 1)
    return (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63))


def _level(width: int, seed: int, passed, most: int):
    """Keys of phrases of `width` words with their counts in a block of `most` bytes; passed: bitmap of the keys one word shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, seed, most):
            keys, ok = block.keys(width)
            if passed is not None:
                shorter, _ = block.keys(width - 1)
                words, bits = _bits(shorter, len(passed.value))
                known = passed.value[words] & bits != 0
                ok = ok & known[: len(ok)] & known[1 : len(ok) + 1]
            found, n = np.unique(keys[ok], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["key", "n"])

    return run


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS with a bit for each key's high bits: FILTER_BITS / 64 words come to the driver at most."""
    place = keys.select(F.shiftrightunsigned("key", 64 - FILTER_BITS.bit_length() + 1).alias("p"))
    words = place.select(F.expr("cast(shiftright(p, 6) as int)").alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def displaced(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A minimal perfect hash of distinct keys: a displacement per bucket, and the keys in the order of their slots.

    Buckets hold four keys in the mean and are placed from the largest down, each with the first seed that sends its keys to free slots;
    the key of a bucket of one takes a free slot as such, stored as the slot's negative number.
    """
    m = len(keys)
    count = max(1, m // 4)
    bucket = _bucket(keys, count)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=count)
    first = np.cumsum(sizes) - sizes
    shift, table, free = np.zeros(count, np.int32), np.empty(m, np.uint64), np.ones(m, bool)
    ranked = np.argsort(-sizes, kind="stable")
    for b in ranked[: int((sizes > 1).sum())]:
        own = keys[order[first[b] : first[b] + sizes[b]]]
        step, low = 16, 0
        while True:
            slots = _slot(own[:, None], np.arange(low, low + step), m)
            good = free[slots].all(0)
            s = np.sort(slots, axis=0)
            good &= (s[1:] != s[:-1]).all(0)
            if good.any():
                at = int(np.argmax(good))
                break
            low, step = low + step, min(4 * step, 4096)
            if low > 1 << 24:
                raise ValueError("keys repeat")
        shift[b] = low + at
        free[slots[:, at]] = False
        table[slots[:, at]] = own
    alone = np.flatnonzero(sizes == 1)
    left = np.flatnonzero(free)
    shift[alone] = -1 - left
    table[left] = keys[order[first[alone]]]
    return shift, table


def _bucket(keys: np.ndarray, count: np.ndarray | int) -> np.ndarray:
    return (mix(keys ^ _BUCKET_SEED) % np.asarray(count, np.uint64)).astype(np.int64)


def _slot(keys: np.ndarray, shift: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    return (mix(keys + (np.asarray(shift).astype(np.uint64) + np.uint64(1)) * _PLACE[8]) % np.asarray(m, np.uint64)).astype(np.int64)


class PerfectHash:
    """Shards of a minimal perfect hash. shift and table of all shards lie one after the other; an absent shard has no slots."""

    def __init__(self, shards: int, rows: list) -> None:
        self.shards = shards
        size, count = np.zeros(shards, np.int64), np.zeros(shards, np.int64)
        parts = {r["shard"]: (np.frombuffer(r["shift"], np.int32), np.frombuffer(r["keys"], np.uint64)) for r in rows}
        for s, (shift, table) in parts.items():
            size[s], count[s] = len(table), len(shift)
        self.size, self.count = size, count
        self.first, self.bucket_first = np.cumsum(size) - size, np.cumsum(count) - count
        order = sorted(parts)
        self.shift = np.concatenate([parts[s][0] for s in order] or [np.empty(0, np.int32)])
        self.table = np.concatenate([parts[s][1] for s in order] or [np.empty(0, np.uint64)])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key among all slots, -1 for a key that no slot stores."""
        out = np.full(len(keys), -1, np.int64)
        shard = shard_of(keys, self.shards)
        at = np.flatnonzero(self.size[shard])
        k, s = keys[at], shard[at]
        shift = self.shift[self.bucket_first[s] + _bucket(k, self.count[s])]
        slot = self.first[s] + np.where(shift < 0, -1 - shift, _slot(k, np.maximum(shift, 0), self.size[s]))
        same = self.table[slot] == k
        out[at[same]] = slot[same]
        return out


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix(keys) % np.uint64(shards)).astype(np.int64)


def _sharded(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key")
            shard = shard_of(keys.to_numpy().view(np.uint64), shards)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), keys], names=["shard", "key"])

    return run


def _built(group: pa.Table) -> pa.Table:
    keys = group.column("key").to_numpy().view(np.uint64)
    shift, table = displaced(keys)
    return pa.table({"shard": group.column("shard")[:1], "shift": pa.array([shift.tobytes()]), "keys": pa.array([table.tobytes()], pa.binary())})


def perfect_hash(candidates: DataFrame, shards: int) -> DataFrame:
    """shard, shift, keys of all candidate keys. A shard is a task's work of about SHARD keys."""
    sharded = candidates.select("key").mapInArrow(_sharded(shards), "shard int, key bigint")
    return stored(sharded.groupBy("shard").applyInArrow(_built, "shard int, shift binary, keys binary"), "perfect-hash")


COUNTS = "shard int, branch int, seen binary, counts binary, sums binary, key bigint, lang string, phrase string, width int, words bigint"


def _rows(n: int, **given) -> pa.RecordBatch:
    types = {"shard": pa.int32(), "branch": pa.int32(), "seen": pa.binary(), "counts": pa.binary(), "sums": pa.binary(), "key": pa.int64(), "lang": pa.string(), "phrase": pa.string(), "width": pa.int32(), "words": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in types.items()], names=list(types))


def _packed(counts: np.ndarray, sums: np.ndarray) -> dict[str, list[bytes]]:
    seen = counts > 0
    return {"seen": [np.packbits(seen).tobytes()], "counts": [counts[seen].astype("<i8").tobytes()], "sums": [(sums[seen] & 0xFFFF).astype("<u2").tobytes()]}


def _unpacked(seen: bytes) -> np.ndarray:
    """The slots of a bitmap."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(seen, np.uint8)))


def _counted(held, seed: int, widths: range, namers: int, most: int, branches: int, counting: bool, words: bool):
    """The names of slots, and if counting, their counts and sums of checks by shard; if asked for, also the words of each language.

    namers: of how many tasks one names a phrase.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, task = held.value, TaskContext.get().partitionId()
        total, sums = (np.zeros(len(table.table) if counting else 0, np.int64) for _ in range(2))
        to_name = (mix(table.table) + np.uint64(task)) % np.uint64(namers) == 0
        spoken: dict[str, int] = {}
        for block in blocks(batches, seed, most, counting):
            for lang, n in zip(block.langs, np.bincount(block.lang, minlength=len(block.langs)).tolist(), strict=True):
                spoken[lang] = spoken.get(lang, 0) + n
            for w in widths:
                keys, ok = block.keys(w)
                at = np.flatnonzero(ok)
                slots = table.find(keys[at])
                at, slots = at[slots >= 0], slots[slots >= 0]
                if counting:
                    total += np.bincount(slots, minlength=len(total))
                    sums += np.bincount(slots, block.checks(w)[at], len(total)).astype(np.int64)
                if w > 1:
                    new = np.flatnonzero(to_name[slots])
                    fresh, one = np.unique(slots[new], return_index=True)
                    if len(fresh):
                        to_name[fresh] = False
                        at = at[new[one]]
                        names = pa.array(block.langs, pa.string()).take(pa.array(block.lang[at]))
                        yield _rows(len(at), key=table.table[fresh].view(np.int64), lang=names, phrase=block.phrases(at, w), width=np.full(len(at), w))
        for s in np.flatnonzero(table.size) if counting else ():
            own = slice(table.first[s], table.first[s] + table.size[s])
            if total[own].any():
                yield _rows(1, shard=[s], branch=[task % branches], **_packed(total[own], sums[own]))
        if words and spoken:
            yield _rows(len(spoken), lang=list(spoken), words=list(spoken.values()))

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each (shard, branch) of the rows that a task reads, which come sorted by them."""
    key, total, sums = None, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), *(pa.array(x, pa.binary()) for x in _packed(total, sums).values())], names=["shard", "branch", "seen", "counts", "sums"])

    for batch in batches:
        for shard, branch, seen, counts, checks in zip(*(batch.column(c).to_pylist() for c in ("shard", "branch", "seen", "counts", "sums")), strict=True):
            if (shard, branch) != key:
                if key:
                    yield row()
                key, total, sums = (shard, branch), np.zeros(8 * len(seen), np.int64), np.zeros(8 * len(seen), np.int64)
            at = _unpacked(seen)
            total[at] += np.frombuffer(counts, "<i8")
            sums[at] += np.frombuffer(checks, "<u2")
    if key:
        yield row()


def tree_sum(arrays: DataFrame) -> DataFrame:
    """shard, seen, counts, sums: the arrays of each shard summed, first those of a branch, then the branches."""
    for branch in (F.col("branch"), F.lit(0)):
        dealt = arrays.select("shard", branch.alias("branch"), "seen", "counts", "sums").repartition("shard", "branch").sortWithinPartitions("shard", "branch")
        arrays = dealt.mapInArrow(_summed, "shard int, branch int, seen binary, counts binary, sums binary")
    return arrays.drop("branch")


def _read_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, a, sum of all slots."""
    for batch in batches:
        for keys, seen, counts, sums in zip(*(batch.column(c).to_pylist() for c in ("keys", "seen", "counts", "sums")), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, np.int64)[_unpacked(seen)]), pa.array(np.frombuffer(counts, "<i8")), pa.array(np.frombuffer(sums, "<u2").astype(np.int64))], names=["key", "a", "sum"])


PARTS = "key bigint, lang string, phrase string, width int, sign bigint, cuts array<struct<k:int,left:bigint,left_sign:bigint,right:bigint,right_sign:bigint>>"


def _parts(seed: int):
    """For each candidate its check, and the keys and checks of both parts of each cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("k", "left", "left_sign", "right", "right_sign")
        kind = pa.list_(pa.struct([(n, pa.int32() if n == "k" else pa.int64()) for n in names]))
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 16):
                part = batch.slice(at, 1 << 16)
                widths = part.column("width").to_numpy()
                block = Block([p.encode() for p in part.column("phrase").to_pylist()], part.column("lang").to_pylist(), seed, True)
                if len(block.words) != int(widths.sum()):
                    raise ValueError("a phrase does not split into its words")
                first = np.cumsum(widths) - widths
                made = {w: (block.keys(w)[0].view(np.int64), block.checks(w)) for w in range(1, int(widths.max()) + 1)}
                cuts = [[dict(zip(names, (k, made[k][0][f], made[k][1][f], made[w - k][0][f + k], made[w - k][1][f + k]), strict=True)) for k in range(1, w)] for f, w in zip(first.tolist(), widths.tolist(), strict=True)]
                sign = [int(made[w][1][f]) for f, w in zip(first.tolist(), widths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("key", "lang", "phrase", "width")), pa.array(sign, pa.int64()), pa.array(cuts, kind)], names=["key", "lang", "phrase", "width", "sign", "cuts"])

    return run


def _scanned(texts: DataFrame, keys: DataFrame, seed: int, widths: range, namers: int, counting: bool) -> tuple[DataFrame, DataFrame]:
    """The rows of _counted over all rounds of a perfect hash of keys, and the hash."""
    sc = texts.sparkSession.sparkContext
    shards = max(1, -(-keys.count() // SHARD))
    table = perfect_hash(keys, shards)
    step, found = max(1, ROUND // SHARD), None
    for low in range(0, shards, step):
        held = sc.broadcast(PerfectHash(shards, table.where(F.col("shard").between(low, low + step - 1)).collect()))  # ROUND keys at most
        rows = stored(texts.mapInArrow(_counted(held, seed, widths, namers, BLOCK, BRANCHES, counting, counting and low == 0), COUNTS), "counts")
        found = rows if found is None else found.unionByName(rows)
        held.unpersist()
    return found, table


def phrase_counts(docs: DataFrame, least: int = LEAST, width: int = WIDTH, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, a, sum) of all phrases of up to `width` words that can have a >= least; (key, lang, phrase, width, low, high) of those of two words
    or more, where low and high differ if a key has two phrases; and (lang, n)."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of("text").alias("text"))
    levels, passed = [], None
    for w in range(1, width + 1):
        keys = texts.mapInArrow(_level(w, seed, passed, BLOCK), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        levels.append(stored(keys.select("key"), f"level-{w}"))
        if w < width:
            passed = sc.broadcast(_bitmap(levels[-1]))
    longer = levels[1]
    for more in levels[2:]:
        longer = longer.unionByName(more)
    candidates = stored(longer.unionByName(levels[0]).distinct(), "candidates")  # phrases of different widths may share a key
    found, table = _scanned(texts, candidates, seed, range(1, width + 1), NAMERS, True)
    arrays = found.where("seen is not null").select("shard", "branch", "seen", "counts", "sums")
    counts = stored(tree_sum(arrays).join(table.select("shard", "keys").hint("merge"), "shard").mapInArrow(_read_slots, "key bigint, a bigint, sum bigint"), "slots")
    named = found.where("phrase is not null").select("key", "lang", "phrase", "width")
    unnamed = stored(longer.join(named.select("key").distinct().hint("merge"), "key", "left_anti").distinct(), "unnamed")
    rest, _ = _scanned(texts, unnamed, seed, range(2, width + 1), 1, False)
    named = named.unionByName(rest.where("phrase is not null").select("key", "lang", "phrase", "width")).withColumn("mark", F.xxhash64("lang", "phrase"))
    names = named.groupBy("key").agg(F.first(F.struct("lang", "phrase", "width")).alias("name"), F.min("mark").alias("low"), F.max("mark").alias("high"))
    return counts, stored(names.select("key", "name.*", "low", "high"), "names"), found.where("words is not null").groupBy("lang").agg(F.sum("words").alias("n"))


def collocations(docs: DataFrame, least: int = LEAST, width: int = WIDTH, top: int = TOP, share: int = SHARE, seed: int = 0) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` candidates of each language that no longer one holds share % of the time."""
    if width not in (2, 3):
        raise ValueError("phrases of 2 or 3 words")
    counts, names, words = phrase_counts(docs, least, width, seed)
    wide = names.mapInArrow(_parts(seed), PARTS).join(counts.hint("merge"), "key")
    wide = stored(wide.withColumn("wrong", (F.col("a") * F.col("sign")).bitwiseAND(F.lit(0xFFFF)) != F.col("sum")), "wide")
    sides = wide.where(F.col("a") >= least).select("key", "lang", "phrase", "width", "a", F.explode("cuts").alias("c"))
    end = lambda side: F.struct(F.lit(side == "left").alias("is_left"), F.col(f"c.{side}").alias("part"), F.col(f"c.{side}_sign").alias("part_sign"))
    ends = sides.select("key", "lang", "phrase", "width", "a", "c.k", F.explode(F.array(end("left"), end("right"))).alias("e")).select("*", "e.*").drop("e")
    known = counts.select(F.col("key").alias("part"), F.col("a").alias("f"), F.col("sum").alias("part_sum"))
    read = ends.join(known.hint("merge"), "part")
    read = stored(read.withColumn("wrong", (F.col("f") * F.col("part_sign")).bitwiseAND(F.lit(0xFFFF)) != F.col("part_sum")), "cut-counts")
    if not names.where("low <> high").isEmpty() or not wide.where("wrong").isEmpty() or not read.where("wrong").isEmpty():
        return collocations(docs, least, width, top, share, seed + 1)
    # A candidate that a longer one, its first or last word left out, holds often enough goes.
    inner = (F.col("width") > 2) & F.when(F.col("is_left"), F.col("k") == F.col("width") - 1).otherwise(F.col("k") == 1)
    longer = read.where(inner & (F.lit(100) * F.col("a") >= F.lit(share) * F.col("f"))).select(F.col("part").alias("key")).distinct()
    # The rows of a phrase hold both ends of its cuts.
    cut = read.groupBy("key", "k").agg(*[F.first(c).alias(c) for c in ("lang", "phrase", "a")], F.max(F.when(F.col("is_left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("is_left"), F.col("f"))).alias("r"))
    score = F.expr("(cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cut.join(longer.hint("merge"), "key", "left_anti").withColumn("score", score).groupBy("key", "lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    order = [F.col("best.score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salted = Window.partitionBy("lang", F.pmod(F.col("key"), F.lit(16))).orderBy(*order)
    best = best.withColumn("place", F.row_number().over(salted)).where(F.col("place") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "best.l", "best.r", "n", "best.score")
