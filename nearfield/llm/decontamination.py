"""Benchmark decontamination by a BM25 inverted index of test items with block-max WAND.

The items are the indexed collection; each training passage is a query. An item's BM25 impacts are divided by the
score of its own text, so one threshold holds for all items: a passage retrieves every item of whose own score it
reaches MIN_SCORE. Retrieved pairs are verified: words of the question and of the answer that lie in a run of SHINGLE
words also found in the document must make up MIN_OVERLAP of each.

Passages are windows of words, twice the longest item wide (PASSAGE at least) with half of it as the stride, so
any item that a document holds lies whole in one passage.

Search goes by exact bounds, so nothing above the threshold is lost. As in MaxScore (Turtle and Flood, 1995) the words of an
item are split: its most frequent ones, up to REST of its own score, cannot reach the threshold alone and count as found; a
passage is searched only for the items that its other, essential words lift to MIN_SCORE. Frequent words thus have few
essential postings or none. This bound is summed by numpy for all passages of about CHUNK characters of text at once, with
words known by 64-bit hashes: two words of one hash can only raise it, and the search compares the words themselves.

What is left walks the postings by block-max WAND (Ding and Suel, 2011): a pivot by the largest impacts of whole lists, then
the bound by the maxima of the pivot's block alone, and if that is too low a skip to the next block, each time on to an item
that the first bound has left. The postings of a word lie in blocks of BLOCK neighbouring items, of which only those that hold
the word are kept, each with its largest impact; words that stand in no block whose sum reaches MIN_SCORE are left out.

No document is shuffled. Items are cut into words in tasks, and document frequencies and lengths are counted there too.
The items are dealt by hash into parts of about PART_BYTES of text. One part after the other goes to the tasks, which
build its index once for each worker; a benchmark of one part, as is usual, takes one pass over the documents. With
several parts each pass is stored before the next part is read, so no more than one part is held anywhere.

Edge cases: null or empty items are not indexed, and a null or empty text matches nothing; an item without a line
break or a sentence before its last has no answer of its own, which then counts as found; equal items match alike;
an empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import fsum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import stored, text_of
from nearfield.llm.shingles import mix

K1, B = 1.2, 0.75
MIN_SCORE, MIN_OVERLAP, SHINGLE = 0.5, 0.8, 5
PASSAGE = 128
PART_BYTES = 4 << 20
BLOCK = 4
REST = MIN_SCORE / 2
CHUNK, AT_ONCE = 1 << 20, 1 << 20
_WORD = re.compile(r"\w+")
_OTHER = re.compile(r"[^\w\x00-\x7F]")
#: UTF-8 bytes of words, once _OTHER has become spaces.
_IS_WORD = np.array([b >= 128 or bool(_WORD.match(chr(b))) for b in range(256)])
_LAST = re.compile(r"(?s)(.*(?:\n|[.!?]\s))(.*\w.*)")

RESULT = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double, first_word int"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words_of all texts in order, from their length and first and last eight bytes, and the place of each text's first word."""
    cut = [(t if t.isascii() else _OTHER.sub(" ", t)).encode() for t in map(str.lower, texts)]
    buf = np.frombuffer(b" ".join([b" " * 7, *cut, b" " * 8]), np.uint8)
    inside = _IS_WORD[buf]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begins, ends = edges[::2], edges[1::2]
    eight = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
    sizes = ends - begins
    short = (np.maximum(8 - sizes, 0) * 8).astype(np.uint64)
    hashes = mix((eight[begins] << short) * np.uint64(0x9E3779B97F4A7C15) + (eight[ends - 8] >> short) + sizes.astype(np.uint64))
    return hashes, np.searchsorted(begins, np.cumsum([8, *(len(c) + 1 for c in cut)]))


def ranges_of(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of each range of the given size, one range after the other."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Question and answer of an item: the last line, or else the last sentence, is the answer."""
    body = text.strip()
    head, _, tail = body.rpartition("\n")
    if not (words_of(head) and words_of(tail)):
        m = _LAST.fullmatch(body)
        head, tail = m.groups() if m and words_of(m[1]) else (body, "")
    return words_of(head), words_of(tail)


def _place(cursor: list) -> int:
    return cursor[0][cursor[2]]


class Index:
    """Postings of items with impacts, and the maxima of their blocks."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], total: int, mean: float) -> None:
        self.ids = [i for i, _ in items]
        self.parts = [split_item(t) for _, t in items]
        self.width = max(PASSAGE, 2 * max((len(q) + len(a) for q, a in self.parts), default=0))
        self.rest = np.zeros(len(items))
        essential: list[tuple[str, int, float]] = []
        self.postings: dict[str, tuple[list[int], list[float]]] = {}
        for n, (q, a) in enumerate(self.parts):
            counts = Counter(q + a)
            size = len(q) + len(a)
            impact = {t: np.log(1 + (total - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * size / mean)) for t, c in counts.items()}
            own = sum(impact.values())
            for t in counts:
                p = self.postings.setdefault(t, ([], []))
                p[0].append(n)
                p[1].append(float(impact[t] / own))
            for t in sorted(counts, key=lambda t: (-df[t], t)):
                if self.rest[n] + impact[t] / own <= REST:
                    self.rest[n] += impact[t] / own
                else:
                    essential.append((t, n, float(impact[t] / own)))
        self.blocks = -(-len(items) // BLOCK)
        self.terms = {t: k for k, t in enumerate(self.postings)}
        #: For each word the blocks that hold it and their largest impacts, one word after the other, and as a dict.
        self.tops: dict[str, dict[int, float]] = {}
        for t, (at, impacts) in self.postings.items():
            top = self.tops[t] = {}
            for n, x in zip(at, impacts, strict=True):
                top[n // BLOCK] = max(top.get(n // BLOCK, 0.0), x)
        self.block_of = np.array([b for top in self.tops.values() for b in top], np.int64)
        self.block_top = np.array([x for top in self.tops.values() for x in top.values()])
        self.begin = np.cumsum([0, *(len(top) for top in self.tops.values())])
        self.most = {t: max(top.values()) for t, top in self.tops.items()}
        #: Essential postings by the hash of their word; a bit for every hash's leading bits.
        essential.sort()
        hashes = word_hashes([" ".join(t for t, _, _ in essential)])[0]
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.sizes = np.unique(hashes, return_counts=True)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.items_of = np.array([n for _, n, _ in essential], np.int64)[order]
        self.impacts = np.array([x for _, _, x in essential])[order]
        self.shift = np.uint64(64 - (16 * len(self.hashes) + 1).bit_length())
        self.seen = np.zeros(1 << 64 - int(self.shift), bool)
        self.seen[self.hashes >> self.shift] = True

    def useful(self, words: list[str]) -> list[str]:
        """Of a query's words those that stand in a block where the sum of the maxima of all reaches MIN_SCORE.

        Every item that the query scores MIN_SCORE lies in such a block, and gets its score from these words alone.
        """
        terms = np.fromiter((self.terms[w] for w in words), np.int64, len(words))
        size = self.begin[terms + 1] - self.begin[terms]
        at = ranges_of(self.begin[terms], size)
        block = self.block_of[at]
        high = np.bincount(block, self.block_top[at], self.blocks) + 1e-9 >= MIN_SCORE
        return [words[k] for k in np.unique(np.repeat(np.arange(len(words)), size)[high[block]]).tolist()]

    def search(self, words: list[str], among: list[int] | None = None) -> list[tuple[int, float]]:
        """(item, share of its own score) of every item that a query of distinct words scores MIN_SCORE or more.

        If it is known that such items are among some, in ascending order, the walk skips from one of these to the next.
        """
        cursors = [[self.postings[w][0], self.postings[w][1], 0, self.most[w], self.tops[w]] for w in words]
        found, target, k = [], 0, 0
        while True:
            if among is not None:
                k = bisect_left(among, target, k)
                if k == len(among):
                    return found
                target = among[k]
            kept = []
            for c in cursors:
                if c[0][c[2]] < target:
                    c[2] = bisect_left(c[0], target, c[2])
                if c[2] < len(c[0]):
                    kept.append(c)
            cursors = kept
            cursors.sort(key=_place)
            high, pivot = 1e-9, -1
            for n, c in enumerate(cursors):
                high += c[3]
                if high >= MIN_SCORE:
                    pivot = n
                    break
            if pivot < 0:
                return found
            item = _place(cursors[pivot])
            while pivot + 1 < len(cursors) and _place(cursors[pivot + 1]) == item:
                pivot += 1
            block = item // BLOCK
            after = _place(cursors[pivot + 1]) if pivot + 1 < len(cursors) else self.blocks * BLOCK
            if sum(c[4].get(block, 0.0) for c in cursors[: pivot + 1]) + 1e-9 < MIN_SCORE:
                target = min(after, (block + 1) * BLOCK)  # no item before it gets more from these words
            elif _place(cursors[0]) == item:
                score = fsum(c[1][c[2]] for c in cursors[: pivot + 1])  # the same in whatever order the walk has left them
                if score >= MIN_SCORE:
                    found.append((item, score))
                target = item + 1
            else:
                target = item

    def promising(self, texts: list[str]) -> dict[int, dict[int, list[int]]]:
        """number of a text -> first word of a passage -> items whose bound reaches MIN_SCORE in it; what has none is left out."""
        stride = self.width // 2
        hashes, begin = word_hashes(texts)
        at = np.flatnonzero(self.seen[hashes >> self.shift])
        term = np.searchsorted(self.hashes, hashes[at], "right") - 1
        true = self.hashes[term] == hashes[at]
        at, term = at[true], term[true]
        last = np.maximum(-(-np.diff(begin) // stride) - 1, 1)  # passages of each text
        start = np.cumsum(last) - last
        text = np.searchsorted(begin, at, "right") - 1
        place = (at - begin[text]) // stride
        # a word lies in the passage that begins in its stride and in the one before
        passage = np.concatenate([(start[text] + place)[place < last[text]], (start[text] + place - 1)[place > 0]])
        pair = np.sort(passage * max(1, len(self.hashes)) + np.concatenate([term[place < last[text]], term[place > 0]]))
        pair = pair[np.diff(pair, prepend=-1) > 0]
        passage, term = np.divmod(pair, max(1, len(self.hashes)))
        size, out = self.sizes[term], []
        reach = np.cumsum(size)
        a = 0
        while a < len(pair):  # whole passages with about AT_ONCE postings
            b = int(np.searchsorted(reach, reach[a] - size[a] + AT_ONCE, "right"))
            b = int(np.searchsorted(passage, passage[max(a, b - 1)], "right"))
            posting = ranges_of(self.firsts[term[a:b]], size[a:b])
            key, which = np.unique(np.repeat(passage[a:b], size[a:b]) * len(self.rest) + self.items_of[posting], return_inverse=True)
            high = np.bincount(which, self.impacts[posting]) + self.rest[key % len(self.rest)] + 1e-9 >= MIN_SCORE
            out.append(key[high])
            a = b
        passage, item = np.divmod(np.concatenate(out or [pair]), max(1, len(self.rest)))
        text = np.searchsorted(start, passage, "right") - 1
        found: dict[int, dict[int, list[int]]] = {}
        for n, at, i in zip(text.tolist(), ((passage - start[text]) * stride).tolist(), item.tolist(), strict=True):
            found.setdefault(n, {}).setdefault(at, []).append(i)
        return found

    def candidates(self, words: list[str], passages: dict[int, list[int]]) -> dict[int, tuple[float, int]]:
        """item -> (best score, first word of that passage) over the promising passages of a document."""
        out: dict[int, tuple[float, int]] = {}
        for at, among in passages.items():
            query = list(self.terms.keys() & words[at : at + self.width])
            if query := self.useful(query):
                for item, score in self.search(sorted(query), among):
                    if score > out.get(item, (0.0, 0))[0]:
                        out[item] = (score, at)
        return out


def overlap(part: list[str], shingles: dict[int, set[tuple[str, ...]]]) -> float:
    """Share of the words of part that lie in a run of SHINGLE words (or all of a shorter part) found in the document."""
    if not part:
        return 1.0
    n = min(SHINGLE, len(part))
    covered = 0
    reach = 0
    for i in range(len(part) - n + 1):
        if tuple(part[i : i + n]) in shingles[n]:
            covered += i + n - max(reach, i)
            reach = i + n
    return covered / len(part)


class _Shingles(dict):
    """Sets of shingles of a document by width, made when asked for."""

    def __init__(self, words: list[str]) -> None:
        self.words = words

    def __missing__(self, n: int) -> set[tuple[str, ...]]:
        self[n] = set(zip(*(self.words[i:] for i in range(n)), strict=False))
        return self[n]


_INDEXES: dict[tuple, Index] = {}


def _shared_index(key: str, part: tuple) -> Index:
    """The index of the part, built once for all tasks of a Python worker; that of the last part only."""
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = Index(*part)
    return _INDEXES[key]


def _matcher(items: list[tuple[int, str]], df: dict[str, int], total: int, mean: float):
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _shared_index(key, (items, df, total, mean))
        for batch in batches:
            rows = []
            docs, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            reach = np.cumsum([len(t) for t in texts]) // CHUNK
            for chunk in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(reach)) + 1):
                for n, passages in index.promising([texts[k] for k in chunk]).items():
                    words = words_of(texts[chunk[n]])
                    shingles = _Shingles(words)
                    for item, (score, at) in sorted(index.candidates(words, passages).items()):
                        q, a = (overlap(p, shingles) for p in index.parts[item])
                        if q >= MIN_OVERLAP and a >= MIN_OVERLAP:
                            rows.append((docs[int(chunk[n])].as_py(), index.ids[item], score, q, a, at))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])

    return run


def _cut_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items that have words, with their number and the different ones."""
    for batch in batches:
        words = [words_of(t) for t in batch.column("text").to_pylist()]
        some = pa.array([n for n, w in enumerate(words) if w], pa.int64())
        own = batch.take(some)
        sizes, terms = pa.array([len(w) for w in words if w], pa.int64()), pa.array([sorted(set(w)) for w in words if w], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([own.column("item_id"), own.column("text"), sizes, terms], names=["item_id", "text", "size", "terms"])


def contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "text") -> DataFrame:
    """A row for each pair of a document and an item that it holds. The item's columns are item_id and item_col."""
    given = items.select(F.col("item_id").cast("long").alias("item_id"), text_of(item_col).alias("text"))
    given = stored(given.mapInArrow(_cut_items, "item_id bigint, text string, size bigint, terms array<string>"), "items")
    texts = docs.select("doc_id", text_of(text_col).alias("text"))
    known = given.agg(F.count(F.lit(1)).alias("total"), F.sum("size").alias("size"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n = max(1, -(-(known["bytes"] or 0) // PART_BYTES))
    dealt = given.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    terms = dealt.select("part", F.explode("terms").alias("term"))
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    of_parts = stored(terms.distinct().join(counts, "term"), "item-terms") if n > 1 else counts.select(F.lit(0).alias("part"), "term", "df")
    out = []
    for part in range(n):  # what is collected is one part: about PART_BYTES of items and the words in them
        rows = sorted((r["item_id"] is not None, r["item_id"] or 0, r["text"], r["item_id"]) for r in dealt.where(F.col("part") == part).select("item_id", "text").collect())
        df = {r["term"]: r["df"] for r in of_parts.where(F.col("part") == part).select("term", "df").collect()}
        found = texts.mapInArrow(_matcher([(i, t) for _, _, t, i in rows], df, known["total"], (known["size"] or 0) / max(1, known["total"])), RESULT)
        out.append(stored(found, "found") if n > 1 else found)
    return reduce(DataFrame.unionByName, out)
