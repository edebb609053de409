"""Removal of repeated strings by a sparse suffix array with deep-shallow sorting.

Every byte covered by a WINDOW-byte string that also starts anywhere else goes. Matches never cross documents.

Which strings can repeat is found without moving texts. Each WINDOW-byte string has an anchor: the gram of GRAM
bytes in it with the least hash, the rightmost of equals. Equal strings have equal anchors at equal places, so
starts are grouped by anchor: consecutive starts with one anchor are a run, with the bytes they cover as its
content. Only keys (hash of the anchor, hash of the content, 128-bit key of the text) are shuffled at first.

- An anchor with one run: nothing in it repeats.
- A content seen twice or more: all starts of its runs repeat.
- What is left: different contents around one anchor. One run of each content sends its bytes to the group of the
  anchor. There the suffixes that begin at the anchor are sorted, and so are the prefixes that end there, read
  backwards. Starts at distance j before the anchor are equal if their backward strings agree for j bytes and their
  suffixes for WINDOW - j bytes; adjacent common prefixes of the two orders give the classes for each j.

The sort is deep-shallow (Manzini and Ferragina, 2004): multikey quicksort splits each group in three around a pivot word
of 8 bytes, word after word down to SHALLOW words, and groups that still agree are long-common-prefix groups that a
blind trie puts in order.

Groups of more than HOT different contents around one anchor are never gathered: each of their starts becomes a
row with the 128-bit hash of its string, counted with partial aggregates. Contents are told apart by 64-bit hashes.

Hot keys: an anchor, content or string that very many rows share is counted by partial aggregates, and what is joined
back to the rows is a row for each of SALTS salts of a key that repeats, so the rows of one key meet it in SALTS places.
Runs of anchors that no other run has are dropped first, so the later steps move little. Equal rows of one id share
their key, and what is found for a key is gathered without repeats, so it is bounded by the text's own length.

Edge cases: null texts and texts shorter than WINDOW keep all bytes; a very long text is cut into pieces of starts;
equal rows repeat each other, also under one id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import stored, text_of
from nearfield.llm.shingles import mix, stream

WINDOW, GRAM = 200, 32
SHALLOW = 2
HOT = 4096
SALTS = 8
_PIECE = 1 << 19  # starts of a piece; places take 20 bits
_PLACE = (1 << 20) - 1
_BYTE = stream(11, 256)
_G = 0xD6E8FEB86659FD95
_ONE = np.ones(1, np.uint64)
_POW = np.cumprod(np.concatenate([_ONE, np.full(_PIECE * 2 - 1, _G, np.uint64)]))
_INV = np.cumprod(np.concatenate([_ONE, np.full(_PIECE * 2 - 1, pow(_G, -1, 1 << 64), np.uint64)]))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values."""
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if width > span else h


def runs(buf: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """first start, number of starts, anchor - first, hash of the anchor, hash of the content, of each run in buf.

    valid: for each start of a whole window, if it counts. buf is shorter than two pieces.
    """
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * _POW[: len(buf)])])
    gram = mix((prefix[GRAM:] - prefix[:-GRAM]) * _INV[: len(buf) - GRAM + 1])
    keyed = gram & np.uint64(~_PLACE & (1 << 64) - 1) | np.uint64(_PLACE) - np.arange(len(gram), dtype=np.uint64)
    anchor = _PLACE - (_least(keyed, WINDOW - GRAM + 1) & np.uint64(_PLACE)).astype(np.int64)
    at = np.flatnonzero(valid)
    if not len(at):
        return tuple(np.empty(0, np.int64) for _ in range(5))
    own = anchor[at]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)])
    head = np.flatnonzero(new)
    first, count, own = at[head], np.diff(np.append(head, len(at))), own[head]
    content = (prefix[first + count - 1 + WINDOW] - prefix[first]) * _INV[first]
    content = mix(content ^ mix((count * 1024 + own - first).astype(np.uint64)))
    return first, count, own - first, gram[own].view(np.int64), content.view(np.int64)


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("d1", "d2", "first", "count", "off", "anchor", "content")
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())

    def found(group: list[tuple[tuple[int, int], int, bytes]]) -> pa.RecordBatch:
        buf = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
        sizes = np.array([len(p) for _, _, p in group])
        begins = np.cumsum(sizes) - sizes
        valid = np.zeros(len(buf) - WINDOW + 1, bool)
        for b, n in zip(begins, sizes, strict=True):
            valid[b : b + n - WINDOW + 1] = True
        first, *rest = runs(buf, valid)
        which = np.searchsorted(begins, first, "right") - 1
        doc = np.array([d for d, _, _ in group])[which]
        at = np.array([a for _, a, _ in group])[which]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((doc[:, 0], doc[:, 1], first - begins[which] + at, *rest), types, strict=True)], names=list(names))

    group: list[tuple[tuple[int, int], int, bytes]] = []
    held = 0
    for batch in batches:
        for *doc, text in zip(*(batch.column(c).to_pylist() for c in ("d1", "d2", "text")), strict=True):
            raw = text.encode()
            for at in range(0, len(raw) - WINDOW + 1, _PIECE):
                piece = raw[at : at + _PIECE + WINDOW - 1]
                if held + len(piece) > _PIECE + WINDOW and group:
                    yield found(group)
                    group, held = [], 0
                group.append((doc, at, piece))
                held += len(piece)
    if group:
        yield found(group)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contents of the wanted runs of each document; equal rows come one after the other, and the first one counts."""
    last = None
    for batch in batches:
        for d1, d2, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("d1", "d2", "text", "wanted")), strict=True):
            if (d1, d2) == last:
                continue
            last = (d1, d2)
            raw = text.encode()
            col = lambda k, t: pa.array([w[k] for w in wanted], t)  # noqa: B023, E731
            same = lambda x: pa.array([x] * len(wanted), pa.int64())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [col("anchor", pa.int64()), same(d1), same(d2), col("first", pa.int64()), col("count", pa.int32()), col("off", pa.int32()), col("alone", pa.bool_()), col("hot", pa.bool_()), pa.array([raw[w["first"] : w["first"] + w["count"] - 1 + WINDOW] for w in wanted], pa.binary())],
                names=["anchor", "d1", "d2", "first", "count", "off", "alone", "hot", "bytes"],
            )


def _common_prefix(s: bytes, t: bytes) -> int:
    n = min(len(s), len(t))
    differ = int.from_bytes(s[:n], "big") ^ int.from_bytes(t[:n], "big")
    return n - -(-differ.bit_length() // 8)


class BlindTrie:
    """Strings in order by a trie that keeps, at each node, the place of a difference and its bytes only."""

    def __init__(self, strings: list[bytes]) -> None:
        self.strings = strings
        self.root: int | list = 0
        for i in range(1, len(strings)):
            self._insert(i)

    def _insert(self, new: int) -> None:
        s = self.strings[new]
        node = self.root
        while not isinstance(node, int):
            b = s[node[0]] if node[0] < len(s) else -1
            node = node[1].get(b) if b in node[1] else next(iter(node[1].values()))
        t = self.strings[node]
        k = _common_prefix(s, t)
        parent, node = None, self.root
        while not isinstance(node, int) and node[0] < k:
            parent, b = node, s[node[0]] if node[0] < len(s) else -1
            node = node[1][b]
        if k == len(s) == len(t):  # equal strings share a leaf list at an end-of-string node
            k = len(s)
        mine = s[k] if k < len(s) else -1
        if not isinstance(node, int) and node[0] == k:
            if mine in node[1]:
                mine = (mine, new)  # an equal string: beside its twin
            node[1][mine] = new
            return
        theirs = t[k] if k < len(t) else -1
        split = [k, {theirs: node, (mine, new) if mine == theirs else mine: new}]
        if parent is None:
            self.root = split
        else:
            parent[1][s[parent[0]] if parent[0] < len(s) else -1] = split

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, int):
                out.append(node)
            else:
                stack += [v for _, v in sorted(node[1].items(), key=lambda x: x[0] if isinstance(x[0], tuple) else (x[0], -1), reverse=True)]
        return out


def deep_shallow(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of rows (fixed-width byte strings) within ascending groups."""
    words = np.ascontiguousarray(rows[:, : SHALLOW * 8]).view(">u8").astype(np.uint64)
    order, part, depth = _multikey_quicksort(words, group)
    if len(order):
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        open_ = (np.diff(edges) > 1) & (depth[edges[:-1]] == SHALLOW)
        for a, b in zip(edges[:-1][open_], edges[1:][open_], strict=True):
            tied = order[a:b]
            order[a:b] = tied[BlindTrie([rows[i, SHALLOW * 8 :].tobytes() for i in tied]).order()]
    return order


def _multikey_quicksort(words: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of words in order within groups; the part of each place, and how many words all rows of the part agree in.

    Each turn splits every open part around the middle one of three of its words: below and above go on with the same
    word, equals with the next (Bentley and Sedgewick, 1997). All parts take their turn at once.
    """
    order = np.argsort(group, kind="stable")
    tied = group[order]
    part = np.cumsum(np.concatenate([[0], tied[1:] != tied[:-1]])) if len(order) else order
    depth = np.zeros(len(order), np.int64)
    while len(order):
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        sizes = np.diff(edges)
        active = (sizes > 1) & (depth[edges[:-1]] < words.shape[1])
        if not active.any():
            break
        begin, size = edges[:-1][active], sizes[active]
        places = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        owner = np.repeat(np.arange(len(begin)), size)
        at = depth[begin]
        three = np.stack([words[order[begin + x], at] for x in (size * 0, size // 2, size - 1)])
        pivot = np.sort(three, axis=0)[1][owner]
        key = words[order[places], depth[places]]
        side = (key >= pivot).astype(np.int64) + (key > pivot)
        step = np.argsort(owner * 3 + side, kind="stable")
        order[places], depth[places] = order[places][step], depth[places] + (side[step] == 1)
        inner = np.zeros(len(order), bool)
        inner[places] = np.concatenate([[True], (owner * 3 + side[step])[1:] != (owner * 3 + side[step])[:-1]])
        inner[edges[:-1]] = True
        part = np.cumsum(inner)
    return order, part, depth


def _classes(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The deep-shallow order, and the common prefix of each row with the one before (-1 at a new group)."""
    order = deep_shallow(rows, group)
    a, b = rows[order[:-1]], rows[order[1:]]
    differ = a != b
    lcp = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    lcp[group[order[1:]] != group[order[:-1]]] = -1
    return order, np.concatenate([[-1], lcp])


def repeated_starts(contents: list[bytes], off: np.ndarray, count: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each content (row) and distance j before its anchor (column): if that start is one of the content's and
    its string also starts at another content of the group."""
    n, back = len(contents), WINDOW - GRAM + 1
    right, left = np.zeros((n, WINDOW), np.uint8), np.zeros((n, back), np.uint8)
    for i, c in enumerate(contents):
        raw = np.frombuffer(c, np.uint8)
        o = off[i]
        right[i, : len(raw) - o] = raw[o:]
        left[i, :o] = raw[:o][::-1]
    r_order, r_lcp = _classes(right[:, GRAM:], group)
    l_order, l_lcp = _classes(left, group)
    r_lcp = np.where(r_lcp >= 0, r_lcp + GRAM, -1)
    out = np.zeros((n, back), bool)
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for j in range(back):
        valid = (j <= off) & (j > off - count)
        if valid.sum() < 2:
            continue
        r_class[r_order] = np.cumsum(r_lcp < WINDOW - j)
        l_class[l_order] = np.cumsum(l_lcp < j)
        at = np.flatnonzero(valid)
        key = l_class[at] * (n + 1) + r_class[at]
        step = np.argsort(key, kind="stable")
        same = key[step][1:] == key[step][:-1]
        out[at[step[1:][same]], j] = True
        out[at[step[:-1][same]], j] = True
    return out


def _intervals(first: np.ndarray, flags: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, first start and number of starts of each run of flags; column j of flags stands for first + off - j."""
    edge = np.diff(np.pad(flags[:, ::-1].astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    return rows, first[rows] + off[rows] - (flags.shape[1] - 1) + a, b - a


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor; a group is compared when it is whole, many groups at once."""

    def done(t: pa.Table) -> pa.RecordBatch:
        off, count = t["off"].to_numpy(), t["count"].to_numpy()
        flags = repeated_starts(t["bytes"].to_pylist(), off, count, np.unique(t["anchor"].to_numpy(), return_inverse=True)[1])
        flags &= t["alone"].to_numpy()[:, None]
        rows, first, n = _intervals(t["first"].to_numpy(), flags, off)
        return pa.RecordBatch.from_arrays([pa.array(t[k].to_numpy()[rows], pa.int64()) for k in ("d1", "d2")] + [pa.array(first, pa.int64()), pa.array(n, pa.int64())], names=["d1", "d2", "first", "count"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            held.append(batch.slice(at, 4096))
            t = pa.Table.from_batches(held)
            if t.num_rows < 4096:
                continue
            anchors = t["anchor"].to_numpy()
            border = int(np.searchsorted(anchors, anchors[-1]))
            if border:
                yield done(t.slice(0, border).combine_chunks())
                held = t.slice(border).combine_chunks().to_batches()
    if held and sum(b.num_rows for b in held):
        yield done(pa.Table.from_batches(held).combine_chunks())


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each start of each content with the hash of its string."""
    for batch in batches:
        for d1, d2, first, count, alone, raw in zip(*(batch.column(c).to_pylist() for c in ("d1", "d2", "first", "count", "alone", "bytes")), strict=True):
            sums = [hashlib.blake2b(raw[i : i + WINDOW], digest_size=16).digest() for i in range(count)]
            halves = [pa.array([int.from_bytes(x[k : k + 8], "little", signed=True) for x in sums], pa.int64()) for k in (0, 8)]
            same = [pa.array([x] * count, t) for x, t in ((d1, pa.int64()), (d2, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*halves, *same, pa.array(range(first, first + count), pa.int64()), pa.array([alone] * count, pa.bool_())], names=["h1", "h2", "d1", "d2", "first", "alone"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
        for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
            raw = text.encode()
            spans = removed_spans([(f["first"], f["count"]) for f in found or ()])
            digest, at = hashlib.sha256(), 0
            for a, b in spans:
                digest.update(raw[at:a])
                at = b
            digest.update(raw[at:])
            for k, v in zip(out, (len(raw), sum(b - a for a, b in spans), len(spans), digest.hexdigest()), strict=True):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items())], names=["doc_id", *out])


def removed_spans(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal byte spans that starts (first, count) cover."""
    spans: list[tuple[int, int]] = []
    for first, count in sorted(found):
        end = first + count - 1 + WINDOW
        if spans and first <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], end))
        else:
            spans.append((first, end))
    return spans


def _salt(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int").alias("salt")


def _for_all_salts(keys: DataFrame) -> DataFrame:
    """A row for each salt of each key, for a sort-merge join: Spark takes the compressed files of the keys for the size of these rows, and would
    broadcast millions of them."""
    return keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")


def _repeated(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows (with `salt`) whose keys occur twice or more, with `n`, how often."""
    often = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), name)
    return rows.join(_for_all_salts(often), [*keys, "salt"])


_RUN = ("d1", "d2", "first", "count")


def repeated_intervals(texts: DataFrame) -> DataFrame:
    """d1, d2, first, count: all starts whose string also starts elsewhere. texts: d1, d2 (128-bit key of the row), text."""
    found = texts.mapInArrow(_find_runs, "d1 bigint, d2 bigint, first bigint, count int, off int, anchor bigint, content bigint")
    found = stored(found.withColumn("salt", _salt("d1", "first")), "runs")
    again = stored(_repeated(found, ["anchor"], "anchors").drop("n"), "again")
    contents = again.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*_RUN, "off")).alias("one"))
    contents = stored(contents.select("anchor", "content", (F.col("n") == 1).alias("alone"), "one", _salt("content")), "contents")
    twice = _for_all_salts(contents.where("not alone").select("anchor", "content"))
    parts = [again.join(twice, ["anchor", "content", "salt"], "left_semi").select(*_RUN[:3], F.col("count").cast("long").alias("count"))]
    mixed = _repeated(contents, ["anchor"], "mixed-anchors").select("anchor", "one.*", "alone", (F.col("n") > HOT).alias("hot"))  # n: different contents
    wanted = stored(mixed.groupBy("d1", "d2").agg(F.collect_list(F.struct("anchor", "first", "count", "off", "alone", "hot")).alias("wanted")), "wanted")
    cut = texts.join(wanted.hint("merge"), ["d1", "d2"]).select("d1", "d2", "text", "wanted").mapInArrow(_cut, "anchor bigint, d1 bigint, d2 bigint, first bigint, count int, off int, alone boolean, hot boolean, bytes binary")
    if not wanted.where(F.exists("wanted", lambda w: w["hot"])).isEmpty():
        cut = stored(cut, "cut")
        strings = cut.where("hot").mapInArrow(_strings, "h1 bigint, h2 bigint, d1 bigint, d2 bigint, first bigint, alone boolean").withColumn("salt", _salt("d1", "first"))
        parts.append(_repeated(stored(strings, "strings"), ["h1", "h2"], "often").where("alone").select(*_RUN[:3], F.lit(1).cast("long").alias("count")))
    parts.append(cut.where("not hot").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare, "d1 bigint, d2 bigint, first bigint, count bigint"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def suffix_dedup(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs."""
    rows = docs.select("doc_id", text_of(text_col).alias("text")).withColumns({"d1": F.xxhash64("doc_id", "text"), "d2": F.xxhash64(F.lit(WINDOW), "text", "doc_id")})
    found = repeated_intervals(rows.select("d1", "d2", "text")).groupBy("d1", "d2").agg(F.collect_set(F.struct("first", "count")).alias("found"))
    return rows.join(found.hint("merge"), ["d1", "d2"], "left").select("doc_id", "text", "found").mapInArrow(_remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
