"""Fill-in-middle transformation by one numpy kernel over the Arrow buffers of a whole batch.

A text is cut into lines (a line keeps its end) at two places drawn from its id; prefix, middle and suffix are put in the
order of form `psm` or `spm` between sentinels. The kernel works on the UTF-8 bytes of many rows at once: a table of 256
entries gives each byte's class, a line starts at a document's first byte and behind each line end, the running count of
starts less its value at the document's begin numbers the lines of each document, and searchsorted finds the byte of every cut of
every row in that count. Outputs are gathered by one index from the texts and the sentinels. A batch is worked on in slices of
BYTES bytes, so memory is bounded by the longest text.

Draws are the first four 8-digit groups of sha256("seed:id") in hex, made in the JVM. The draw and the cuts depend on the row alone, so a lost
executor changes nothing; there is no shuffle.

Edge cases: null and empty texts are `plain` and stay empty; so do texts that hold a sentinel, which could not be told from an inserted one;
a null id draws as the empty string; rows that repeat give equal rows; an empty table gives an empty result; other columns are kept,
those whose names the operator needs (n, form, prefix_chars, middle_chars) are replaced and the text column holds the output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import text_of

SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM_RATE = 7, 100, 50
#: Bytes of text that the kernel takes at once (one text at least).
BYTES = 2 << 20
#: Byte classes: 1 ends a line, 2 continues a character.
_CLASS = np.zeros(256, np.uint8)
_CLASS[10], _CLASS[128:192] = 1, 2
PLAIN, PSM, SPM = 0, 1, 2
FORMS = pa.array(["plain", "psm", "spm"])


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Sentinels must not overlap: an occurrence then is always one that was inserted."""
    for i, s in enumerate(sentinels):
        for j, t in enumerate(sentinels):
            if not s or (i != j and s in t) or any(s[-k:] == t[:k] for k in range(1, min(len(s), len(t)))):
                raise ValueError(f"sentinels must be non-empty and not overlap: {sentinels}")


def _taken(source: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of all pieces, one after the other."""
    before = np.cumsum(sizes) - sizes
    return source[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


def kernel(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray, plain: np.ndarray, sentinels: tuple[str, str, str], spm_rate: int) -> tuple[np.ndarray, ...]:
    """Texts as bytes with offsets (rows + 1); draws: h1, h2, h4 of each row; plain: rows that stay.

    Returns the output's bytes and offsets, and for each row the number of lines, the form, and the characters of prefix and middle.
    """
    begin, end = offsets[:-1], offsets[1:]
    kind = _CLASS[data]
    border = np.concatenate([[False], kind == 1])  # a line starts behind each line end and at each text's first byte
    border[begin[begin < end]] = True
    running = np.cumsum(border[:-1], dtype=np.int64)
    chars = np.concatenate([[0], np.cumsum(kind != 2, dtype=np.int64)])
    counted = np.concatenate([[0], running])
    base, n = counted[begin], counted[end] - counted[begin]
    cuts = np.sort(np.stack([draws[0] % (n + 1), draws[1] % (n + 1)]), axis=0)
    # The first byte at which the document's own count of starts passes the cut; beyond the last line, the document's end.
    at = np.minimum(np.searchsorted(running, base + cuts + 1), end)
    form = np.where(plain | (begin == end), PLAIN, np.where(draws[2] % 100 < spm_rate, SPM, PSM))
    marks = [s.encode() for s in sentinels]
    source = np.concatenate([data, np.frombuffer(b"".join(marks), np.uint8)])
    mark = len(data) + np.concatenate([[0], np.cumsum([len(m) for m in marks])])
    prefix, middle, suffix = (begin, at[0] - begin), (at[0], at[1] - at[0]), (at[1], end - at[1])
    signs = [(np.full(len(n), mark[i]), np.full(len(n), len(m))) for i, m in enumerate(marks)]
    nothing = (begin, np.zeros(len(n), np.int64))
    orders = {PLAIN: [(begin, end - begin), *[nothing] * 5], PSM: [signs[0], prefix, signs[1], suffix, signs[2], middle], SPM: [signs[1], suffix, signs[0], prefix, signs[2], middle]}
    starts, sizes = (np.stack([np.select([form == f for f in orders], [o[i][j] for o in orders.values()]) for i in range(6)], axis=1).astype(np.int64) for j in range(2))
    out = _taken(source, starts.ravel(), sizes.ravel())
    return out, np.concatenate([[0], np.cumsum(sizes.sum(1))]), n, form, chars[at[0]] - chars[begin], chars[at[1]] - chars[at[0]]


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, or of one row."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def _transform(text: str, sentinels: tuple[str, str, str], rate: int, spm_rate: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            names = whole.schema.names[:-1]
            for low, high in _slices(pc.binary_length(whole.column(text)).to_numpy(zero_copy_only=False).astype(np.int64), most):
                batch = whole.slice(low, high - low)
                column = batch.column(text).cast(pa.large_string())
                offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
                data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
                draws = np.stack([np.asarray(x) for x in batch.column(len(names)).flatten()]) if batch.num_rows else np.empty((4, 0), np.int64)
                held = np.zeros(batch.num_rows, bool)
                for s in sentinels:
                    held |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
                out, ends, n, form, before, between = kernel(data, offsets - offsets[0], draws[[0, 1, 3]], held | (draws[2] % 100 >= rate), sentinels, spm_rate)
                made = pa.LargeStringArray.from_buffers(batch.num_rows, pa.py_buffer(ends), pa.py_buffer(out)).cast(pa.string())
                none = form == PLAIN
                columns = [made if c == text else batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n), FORMS.take(pa.array(form)), pa.array(before, mask=none), pa.array(between, mask=none)], names=[*names, "n", "form", "prefix_chars", "middle_chars"])

    return run


def fill_in_middle(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """docs with the transformed text, and n (lines), form, prefix_chars, middle_chars (null if plain)."""
    check_sentinels(sentinels)
    kept = docs.drop("n", "form", "prefix_chars", "middle_chars")
    rows = kept.withColumn(text_col, text_of(text_col))
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", n bigint, form string, prefix_chars bigint, middle_chars bigint"
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = F.transform(F.array(digest), lambda d: F.struct(*[F.conv(F.substring(d, 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]))
    return rows.select("*", draws[0].alias("fim draws")).mapInArrow(_transform(text_col, sentinels, rate, spm_rate, BYTES), schema)


def restored(text: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text before the transformation, from the output and the form alone."""
    p, s, m = sentinels
    after = lambda x, sign: F.substring_index(x, sign, -1)
    before = lambda x, sign: F.substring_index(x, sign, 1)
    psm = F.concat(after(before(text, s), p), after(text, m), before(after(text, s), m))
    spm = F.concat(before(after(text, p), m), after(text, m), before(after(text, s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)
