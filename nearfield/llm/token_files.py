"""Token-id output in fixed-width bit packing.

Every id takes the fewest bits that the vocabulary needs. Ids are cut into blocks; a block starts on a byte
of its own, so block k of a shard is found by its offset (k * block_ids) and unpacked by numpy alone.

The file format is a Parquet table with one row per block: shard, block, n_tokens, bits, block_ids, payload, and the
index of the documents that have ids in the block (doc_ids, doc_starts: place of the first id in the shard;
doc_lens). Rows lie in ascending order of the document id within a shard, and shards are ranges of the
document id. Spark's committer makes the files whole or absent when an executor is lost.

Documents are dealt to shards by range of the document id (one shuffle of texts, no other), tokenized in
order and written. Shards hold about SHARD_BYTES of text, more only where that would make over MOST_SHARDS of them, so the
table of ids per shard, whose running sum gives the global starts, is small whatever the number of rows. Rows of one id
are ordered by a hash of the text, which also is the second key of the ranges: very many rows of one id spread.

Tokenizing: a chunk between white space never influences its neighbours (the pre-tokenizer drops white space
and never crosses it), so each chunk of up to LONG letters is encoded once per cache period and then looked up.
Long chunks (scripts without spaces, encoded data) rarely come again and are encoded each time: what a worker holds
is bounded in bytes, not only in number, and long texts are cut at white space before they are encoded.

Edge cases: a null text is the empty text, which is the end id alone; documents with equal ids follow each
other, ordered by a hash of the text, then by the text; very long texts span blocks; an empty table gives empty files; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import stored, text_of

BLOCK = 1 << 16
#: Chunks that a worker remembers before it starts anew; about 0.2 GB. Longer ones than LONG letters are not remembered.
CACHE, LONG = 3 << 18, 64
#: Letters that are encoded at once; only a chunk that is longer by itself goes beyond.
PART = 1 << 18
SHARD_BYTES, MOST_SHARDS = 8 << 20, 100_000

BLOCKS = "shard int, block int, n_tokens int, bits int, block_ids int, doc_ids array<bigint>, doc_starts array<bigint>, doc_lens array<bigint>, payload binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Little-endian bit string of ids, bits each."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32) & 1).astype(np.uint8)
    return np.packbits(planes.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int, first: int = 0) -> np.ndarray:
    """count ids from place first of a block on."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count, first * bits // 8).astype(np.uint32)
    low, high = first * bits // 8, -(-(first + count) * bits // 8)
    raw = np.unpackbits(np.frombuffer(data, np.uint8, high - low, low), bitorder="little")
    raw = raw[first * bits - low * 8 :][: count * bits].reshape(count, bits)
    return (raw.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


class ChunkEncoder:
    """Ids of whole texts as little-endian 32-bit numbers; chunks between white space are remembered.

    In a text of Latin-1 letters that has no full stop or comma beside another sign, the tokenizer's pieces stay
    the same in lower case with spaces around full stops and commas, and so fewer chunks differ. New words are
    encoded many at once and told apart by the ids that end a word.
    """

    #: Separators of str.split() that the tokenizer does not see as white space.
    ODD = re.compile("[\x1c-\x1f]")
    #: Where a long text is cut: white space to str.split() and to the tokenizer alike.
    GAP = re.compile("[ \t\n\r]")
    #: A full stop or comma beside another sign, with which it is one piece.
    BESIDE = re.compile(r"[.,](?:(?=[^\w\s]|_)|(?<=[^\w\s].)|(?<=_.))", re.S)

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunks: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> None:
        words = [c for c in new if c.isalpha() and (c.isascii() or max(c) < "\u0250")]
        for at in range(0, len(words), 2048):
            part = words[at : at + 2048]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            border = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1]) * 4
            if len(border) == len(part) + 1:
                raw, cut = ids.tobytes(), border.tolist()
                self.chunks.update(zip(part, [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], strict=True))
            else:  # some word has no id of its own that ends it
                self.chunks.update(zip(part, self._plain(part), strict=True))
        other = list(new.difference(words))
        self.chunks.update(zip(other, self._plain(other), strict=True))

    def _split(self, text: str) -> list[str]:
        if self.ODD.search(text) or any(s in text for s in self.special):
            return [text]
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split()
        return text.split() if self.BESIDE.search(text) else text.lower().replace(",", " , ").replace(".", " . ").split()

    def _cut(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PART and (gap := self.GAP.search(text, at + PART)):
            yield text[at : gap.start()]
            at = gap.end()
        yield text[at:] if at else text

    def _looked_up(self, texts: list[str]) -> list[bytes]:
        split = [self._split(t) for t in texts]
        if len(self.chunks) > CACHE:
            self.chunks = {}
        new = set().union(*split).difference(self.chunks)
        self._learn(new)
        get = self.chunks.__getitem__
        out = [b"".join(map(get, cs)) for cs in split]
        for c in new:
            if len(c) > LONG:
                del self.chunks[c]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []
        size = 0

        def put() -> None:
            for (i, _), ids in zip(held, self._looked_up([t for _, t in held]), strict=True):
                out[i].append(ids)

        for i, text in enumerate(texts):
            for piece in self._cut(text):
                held.append((i, piece))
                size += len(piece)
                if size >= PART:
                    put()
                    held, size = [], 0
        put()
        return [b"".join(ids) for ids in out]


_ENCODERS: dict[str, ChunkEncoder] = {}


def _shared_encoder(path: str) -> ChunkEncoder:
    """One encoder for all tasks of a Python worker."""
    return _ENCODERS.get(path) or _ENCODERS.setdefault(path, ChunkEncoder(path))


def _encoder(path: str, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, end = _shared_encoder(path), np.array([end_id], "<u4").tobytes()
        bits = bits_for(encoder.tokenizer.get_vocab_size())
        shard, block, held, held_n, total = -1, 0, [], 0, 0
        docs: list[tuple[int, int, int]] = []

        def flush(count: int) -> pa.RecordBatch:
            nonlocal block, held, held_n, docs
            ids = np.frombuffer(b"".join(held), "<u4")
            rows = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([count], pa.int32()), pa.array([bits], pa.int32()), pa.array([size], pa.int32()), *(pa.array([[d[i] for d in docs]], pa.list_(pa.int64())) for i in range(3)), pa.array([pack(ids[:count], bits)], pa.binary())]
            held, held_n, block = [ids[count:].tobytes()], held_n - count, block + 1
            docs = [d for d in docs[-1:] if d[1] + d[2] > block * size]
            return pa.RecordBatch.from_arrays(rows, names=[x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                shard = part.column("shard")[0].as_py()
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist()), strict=True):
                    docs.append((doc, total, len(ids) // 4 + 1))
                    total += len(ids) // 4 + 1
                    held += [ids, end]
                    held_n += len(ids) // 4 + 1
                    while held_n >= size:
                        yield flush(size)
        if held_n:
            yield flush(held_n)

    return run


def write_tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, text_col: str = "text", block_ids: int = BLOCK) -> DataFrame:
    """Encode docs and store the block table; returns the table as read back.

    docs is read three times: for its size, for the bounds of the ranges, and for its texts. Only tasks load the tokenizer.
    """
    path = tokenizer or default_tokenizer()
    size = docs.agg(F.sum(F.octet_length(text_of(text_col)))).first()[0] or 0
    shards = max(2, docs.sparkSession.sparkContext.defaultParallelism, min(MOST_SHARDS, -(-size // SHARD_BYTES)))
    rows = docs.select("doc_id", text_of(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    dealt = rows.repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    return stored(dealt.select(F.spark_partition_id().alias("shard"), "doc_id", "text").mapInArrow(_encoder(path, end_id, block_ids), BLOCKS), "tokens")


def _doc_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Checksums of documents inside one block; of the others, the ids that lie in this block."""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("shard", "doc_id", "doc_start", "n_tokens", "ids_crc32", "block", "ids")}
        rows = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        for i in range(batch.num_rows):
            ids = unpack(rows["payload"][i], rows["bits"][i], rows["n_tokens"][i]).astype("<u4")
            for doc, at, n in zip(rows["doc_ids"][i], rows["doc_starts"][i], rows["doc_lens"][i], strict=True):
                low = at - rows["block"][i] * rows["block_ids"][i]
                part = ids[max(low, 0) : low + n].tobytes()
                whole = len(part) == 4 * n
                for k, v in zip(out, (rows["shard"][i], doc, at, n, zlib.crc32(part) if whole else None, rows["block"][i], None if whole else part), strict=True):
                    out[k].append(v)
        types = {"shard": pa.int32(), "block": pa.int32(), "ids": pa.binary()}
        yield pa.RecordBatch.from_arrays([pa.array(v, types.get(k, pa.int64())) for k, v in out.items()], names=list(out))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = [zlib.crc32(b"".join(p["ids"] for p in sorted(parts, key=lambda p: p["block"]))) for parts in batch.column("parts").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("shard", "doc_id", "doc_start", "n_tokens")), pa.array(crc, pa.int64())], names=["shard", "doc_id", "doc_start", "n_tokens", "ids_crc32"])


DOCS = "shard int, doc_id bigint, doc_start bigint, n_tokens bigint, ids_crc32 bigint"


def read_digests(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the stored blocks.

    A document inside one block is read from that block alone. Of one that crosses a border, at most two per
    block, the ids in each block are brought together.
    """
    sums = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # a row per shard, MOST_SHARDS at most
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = F.broadcast(sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("shard_start")))
    parts = stored(blocks.mapInArrow(_doc_parts, DOCS + ", block int, ids binary"), "token-parts")
    inside = parts.where("ids_crc32 is not null").select("shard", "doc_id", "doc_start", "n_tokens", "ids_crc32")
    pieces = parts.where("ids_crc32 is null").groupBy("shard", "doc_id", "doc_start", "n_tokens").agg(F.collect_list(F.struct("block", "ids")).alias("parts"))
    whole = inside.unionByName(pieces.mapInArrow(_joined, DOCS))
    return whole.join(placed, "shard").select("doc_id", (F.col("shard_start") + F.col("doc_start")).alias("start"), "n_tokens", "ids_crc32")


def read_tokens(blocks: DataFrame, shard: int, first: int, count: int) -> np.ndarray:
    """Random access: count ids of a shard from place first on; only the blocks that hold them are read."""
    one = blocks.select("block_ids").first()
    if not one or not count:
        return np.empty(0, np.uint32)
    size = one["block_ids"]
    low, high = first // size, (first + count - 1) // size
    rows = sorted(blocks.where((F.col("shard") == shard) & F.col("block").between(low, high)).select("block", "bits", "n_tokens", "payload").collect(), key=lambda r: r["block"])
    out = []
    for r in rows:
        a = max(0, first - r["block"] * size)
        b = min(r["n_tokens"], first + count - r["block"] * size)
        out.append(unpack(r["payload"], r["bits"], b - a, a))
    return np.concatenate(out) if out else np.empty(0, np.uint32)
