"""Secret scans with an incremental blob ledger.

Each version of each file is content-addressed (SHA-256 of its text). The ledger holds one row per
(blob, rule, version) that has been scanned, with the spans found, possibly none. A scan takes only the
pairs that the ledger lacks, whatever number of paths or versions carry the blob, and findings are
joined back to every path.

Copies are dropped inside each input task before the shuffle by blob, so a text that fills a third of
all rows costs one row per task, or one for each SEEN different texts. Texts are compressed and shuffled once, and a task meets the
copies of a blob one after the other, so it remembers one blob; the join back to paths moves hashes only.

Edge cases: a null text is the empty text; an empty table gives an empty result; rows with the same id
keep their own findings (the join is on the blob); other columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import stored, text_of

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PEM = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")


def _assign(text: str) -> list[tuple[int, int]]:
    low = text.lower()  # finds no fewer hints than the ASCII rule does
    if not any(h in low for h in _ASSIGN_HINTS) or ("=" not in text and ":" not in text):
        return []
    # A match whose value is short is dropped only after it has used up its characters.
    return [m.span() for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]


def _spans_of(pattern: re.Pattern) -> Callable[[str], list[tuple[int, int]]]:
    return lambda text: [m.span() for m in pattern.finditer(text)]


#: kind -> (version, scanner), in the order in which spans at one start are listed. The first three are the base kinds.
RULES: dict[str, tuple[int, Callable[[str], list[tuple[int, int]]]]] = {
    "assign": (1, _assign),
    "access": (1, _spans_of(_ACCESS)),
    "hex": (1, _spans_of(_HEX)),
    "pem": (1, _spans_of(_PEM)),
}
BASE = ("assign", "access", "hex")
#: Blobs that an input task remembers to have passed on.
SEEN = 1 << 16

LEDGER = "blob string, rule string, version int, spans array<struct<start:int,end:int>>"


def _first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their texts compressed, without those whose blob this task has lately passed on."""
    seen: set[str] = set()
    for batch in batches:
        blobs, texts = [], []
        for i, blob in enumerate(batch.column("blob").to_pylist()):
            if blob not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(blob)
                blobs.append(blob)
                texts.append(zlib.compress(batch.column("text")[i].as_py().encode(), 1))
        yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array(texts, pa.binary())], names=["blob", "packed"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ledger rows of the due rules; rows come in order of the blob."""
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    last = None
    for batch in batches:
        out: dict[str, list] = {"blob": [], "rule": [], "version": [], "spans": []}
        for blob, packed, rules in zip(*(batch.column(c).to_pylist() for c in ("blob", "packed", "rules")), strict=True):
            if blob == last:
                continue
            last, text = blob, zlib.decompress(packed).decode()
            for due in rules:
                rule, _, version = due.rpartition("@")
                out["blob"].append(blob)
                out["rule"].append(rule)
                out["version"].append(int(version))
                out["spans"].append([{"start": a, "end": b} for a, b in RULES[rule][1](text)])
        yield pa.RecordBatch.from_arrays([pa.array(out["blob"], pa.string()), pa.array(out["rule"], pa.string()), pa.array(out["version"], pa.int32()), pa.array(out["spans"], spans_type)], names=["blob", "rule", "version", "spans"])


def scan_new(docs: DataFrame, ledger: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """Ledger rows for the (blob, rule, version) triples of docs that ledger lacks."""
    now = [f"{rule}@{version}" for rule, (version, _) in RULES.items()]
    blobs = docs.select(text_of(text_col).alias("text")).withColumn("blob", F.sha2("text", 256)).select("blob", "text")
    blobs = blobs.mapInArrow(_first_copies, "blob string, packed binary")
    due = F.array(*map(F.lit, now))
    if ledger is not None:
        known = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "version")).alias("known"))
        blobs = blobs.join(known.hint("merge"), "blob", "left")
        due = F.array_except(due, F.coalesce("known", F.array().cast("array<string>")))
    blobs = blobs.select("blob", "packed", due.alias("rules")).where(F.size("rules") > 0)
    return blobs.repartition("blob").sortWithinPartitions("blob").mapInArrow(_scan, LEDGER)


def findings(docs: DataFrame, ledger: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, blob and `found`, an array of (start, kind order, kind, end) in reporting order."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(RULES) for x in (k, i)])
    current = F.create_map(*[F.lit(x) for k, (v, _) in RULES.items() for x in (k, v)])
    hits = (
        ledger.where((F.size("spans") > 0) & (F.col("version") == current[F.col("rule")]))
        .select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[F.col("rule")].alias("k"), F.col("rule").alias("kind"), s["end"].alias("end"))).alias("s"))
        .groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("found"))
    )
    paths = docs.select(F.col(id_col), F.sha2(text_of(text_col), 256).alias("blob"))
    return paths.join(hits, "blob", "left").withColumn("found", F.coalesce("found", F.expr("cast(array() as array<struct<start:int,k:int,kind:string,end:int>>)")))


def scan_secrets(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings per path, ledger rows to append). The new rows are stored before they are used."""
    new = stored(scan_new(docs, ledger, text_col), "ledger")
    whole = new if ledger is None else ledger.unionByName(new)
    return findings(docs, whole, id_col, text_col), new


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts per base kind, SHA-256 of the base spans, all spans, blob.

    docs come as two deliveries of one source: the rows of half of the ids first, then a version with all rows. The second
    scan takes from the ledger of the first what it knows, and scans only blobs that are new; both give findings for all rows.
    """
    early = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    _, ledger = scan_secrets(early)
    found, _ = scan_secrets(docs, ledger)
    joined = lambda kinds: F.concat_ws(",", F.transform(F.filter("found", lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(BASE), 256).alias("base_sha256"), joined(tuple(RULES)).alias("spans"), "blob")
