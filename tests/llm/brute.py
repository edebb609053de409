"""Plain versions of the operators, and a small table with every awkward row."""

import collections
import hashlib
import random
import re
import zlib

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, blob string, size int, rank int, doc bigint, rep bigint, kept boolean, first bigint, one string"


def words(t):
    return SPACE_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioustrnlé") for _ in range(rng.randint(2, 7))) for _ in range(n))


def awkward_docs(seed=5):
    """(doc_id, text, source): nulls, empty and very long texts, copies, near copies, shared passages, ties."""
    rng = random.Random(seed)
    base, passage = prose(rng, 150), prose(rng, 60)
    edited = base.split()
    edited[70] = "changed"
    moved = base.split()
    moved[3:9] = ["x"] * 6
    texts = [None, "", "   \n\t", "word", "Two words", "two words", base, base, base.upper(), " ".join(edited), " ".join(moved), passage + " " + prose(rng, 40), prose(rng, 30) + "\n" + passage, passage * 3, "ab" * 400, "ab" * 400 + "c", "é" * 150, "x\0y" * 90, "a", prose(rng, 9000), prose(rng, 2) * 300, "key: token = 'abcdef12' AKIA" + "Z" * 16 + " " + "0f" * 12]
    rows = [(i, t, ["s1", "s2", None, "ß", "S1"][i % 5]) for i, t in enumerate(texts)]
    return rows + [(6, base, "s1"), (3, "word", "s1")]


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, None, s, len(t or ""), "x", 1, 2, 3, 4, True, 5, "z") for i, t, s in rows], SCHEMA)


def spans(text):
    t, out = text or "", []
    for order, (kind, pattern, least) in enumerate((("assign", r"(?:[pP][aA][sS][sS][wW](?:[oO][rR])?[dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6), ("access", r"(AKIA[A-Z0-9]+)", 20), ("hex", r"([0-9a-f]+)", 24))):
        out += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, t) if len(m[1]) >= least]
    return sorted(out)


def joined(found):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)


def repeated(rows, window=200):
    """doc rows -> (n_bytes, n_removed, n_spans, sha256 of the rest), in order."""
    raw = [(t or "").encode() for _, t, _ in rows]
    seen = collections.Counter(b[i : i + window] for b in raw for i in range(len(b) - window + 1))
    out = []
    for b in raw:
        cover = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                cover[i : i + window] = b"\1" * window
        runs = sum(1 for i, c in enumerate(cover) if c and not (i and cover[i - 1]))
        out.append((len(b), sum(cover), runs, hashlib.sha256(bytes(x for x, c in zip(b, cover, strict=True) if not c)).hexdigest()))
    return out


def shingle_set(t, width):
    w = words(t)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def components(rows, width, percent):
    """doc_id -> least doc_id reachable; rows that share an id are one node."""
    sets = [(i, shingle_set(t, width)) for i, t, _ in rows]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: root(i) for i, _ in sets}


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
