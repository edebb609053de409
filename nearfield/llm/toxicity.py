"""Toxic spans by a linear-chain conditional random field.

Labels exist for documents. They give token labels by induction: a word, or its first letters, that is far more
frequent among toxic documents than among others is a marker, and marked tokens of toxic documents are the first toxic
ones. A CRF with the states clean and toxic learns weights of the markers, of a marker on the left and on the right, and
of transitions. Its own marginals then label the tokens of toxic documents anew, so that tokens beside markers may turn
toxic and markers that stand alone may turn clean, and it is learned once more. For any text, forward-backward gives each token's
probability to be toxic; their sum and density give the document's score through a logistic regression, and tokens at
0.5 or more give the offending offsets.

Tokens without a marker on or beside them all have the same potential, so a stretch of them is a power of one 2 x 2
matrix, made by squaring: inference is exact for any length and visits few tokens.

Tokens and offsets come from one text: the lower-cased one, in which letters whose lower case has another length stay.

The model is fitted in one task on a bounded sample (at most SAMPLE labelled rows of each class, whole texts, in the
order of a hash of the id; an id counts once, with its least text), and comes to the driver as a few thousand numbers;
scoring is one narrow pass over all texts.

Edge cases: null and empty texts have no tokens and get the score of no evidence; without labels of both
classes every score is the share of toxic labels, or 0; labels with a null are ignored; equal labels of one document
count once; other columns, such as lang and source, are never read.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import text_of

SAMPLE = 2000
PREFIXES = (4, 5, 6)
MIN_ODDS, MIN_SHARE, MIN_DOCS = 2.5, 0.01, 3
SKETCH = 16
#: A marker of few documents is used several times in each and never in clean ones.
FEW_DOCS, USES = 2, 2.5
WINDOW, STEPS, MORE_STEPS, RATE, DECAY = 64, 80, 40, 0.15, 1e-3
THRESHOLD = 0.7
_TOKEN = re.compile(r"\w+")
_NEAR = 512  # powers up to this one are kept; higher ones are products of repeated squares


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


def lowered(text: str) -> str:
    """text in lower case, of the same length: letters that would become several stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) > 1 else x for c in text)


def words_of(text: str) -> list[str]:
    return _TOKEN.findall(lowered(text))


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    #: Log potentials: of transitions from row to column, and of the toxic state of any token.
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    bias: float = 0.0
    #: Log potentials of the toxic state of a token after, and before, one with a marker.
    beside: tuple[float, float] = (0.0, 0.0)
    #: Of the logistic regression on log1p(sum of probabilities) and density; its constant is first.
    final: tuple[float, float, float] = (-20.0, 0.0, 0.0)

    def __post_init__(self) -> None:
        self.short = {w for w in self.weights if not w.endswith("*") and len(w) < PREFIXES[0]}
        self.stems = {w.rstrip("*")[: PREFIXES[0]] for w in self.weights} - self.short
        self.step = np.exp(self.moves) * np.exp([0.0, self.bias])
        self.powers = [np.eye(2)]
        for _ in range(_NEAR):
            m = self.powers[-1] @ self.step
            self.powers.append(m / m.sum())
        self.squares = [self.powers[_NEAR]]  # of _NEAR * 2**j steps
        for _ in range(50):
            m = self.squares[-1] @ self.squares[-1]
            self.squares.append(m / m.sum())
        self.memo: dict[str, float] = {}

    def to_json(self) -> str:
        return json.dumps({"weights": self.weights, "moves": self.moves.tolist(), "bias": self.bias, "beside": self.beside, "final": self.final})

    @classmethod
    def from_json(cls, text: str) -> Model:
        x = json.loads(text)
        return cls(x["weights"], np.array(x["moves"]), x["bias"], tuple(x["beside"]), tuple(x["final"]))

    def power(self, n: int) -> np.ndarray:
        """A multiple of the n-th power of step."""
        high, low = divmod(n, _NEAR)
        out, j = self.powers[low], 0
        while high:
            if high & 1:
                out = out @ self.squares[j]
                out = out / out.sum()
            high, j = high >> 1, j + 1
        return out

    def weight(self, word: str) -> float:
        w = self.memo.get(word)
        if w is None:
            if len(self.memo) > 100_000:
                self.memo.clear()
            w = self.memo[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return w

    def marked(self, words: list[str]) -> list[tuple[int, float]]:
        """(place, log potential besides the bias) of the tokens that have a marker or stand beside one."""
        stems, short, n = self.stems, self.short, PREFIXES[0]
        found: dict[int, float] = {}
        for i, w in enumerate(words):
            if (w[:n] in stems or w in short) and (x := self.weight(w)):
                found[i] = found.get(i, 0.0) + x
                if i + 1 < len(words):
                    found[i + 1] = found.get(i + 1, 0.0) + self.beside[0]
                if i:
                    found[i - 1] = found.get(i - 1, 0.0) + self.beside[1]
        return sorted(found.items())

    def marginals(self, marked: list[tuple[int, float]], n: int) -> list[float]:
        """Probability of the toxic state at each marked token of a chain of n tokens."""
        start = np.ones(2) @ self.step
        forward, at = [], -1
        for i, w in marked:
            f = start @ self.power(i) if at < 0 else forward[-1] @ self.step @ self.power(i - at - 1)
            f = f / f.sum() * np.array([1.0, np.exp(min(w, 30.0))])
            forward.append(f / f.sum())
            at = i
        back, out = self.power(n - 1 - at) @ np.ones(2) if marked else None, []
        for k in range(len(marked) - 1, -1, -1):
            p = forward[k] * back
            out.append(float(p[1] / p.sum()))
            if k:
                i, w = marked[k]
                back = self.power(i - marked[k - 1][0] - 1) @ self.step @ (np.array([1.0, np.exp(min(w, 30.0))]) * back)
                back = back / back.sum()
        return out[::-1]

    def evidence(self, words: list[str]) -> tuple[list[tuple[int, float]], float, float]:
        """(place, probability) of marked tokens, log1p of the sum of probabilities, density in per cent."""
        marked = self.marked(words)
        if not marked:
            return [], 0.0, 0.0
        p = self.marginals(marked, len(words))
        total = sum(p)
        return [(i, x) for (i, _), x in zip(marked, p, strict=True)], float(np.log1p(total)), 100 * total / len(words)

    def score(self, total: float, density: float) -> float:
        z = self.final[0] + self.final[1] * total + self.final[2] * min(density, 5.0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _markers(docs: list[list[str]], toxic: list[int]) -> set[str]:
    # Toxic documents first: what few of them share is no marker, and need not be counted elsewhere.
    first: Counter = Counter()
    for words, y in zip(docs, toxic, strict=True):
        if y:
            first.update({f for w in set(words) for f in features(w)})
    seen: tuple[Counter, Counter] = (Counter(), Counter({f: c for f, c in first.items() if c >= FEW_DOCS}))
    uses: Counter = Counter()
    del first
    for words, y in zip(docs, toxic, strict=True):
        if y:
            uses.update(f for w in words for f in features(w) if f in seen[1])
        else:
            seen[0].update({f for w in set(words) for f in features(w) if f in seen[1]})
    n = [toxic.count(0), toxic.count(1)]
    odds = lambda f: np.log((seen[1][f] + 0.5) / (n[1] + 1)) - np.log((seen[0][f] + 0.5) / (n[0] + 1))
    often = lambda f, c: c >= max(MIN_DOCS, MIN_SHARE * n[1]) or c >= FEW_DOCS and uses[f] >= USES * c and not seen[0][f]
    return {f for f, c in seen[1].items() if often(f, c) and odds(f) >= MIN_ODDS}


def _families(docs: list[list[str]]) -> list[int]:
    """Places of the documents that are no near copy of an earlier one: copies would make all their words markers.

    Two documents are of one family if half of the SKETCH least hashes of their words agree.
    """
    seen: dict[int, list[int]] = {}
    out = []
    for i, words in enumerate(docs):
        sketch = sorted({zlib.crc32(w.encode()) for w in words})[:SKETCH]
        shared = Counter(j for h in sketch for j in seen.get(h, ()))
        if not sketch or max(shared.values(), default=0) * 2 < len(sketch):
            out.append(i)
            for h in sketch:
                seen.setdefault(h, []).append(i)
    return out


def _adam(value: np.ndarray, gradient: np.ndarray, state: list, t: int) -> np.ndarray:
    state[0] = 0.9 * state[0] + 0.1 * gradient
    state[1] = 0.99 * state[1] + 0.01 * gradient**2
    return value - RATE * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-8)


def _chain(emit: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (windows, tokens) of the toxic state and expected transitions, for windows of equal length."""
    n, length = emit.shape
    local = np.stack([np.ones((n, length)), np.exp(np.clip(emit, -30, 30))], 2)
    m = np.exp(moves)
    f = np.empty((n, length, 2))
    b = np.ones((n, length, 2))
    f[:, 0] = local[:, 0]
    for t in range(1, length):
        x = f[:, t - 1] @ m * local[:, t]
        f[:, t] = x / x.sum(1, keepdims=True)
    for t in range(length - 2, -1, -1):
        x = (local[:, t + 1] * b[:, t + 1]) @ m.T
        b[:, t] = x / x.sum(1, keepdims=True)
    p = f * b
    p /= p.sum(2, keepdims=True)
    pair = f[:, :-1, :, None] * m * (local * b)[:, 1:, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    return p[:, :, 1], pair.sum((0, 1))


@dataclass
class _Sample:
    """Windows of tokens: (window, token, feature) triples, where the last two features are the markers beside a token."""

    window: np.ndarray
    token: np.ndarray
    which: np.ndarray
    #: Which windows are of toxic documents, and which tokens hold a marker.
    toxic: np.ndarray
    marked: np.ndarray
    features: int


def _windows(docs: list[list[str]], toxic: list[int], index: dict[str, int]) -> _Sample:
    triples, of_toxic, rng = [], [], np.random.default_rng(7)
    for words, y in zip(docs, toxic, strict=True):
        for at in range(0, len(words), WINDOW):
            part = [[index[f] for f in features(w) if f in index] for w in words[at : at + WINDOW]]
            if any(part) or rng.random() < 0.05:
                triples += [(len(of_toxic), t, f) for t, fs in enumerate(part) for f in fs]
                of_toxic.append(y)
    window, token, which = (np.array(x, np.int64) for x in zip(*triples, strict=True))
    marked = np.zeros((len(of_toxic), WINDOW), bool)
    marked[window, token] = True
    sides = []
    for n, (shift, a, b) in enumerate(((1, slice(1, None), slice(None, -1)), (-1, slice(None, -1), slice(1, None)))):
        beside = np.zeros_like(marked)
        beside[:, a] = marked[:, b]
        sides.append((*np.nonzero(beside), n))
    window, token = (np.concatenate([x, *(s[k] for s in sides)]) for k, x in enumerate((window, token)))
    which = np.concatenate([which, *(np.full(len(s[0]), len(index) + s[2]) for s in sides)])
    return _Sample(window, token, which, np.array(of_toxic, bool), marked, len(index) + 2)


def _learn(sample: _Sample, target: np.ndarray, x: np.ndarray, steps: int) -> np.ndarray:
    """Weights of features, transitions and the bias, from token labels; x is where the steps begin."""
    n = sample.features
    pairs = np.array([[((target[:, :-1] == a) & (target[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    state: list = [np.zeros_like(x), np.zeros_like(x)]
    for step in range(1, steps + 1):
        p, expected = _chain(_emissions(sample, x), x[n:-1].reshape(2, 2))
        miss = p - target
        gradient = np.concatenate([np.bincount(sample.which, miss[sample.window, sample.token], n), (expected - pairs).ravel(), [miss.sum()]])
        x = _adam(x, gradient / len(target) + DECAY * x / 100, state, step)
    return x


def _emissions(sample: _Sample, x: np.ndarray) -> np.ndarray:
    emit = np.full(sample.marked.shape, x[-1])
    np.add.at(emit, (sample.window, sample.token), x[sample.which])
    return emit


def fit(texts: list[str], toxic: list[int]) -> Model:
    """The model of a labelled sample."""
    docs = [list(map(sys.intern, words_of(t))) for t in texts]
    places = _families(docs)
    docs, toxic = [docs[i] for i in places], [toxic[i] for i in places]
    share = sum(toxic) / max(1, len(toxic))
    plain = Model(final=(float(np.log(share / (1 - share))) if 0 < share < 1 else (20.0 if share else -20.0), 0.0, 0.0))
    if not 0 < share < 1:
        return plain
    names = sorted(_markers(docs, toxic))
    if not names:
        return plain
    sample = _windows(docs, toxic, {f: i for i, f in enumerate(names)})
    n = sample.features
    labels = (sample.marked & sample.toxic[:, None]).astype(float)
    x = _learn(sample, labels, np.concatenate([np.zeros(n), np.zeros(4), [-2.0]]), STEPS)
    p, _ = _chain(_emissions(sample, x), x[n:-1].reshape(2, 2))
    x = _learn(sample, ((p >= 0.5) & sample.toxic[:, None]).astype(float), x, MORE_STEPS)
    model = Model({f: float(v) for f, v in zip(names, x, strict=False)}, x[n:-1].reshape(2, 2), float(x[-1]), (float(x[n - 2]), float(x[n - 1])))
    found = np.array([(1.0, *model.evidence(words)[1:]) for words in docs])
    found[:, 2] = np.minimum(found[:, 2], 5.0)
    y, z = np.array(toxic, float), np.zeros(3)
    for _ in range(60):  # Newton's steps of a ridge logistic regression
        q = 1 / (1 + np.exp(-np.clip(found @ z, -30, 30)))
        h = (found * (q * (1 - q))[:, None]).T @ found + 0.05 * np.eye(3)
        z = z - np.clip(np.linalg.solve(h, found.T @ (q - y) + 0.05 * z), -2, 2)
    model.final = tuple(map(float, z))
    return model


def held_out() -> Column:
    """If the row's label is never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> Model:
    """Fit on rows that are not held out."""
    known = labels.where("toxic in (0, 1)").where(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("h")).distinct()
    # The sample is drawn among the labels; only its ids, 2 * SAMPLE at most, go to the tasks that read texts.
    drawn = known.where("toxic = 0").orderBy("h", "doc_id").limit(SAMPLE).unionByName(known.where("toxic = 1").orderBy("h", "doc_id").limit(SAMPLE))
    rows = docs.select("doc_id", text_of(text_col).alias("text"))
    sample = rows.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic", "h").agg(F.min("text").alias("text"))
    sample = sample.select("toxic", "h", "text").repartition(1).sortWithinPartitions("toxic", "h", "text")
    fitted = sample.mapInArrow(_fitter, "model string").first()
    return Model.from_json(fitted["model"]) if fitted else Model()


def _fitter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of the sample, which one task holds."""
    texts, toxic = [], []
    for batch in batches:
        texts += batch.column("text").to_pylist()
        toxic += batch.column("toxic").to_pylist()
    yield pa.RecordBatch.from_arrays([pa.array([fit(texts, toxic).to_json()])], names=["model"])


def spans_of(model: Model, text: str) -> tuple[float, list[tuple[int, int]]]:
    """The score of a text and the code points of its toxic tokens."""
    low = lowered(text)
    found, total, density = model.evidence(_TOKEN.findall(low))
    hits = {i for i, p in found if p >= 0.5}
    return model.score(total, density), [m.span() for i, m in enumerate(_TOKEN.finditer(low)) if i in hits] if hits else []


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans_of(model, t) for t in batch.column("text").to_pylist()]
            spans = [[{"start": a, "end": b} for a, b in s] for _, s in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([s for s, _ in found], pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["doc_id", "held_out", "score", "spans"])

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, spans (code points of toxic tokens, end exclusive) for each row of docs."""
    rows = docs.select("doc_id", held_out().alias("held_out"), text_of(text_col).alias("text"))
    out = rows.mapInArrow(_scorer(model), "doc_id bigint, held_out boolean, score double, spans array<struct<start:int,end:int>>")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).select("doc_id", "held_out", "score", "predicted", "spans")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, that are not predicted to be toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            keep = [model.score(*model.evidence(words_of(t or ""))[1:]) < THRESHOLD for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
