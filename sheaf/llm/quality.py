"""Quality classification by supervised subword embeddings.

A document is the mean of the learned vectors of its words and of their
character n-grams, all hashed into one table, and a softmax layer on top.
Vectors and layer are trained together by stochastic gradient descent in
numpy. A word that repeats the one before it is the word bigram of a hashed
bucket of its own. As the layer is linear, a word's share of the score is one
number, which a task works out once per distinct word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.batches import U64, WordNumbers, chunks, mix, utf8
from sheaf.llm.sampling import fetched, weighted

BUCKETS, DIM = 1 << 17, 12
GRAMS = (2, 3, 4)
SAME = BUCKETS
# Labelled documents of each label that the vectors are trained on, in the
# order of the hashes of their ids. Each stands for as many as its label has for
# one of the sample, so the ratio of the labels does not depend on the bound.
PER_LABEL = 3000
# Words a process remembers; beyond them it starts anew.
CACHE_WORDS = 300_000
# Texts of about so many bytes are looked up together.
CHUNK_BYTES = 1 << 22


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of the character n-grams of ``<word>``, and their bounds."""
    marked = [f"<{w.decode()}>" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    every = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(U64)
    owner = np.repeat(np.arange(len(words)), lengths)
    owners, buckets = [], []
    rolling = np.zeros(len(every), U64)
    for n in range(1, max(GRAMS) + 1):
        m = max(0, len(every) - n + 1)
        rolling = rolling[:m] * U64(0x9E3779B97F4A7C15) + every[n - 1 :][:m]
        if n in GRAMS:
            own = np.flatnonzero(owner[:m] == owner[n - 1 :][:m])
            owners.append(owner[own])
            buckets.append(mix(rolling[own] + U64(n)))
    place = np.arange(len(every)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    if len(every):
        whole = np.add.reduceat(mix(every + (place.astype(U64) << U64(32))), np.cumsum(lengths) - lengths)
        owners.append(np.arange(len(words)))
        buckets.append(mix(whole))
    owner = np.concatenate([*owners, np.zeros(0, np.int64)])
    bucket = (np.concatenate([*buckets, np.zeros(0, U64)]) % U64(BUCKETS)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.searchsorted(owner[order], np.arange(len(words) + 1))


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a document and their shares, which sum to 1."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    index: dict[bytes, int] = {}
    codes = np.array([index.setdefault(w, len(index)) for w in words])
    buckets, bounds = subwords(list(index))
    size = np.diff(bounds)
    weight = np.bincount(buckets, np.repeat(np.bincount(codes, minlength=len(index)), size), BUCKETS + 1)
    weight[SAME] = size[codes[1:][codes[1:] == codes[:-1]]].sum()
    at = np.flatnonzero(weight)
    return at, weight[at] / weight.sum()


@dataclass
class Model:
    """Score of a bucket: the difference of the two logits; a document's is their mean plus the bias."""

    buckets: np.ndarray
    bias: float
    trained: bool = True

    def scorer(self) -> Scorer:
        """One for each process, which thus remembers words from task to task."""
        if not hasattr(self, "_scorer"):
            self._scorer = Scorer(self)
        return self._scorer


def train(
    rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 0.5, seed: int = 1,
    weights: tuple[float, float] = (1.0, 1.0),
) -> Model:
    """Vectors and softmax layer of ``label, buckets, shares`` rows; ``weights`` are those of a row's loss by label."""
    pick = np.random.default_rng(seed)
    vectors = pick.uniform(-1, 1, (BUCKETS + 1, DIM)) / DIM
    layer, bias = pick.uniform(-1, 1, (2, DIM)) / DIM, np.zeros(2)
    # The layer keeps its scale; the vectors do the learning for rare buckets.
    steps, done = epochs * max(1, len(rows)), 0
    for _ in range(epochs):
        for r in pick.permutation(len(rows)):
            label, at, share = rows[r]
            step = rate * (1 - done / steps)
            done += 1
            mean = share @ vectors[at]
            logits = layer @ mean + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            p *= weights[label]
            back = p @ layer
            layer -= step * np.outer(p, mean)
            bias -= step * 0.1 * p
            # A bucket's share is small; its step is scaled to the document.
            vectors[at] -= step * 20 * np.outer(share, back)
    return Model(vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0]))


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.index = WordNumbers()
        self.sums, self.sizes = np.zeros(0), np.zeros(0, np.int64)

    def learn(self) -> None:
        buckets, bounds = subwords(self.index.new)
        self.index.new = []
        total = np.concatenate([[0.0], np.cumsum(self.model.buckets[buckets])])
        self.sums = np.append(self.sums, total[bounds[1:]] - total[bounds[:-1]])
        self.sizes = np.append(self.sizes, np.diff(bounds))

    def scores(self, batch: list[bytes]) -> list[float]:
        """Probability of label 1 for each text."""
        if len(self.index) > CACHE_WORDS:
            self.clear()
        number = self.index.__getitem__
        found = [np.array(list(map(number, text.split())), np.int64) for text in batch]
        if self.index.new:
            self.learn()
        out = []
        for at in found:
            logit = self.model.bias
            if len(at):
                same = self.sizes[at[1:][at[1:] == at[:-1]]].sum()
                logit += (self.sums[at].sum() + same * self.model.buckets[SAME]) / (self.sizes[at].sum() + same)
            out.append(float(1 / (1 + np.exp(-np.clip(logit, -50, 50)))))
        return out


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        found = [features(data[a:b].tobytes()) for a, b in zip(offsets, offsets[1:], strict=False)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(3), pa.array([f[0].astype("<i4").tobytes() for f in found], pa.binary()),
             pa.array([f[1].astype("<f4").tobytes() for f in found], pa.binary())],
            names=["id", "label", "weight", "buckets", "shares"],
        )


def fit(training: DataFrame, per_label: int | None = PER_LABEL) -> Model:
    """Fit on ``id, text, label`` (0 or 1); rows with a null among them teach nothing.

    The driver gets the features of ``per_label`` documents of each label at
    most; None if the rows given are bounded already, and then with a column
    ``weight``, how many each stands for. Without rows every score is one half.
    """
    rows = training.dropna(subset=["id", "text", "label"]).filter("label in (0, 1)")
    if per_label is not None:
        rows = rows.join(F.broadcast(weighted(rows, per_label)), ["id", "label"])
    weight = F.col("weight") if "weight" in rows.columns else F.lit(1.0)
    sample = rows.select(
        F.col("id").cast("string").alias("id"), F.col("label").cast("int").alias("label"), "text", weight.alias("weight")
    )
    found = fetched(sample.mapInArrow(_described, "id string, label int, weight double, buckets binary, shares binary"))
    found.sort(key=lambda r: (r["label"], r["id"], len(r["buckets"])))
    examples = [(r["label"], np.frombuffer(r["buckets"], "<i4"), np.frombuffer(r["shares"], "<f4")) for r in found]
    stands = dict((r["label"], r["weight"]) for r in found)
    whole = sum(r["weight"] for r in found)
    del found
    if not examples:
        return Model(np.zeros(BUCKETS + 1), 0.0, trained=False)
    # The weights average 1, so the steps keep their size.
    return train(examples, weights=tuple(stands.get(k, 0.0) * len(examples) / whole for k in (0, 1)))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1, higher: label 1 likelier) to every row, from the whole text alone.

    A null text is empty; an empty one scores by the bias. Columns of ``docs``
    come back in the struct ``row``, whatever they are called; nothing is
    shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            found = []
            for first, last in chunks(offsets, CHUNK_BYTES):
                found += scorer.scores([data[offsets[i] : offsets[i + 1]].tobytes() for i in range(first, last)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["row", "score"])

    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double")
