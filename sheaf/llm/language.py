"""Language identification: sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams. Document frequencies
are counted over all training texts; the weights are fitted on a bounded sample
by follow-the-regularised-leader with L1 and L2 penalties, and a temperature
fitted on sample rows held back from that makes the scores probabilities.

These scores share 1 among the learned languages, so they cannot tell that a
text is in none of them. That is told by how likely its n-grams are in the
language found, against the rows held back: those of that language on one side,
the same texts with their letters shuffled and those of the other languages on
the other. No other language's score enters, however many there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.batches import U64, mix, texts
from sheaf.llm.sampling import bounded, fetched

BINS, ORDERS = 1 << 15, (1, 2, 3)
# Documents of each language that the weights are fitted on, in the order of
# the hashes of their ids. Statistics and predictions know no such bound.
PER_LANGUAGE = 800
UNKNOWN = "und"
PIECE_CHARS = 1 << 20
# Sample rows of which one also teaches with its letters shuffled.
SHUFFLED = 4
# An occurrence shares characters with so many others, so these count as one.
OVERLAPPING = sum(ORDERS)


def _letters() -> np.ndarray:
    """Every code point's lower-case letter, or a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_TABLE: list[np.ndarray] = []


def code_points(text: str) -> np.ndarray:
    """Letters in lower case; runs of anything else are one space."""
    if not _TABLE:
        _TABLE.append(_letters())
    points = _TABLE[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = points == 32
    keep = np.ones(len(points), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return points[keep]


def counts(text: str) -> np.ndarray:
    """How often each bin's n-grams occur in the whole text; zeros without a letter."""
    out = np.zeros(BINS, np.int64)
    for first in range(0, len(text), PIECE_CHARS):
        # Pieces overlap by what an n-gram can reach over.
        points = code_points(text[first : first + PIECE_CHARS + max(ORDERS) - 1]).astype(U64)
        if not (points != 32).any():
            continue
        hashed = np.zeros(len(points), U64)
        for n in range(1, max(ORDERS) + 1):
            m = len(points) - n + 1
            if m <= 0:
                break
            hashed = hashed[:m] * U64(0x9E3779B97F4A7C15) + points[n - 1 :]
            if n in ORDERS:
                out += np.bincount((mix(hashed + U64(n)) % U64(BINS)).astype(np.int64), minlength=BINS)
    return out


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0
    known: Known | None = None

    def features(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(found)
        return at, self.weighted(at, found[at])

    def weighted(self, at: np.ndarray, found: np.ndarray) -> np.ndarray:
        """TF-IDF weights of the bins ``at``, of unit length."""
        values = (1 + np.log(found)) * self.idf[at]
        return values / max(1e-12, np.sqrt((values**2).sum()))

    def predict(self, text: str) -> tuple[str, float, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, 0.0
        found = counts(text)
        at, values = self.features(found)
        p = softmax(self.weights[:, at] @ values / self.temperature)
        best, *others = np.argsort(-p, kind="stable")[:2].tolist()
        return self.languages[best], float(p[best]), self.known.best(best, others, at, found[at]) if self.known else 1.0


@dataclass
class Known:
    """Whether a text is in a language at all, by the mean log ratio of its n-grams to even chance."""

    ratios: np.ndarray
    inside: np.ndarray
    outside: np.ndarray
    between: np.ndarray  # variance of the means of long texts
    within: np.ndarray  # variance of one n-gram
    mixed: tuple[float, float] = (0.0, 0.0)  # inside and outside of two languages in equal parts

    def best(self, language: int, others: list[int], at: np.ndarray, found: np.ndarray) -> float:
        """``score`` of the language, or of it mixed with the next likeliest one if that is higher."""
        score = self.score(language, self.ratios[language, at], found, self.inside[language], self.outside[language])
        for other in others if score < 0.5 else []:
            score = max(score, self.score(language, self.mix(language, other, at), found, *self.mixed))
        return score

    def mix(self, a: int, b: int, at: np.ndarray) -> np.ndarray:
        return np.logaddexp(self.ratios[a, at], self.ratios[b, at]) - np.log(2)

    def score(self, language: int, ratios: np.ndarray, found: np.ndarray, high: float, low: float) -> float:
        """Probability of the language against texts in none, both as likely beforehand.

        The shorter the text, the nearer to one half.
        """
        mean = found @ ratios / found.sum()
        spread = self.between[language] + OVERLAPPING * self.within[language] / found.sum()
        odds = (high - low) * (mean - (high + low) / 2) / max(1e-9, spread) if high > low else 0.0
        return float(1 / (1 + np.exp(-np.clip(odds, -50, 50))))


def fit_known(
    rows: list[tuple[int, np.ndarray, np.ndarray]], held: list[tuple[int, np.ndarray, np.ndarray]],
    noise: list[tuple[int, np.ndarray, np.ndarray]], classes: int,
) -> Known:
    """From ``label, bins, counts``: ratios from ``rows``, the bounds from ``held`` and ``noise``."""
    totals = np.zeros((classes, BINS))
    for label, at, found in rows:
        totals[label, at] += found
    totals += 0.5
    ratios = np.log(totals / totals.sum(axis=1, keepdims=True) * BINS).astype(np.float32)
    inside, outside, between, within = (np.zeros(classes) for _ in range(4))
    for k in range(classes):

        def means(some: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
            return np.array([found @ ratios[k, at] / found.sum() for _, at, found in some])  # noqa: B023

        own = [r for r in held if r[0] == k] or [r for r in rows if r[0] == k]
        if not own:
            continue
        mean = means(own)
        inside[k] = np.median(mean)
        between[k] = (1.4826 * np.median(np.abs(mean - inside[k]))) ** 2
        within[k] = np.median([found @ (ratios[k, at] - m) ** 2 / found.sum() for (_, at, found), m in zip(own, mean, strict=True)])
        others = [[r for r in noise if r[0] == k] or noise, *([r for r in held if r[0] == o] for o in range(classes) if o != k)]
        outside[k] = max((np.median(means(x)) for x in others if x), default=inside[k])
    known = Known(ratios, inside, outside, between, within)
    if classes > 1:
        # Halves in two languages; and texts in a language as if it were not learned, and shuffled ones.
        halves, foreign = [], []
        for (a, at, own), (b, at_b, own_b) in zip(held, held[len(held) // 2 :] + held[: len(held) // 2], strict=True):
            if a != b:
                mean = [f @ known.mix(a, b, x) / f.sum() for x, f in ((at, own), (at_b, own_b))]
                halves.append(sum(mean) / 2)
        for label, at, own in [*(held if classes > 2 else []), *((-1, *r[1:]) for r in noise)]:
            means_ = ratios[:, at] @ own / own.sum()
            a, b = [int(k) for k in np.argsort(-means_, kind="stable") if k != label][:2]
            foreign.append((label < 0, own @ known.mix(a, b, at) / own.sum()))
        kinds = [[m for n, m in foreign if n is kind] for kind in (True, False)]
        if halves and foreign:
            known.mixed = (float(np.median(halves)), max(float(np.median(x)) for x in kinds if x))
    return known


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit_ftrl(
    rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, epochs: int = 3, alpha: float = 0.5,
    beta: float = 1.0, l1: float = 0.05, l2: float = 0.05, seed: int = 1,
) -> np.ndarray:
    """Weights (class by bin) of ``label, bins, values`` rows, with per-coordinate rates."""
    z, n, w = (np.zeros((classes, BINS)) for _ in range(3))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            label, at, values = rows[r]
            zi, ni = z[:, at], n[:, at]
            wi = np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2), 0.0)
            miss = softmax(wi @ values)
            miss[label] -= 1
            g = miss[:, None] * values
            grown = ni + g * g
            z[:, at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * wi
            n[:, at] = grown
    np.copyto(w, np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0))
    return w


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden section on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        x = logits / np.exp(t)
        top = x.max(axis=1)
        return float((top + np.log(np.exp(x - top[:, None]).sum(axis=1)) - x[np.arange(len(labels)), labels]).mean())

    low, high, ratio = -3.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, seen = 0, np.zeros(BINS, np.int64)
    for batch in batches:
        for text in texts(batch.column(0)):
            seen += counts(text) > 0
            rows += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(at, BINS), pa.int32()), pa.array(np.append(seen[at], rows), pa.int64())], names=["bin", "df"]
    )


def shuffled(text: str, seed: int) -> str:
    """The same letters and spaces in another order."""
    points = np.random.default_rng(seed).permutation(code_points(text))
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), strict=True))
        rows = [(i, label, False, t) for i, label, t in rows] + [
            (i, label, True, shuffled(t, seed))
            for i, label, t in rows
            if (seed := zlib.crc32(i.encode())) % SHUFFLED == 0
        ]
        bins, found = [], []
        for r in rows:
            # All bins of one text at a time: those of a batch would take 500 MB.
            every = counts(r[3])
            at = np.flatnonzero(every)
            bins.append(at.astype("<u2").tobytes())
            found.append(every[at].astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows]),
             pa.array(bins, pa.binary()), pa.array(found, pa.binary())],
            names=["id", "label", "noise", "bins", "counts"],
        )


def fit(training: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on ``id, text, label``; rows with a null among them or without a letter teach nothing.

    What comes to the driver is bounded: a number for each bin, and the bins of
    ``per_language`` documents of each language.
    """
    rows = training.dropna(subset=["id", "text", "label"]).filter(F.col("text").rlike(r"\p{L}"))
    df, documents = np.zeros(BINS), 0
    frequencies = rows.select("text").mapInArrow(_frequencies, "bin int, df bigint")
    for bin_, n in frequencies.groupBy("bin").agg(F.sum("df")).collect():
        if bin_ == BINS:
            documents = n
        else:
            df[bin_] = n
    idf = np.log((1 + documents) / (1 + df)) + 1
    chosen = bounded(rows, per_language)
    sample = rows.join(F.broadcast(chosen), ["id", "label"]).select(F.col("id").cast("string").alias("id"), "label", "text")
    found = fetched(sample.mapInArrow(_described, "id string, label string, noise boolean, bins binary, counts binary"))
    found.sort(key=lambda r: (r["label"], r["id"], len(r["bins"])))
    languages = sorted({r["label"] for r in found})
    model = Model(languages, np.zeros((len(languages), BINS)), idf)
    place = {label: k for k, label in enumerate(languages)}
    plain, noise = [], []
    for r in found:
        at = np.frombuffer(r["bins"], "<u2").astype(np.int32)
        (noise if r["noise"] else plain).append((place[r["label"]], at, np.frombuffer(r["counts"], "<f4")))
    del found
    if not languages:
        return model
    examples = [(label, at, model.weighted(at, own).astype(np.float32)) for label, at, own in plain]
    held = [e for i, e in enumerate(examples) if i % 5 == 0]
    model.weights = fit_ftrl([e for i, e in enumerate(examples) if i % 5], len(languages))
    logits = np.array([model.weights[:, at] @ values for _, at, values in held])
    model.temperature = fit_temperature(logits, np.array([e[0] for e in held]))
    model.known = fit_known([e for i, e in enumerate(plain) if i % 5], plain[::5], noise, len(languages))
    return model


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``known`` (0 to 1) to every row, from the whole text alone.

    ``score`` is that of the language among those learned, ``known`` tells
    whether the text is in that language at all. A null text, one without
    letters, and every text where there is no learned language, is ``und`` with
    score and known 0. Columns of ``docs`` come back in the
    struct ``row``, whatever they are called; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.predict(t) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                 pa.array([f[2] for f in found], pa.float64())],
                names=["row", "lang_pred", "score", "known"],
            )

    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, known double")
