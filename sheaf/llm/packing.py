"""Mixture-controlled packing by deficit round-robin.

Documents wait in one queue per source. A window is a run of ``window``
sequences; in each one the round gives every queue a quantum of tokens, its
target share. A quantum is a fraction; a queue is served whole tokens and what
it is still owed stays in its deficit counter for the next window. After ``w``
windows of one phase a queue has been served ``floor(w * quantum)`` tokens, so
the counter is known at every window without walking through the earlier ones:
each partition takes up the round where it stands, and no task sees more than
its own documents. When a queue runs dry a new phase begins, in which the
others share its quantum by their weights.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.batches import WordNumbers, chunks, utf8
from sheaf.session import written

SEQUENCE, WINDOW = 4096, 32
# Sources beyond so many, the smallest ones, take turns in one queue.
MAX_QUEUES = 256
# That queue is put in order by stretches of about so many tokens, of so many at most.
STRETCH, MOST_STRETCHES = 1 << 22, 1 << 20
# Words and parts of words a process remembers; beyond them it starts anew.
CACHE_WORDS, CACHE_PARTS = 600_000, 200_000
# Texts of about so many bytes are looked up together.
CHUNK_BYTES = 1 << 22


# Words of these characters are folded and split here, as the tokenizer would:
# they have no other composed form, and their lower case has one character.
# All others go through the library as they are.
_PLAIN = re.compile(r"[!-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F]+")
_LETTERS = r"a-z\u00DF-\u00F6\u00F8-\u017F"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


class WordCache:
    """Ids of texts, one lookup per word.

    The tokenizer drops white space and never merges across it, so the words
    between ASCII white space are encoded once each and their ids put together.
    A new word is split into what the merges work on, and the library's model
    is asked once for each such part.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        printable = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # The characters that stand for a character's bytes in the vocabulary.
        self.visible = {
            c: printable.pre_tokenize_str(chr(c))[0][0] for c in (*range(0xC0, 0x180), *range(0x21, 0x7F))
        }
        self.clear()

    def clear(self) -> None:
        self.index = WordNumbers()
        self.parts: dict[str, tuple[int, ...]] = {}
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def part(self, part: str) -> tuple[int, ...]:
        ids = self.parts.get(part)
        if ids is None:
            seen = part if part.isascii() else part.translate(self.visible)
            ids = self.parts[part] = tuple([t.id for t in self.model.tokenize(seen)])
        return ids

    def word(self, word: str) -> list[int]:
        if not _PLAIN.fullmatch(word) or "<|" in word:
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        return [i for part in _SPLIT.findall(word.lower()) for i in self.part(part)]

    def learn(self) -> None:
        ids, known = [], self.parts.get
        for w in self.index.new:
            # ASCII letters alone are one part; so are they before one other character.
            if w.isalpha():
                part = w.lower().decode()
                ids.append(known(part) or self.part(part))
            elif w[:-1].isalpha() and 32 < w[-1] < 127:
                part = w[:-1].lower().decode()
                ids.append((known(part) or self.part(part)) + self.part(chr(w[-1])))
            else:
                ids.append(self.word(w.decode()))
        self.index.new = []
        if len(self.parts) > CACHE_PARTS:
            self.parts.clear()
        lengths = np.array([len(x) for x in ids], np.int64)
        starts = len(self.ids) + np.cumsum(lengths) - lengths
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(ids), np.uint32)])
        self.starts, self.lengths = np.append(self.starts, starts), np.append(self.lengths, lengths)

    def encode(self, batch: list[bytes], end_id: int) -> list[np.ndarray]:
        """Ids of each text with ``end_id`` behind them."""
        if len(self.index) > CACHE_WORDS:
            self.clear()
        number = self.index.__getitem__
        found = [np.array(list(map(number, text.split())), np.int64) for text in batch]
        if self.index.new:
            self.learn()
        out = []
        for at in found:
            lengths = self.lengths[at]
            ends = np.cumsum(lengths)
            ids = np.empty(int(ends[-1]) + 1 if len(ends) else 1, "<u4")
            ids[-1] = end_id
            place = np.arange(len(ids) - 1) + np.repeat(self.starts[at] - (ends - lengths), lengths)
            ids[:-1] = self.ids[place]
            out.append(ids)
        return out


@functools.lru_cache(maxsize=1)
def word_cache(path: str) -> WordCache:
    """Kept for the tasks that follow in the same process."""
    return WordCache(path)


def tokenized(
    docs: DataFrame, tokenizer_file: str, end_id: int, id_column: str, text: str, source: str
) -> DataFrame:
    """``doc, source, part, at, n, ids``: ids of every text, and its place in
    the queue of its source among the documents of one task (``part``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, served, part = word_cache(tokenizer_file), {}, TaskContext.get().partitionId()
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = []
            for a, b in chunks(offsets, CHUNK_BYTES):
                ids += cache.encode([data[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)], end_id)
            at = []
            for name, own in zip(batch.column(2).to_pylist(), ids, strict=True):
                at.append(served.get(name, 0))
                served[name] = at[-1] + len(own)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([part] * len(at), pa.int32()),
                    pa.array(at, pa.int64()),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([x.tobytes() for x in ids], pa.binary()),
                ],
                names=["doc", "source", "part", "at", "n", "ids"],
            )

    rows = docs.select(
        docs[id_column].alias("doc"),
        docs[text].cast("string").alias("text"),
        docs[source].cast("string").alias("source"),
    )
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc {kind}, source string, part int, at bigint, n bigint, ids binary"
    )


@dataclass(frozen=True)
class Phase:
    """Windows ``first`` to the next phase; ``quanta[q] / base`` tokens each to queue ``q``."""

    first: int
    served: tuple[int, ...]
    quanta: tuple[int, ...]
    base: int


class Schedule:
    """Which tokens of each queue each window takes."""

    def __init__(self, totals: list[int], weights: list[int], capacity: int) -> None:
        self.totals, self.phases = totals, []
        # Whole tokens served are at most one over the quantum for each queue.
        room = capacity - len(totals)
        first, served = 0, [0] * len(totals)
        while left := [q for q, n in enumerate(totals) if served[q] < n]:
            base = sum(weights[q] for q in left)
            quanta = [weights[q] * room if q in left else 0 for q in range(len(totals))]
            phase = Phase(first, tuple(served), tuple(quanta), base)
            self.phases.append(phase)
            # Windows until the first queue runs dry.
            spans = min(-(-(totals[q] - served[q]) * base // quanta[q]) for q in left)
            first += spans
            served = [min(n, s + spans * x // base) for n, s, x in zip(totals, served, quanta, strict=True)]
        self.windows = first
        self.firsts = [p.first for p in self.phases]
        self.before = functools.lru_cache(maxsize=4096)(self._before)

    def _before(self, window: int) -> tuple[int, ...]:
        """Tokens of each queue served before a window."""
        if window >= self.windows:
            return tuple(self.totals)
        p = self.phases[bisect.bisect_right(self.firsts, window) - 1]
        return tuple(
            min(n, s + (window - p.first) * x // p.base)
            for n, s, x in zip(self.totals, p.served, p.quanta, strict=True)
        )

    def window_of(self, queue: int, token: int) -> int:
        """The window that serves a token of a queue."""
        p = self.phases[bisect.bisect_right([p.served[queue] for p in self.phases], token) - 1]
        window = p.first + (token - p.served[queue]) * p.base // max(1, p.quanta[queue])
        while window and self.before(window)[queue] > token:
            window -= 1
        while self.before(window + 1)[queue] <= token:
            window += 1
        return window

    def pieces(self, queue: int, first: int, n: int, size: int, per: int) -> Iterator[tuple]:
        """``start, length, sequence, offset`` of ``n`` tokens from ``first`` on."""
        start = 0
        window = self.window_of(queue, first)
        while start < n:
            low, high = self.before(window), self.before(window + 1)
            take = min(n - start, high[queue] - first - start)
            place = sum(high[:queue]) - sum(low[:queue]) + first + start - low[queue]
            while take > 0:
                length = min(take, size - place % size)
                yield start, length, window * per + place // size, place % size
                start, place, take = start + length, place + length, take - length
            window += 1


def turns(stored: DataFrame, parts: DataFrame, shares: dict[str | None, int], total: int, stretch: int = STRETCH) -> DataFrame:
    """``doc, ids, first`` of the sources of ``parts``, whose documents take turns in one queue.

    A document is due when its source has been served up to a place in it, by
    the source's share: its own tokens, or what ``shares`` gives. So a source is
    ahead of its share or behind it by one document at most. The place differs
    between documents by their hash, so sources of one document spread out too.
    Due times cut the queue into stretches, whose sums tell where each begins.
    """
    spark = stored.sparkSession
    own = Window.partitionBy("source").orderBy("part")
    given = spark.createDataFrame([(k, float(v)) for k, v in shares.items()], "named string, given double")
    sizes = parts.groupBy("source").agg(F.sum("n").alias("size"))
    sizes = sizes.join(F.broadcast(given), sizes.source.eqNullSafe(given.named), "left").select(
        F.col("source").alias("z"), "size", F.coalesce("given", F.col("size").cast("double")).alias("share")
    )
    before = F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = parts.select("source", F.col("part").alias("p"), before.alias("base"))
    bases = bases.join(sizes, bases.source.eqNullSafe(sizes.z)).select(F.col("source").alias("s"), "p", "base", "size", "share")
    bases = written(bases, "turns")
    end = bases.agg(F.max(F.col("size") / F.col("share"))).first()[0]
    stretches = max(1, min(MOST_STRETCHES, total // stretch))
    place = F.pmod(F.xxhash64("source", "part", "at"), F.lit(1 << 20)) / float(1 << 20)
    due = (F.col("base") + F.col("at") + place * F.col("n")) / F.col("share")
    rows = stored.join(bases, (stored.part == bases.p) & stored.source.eqNullSafe(bases.s)).withColumn("due", due)
    rows = rows.withColumn("stretch", F.least(F.lit(stretches - 1), F.floor(F.col("due") / end * stretches).cast("int")))
    sums = rows.groupBy("stretch").agg(F.sum("n").alias("sum"))
    ahead = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("stretch").alias("of"), F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("start"))
    order = Window.partitionBy("stretch").orderBy("due", F.asc_nulls_first("source"), "part", "at")
    inner = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    queued = rows.withColumn("inner", inner).join(F.broadcast(starts), F.col("stretch") == F.col("of"))
    return queued.select("doc", "ids", (F.col("start") + F.col("inner")).alias("first"))


def pack(
    docs: DataFrame,
    tokenizer_file: str,
    end_id: int = 2,
    weights: dict[str | None, float] | None = None,
    size: int = SEQUENCE,
    window: int = WINDOW,
    max_queues: int = MAX_QUEUES,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Pack every token of every document into sequences of ``size`` tokens.

    ``weights`` are the target shares by source; without them a source's share
    is that of its tokens, so that all queues run dry together. A source
    without a weight has its own share of tokens as weight. The sources that
    share the last queue bring it the sum of their weights; inside that queue
    they take turns by document, each in step with its own share (``turns``).

    Returns one row per piece: ``doc, start, length, ids, doc_tokens,
    sequence_id, offset``. Every window holds ``window * size`` tokens but for
    up to two for each queue, and for the last window of a phase. A null text
    is empty and has the end id only; a null source is a source; repeated rows
    are packed each for itself; other columns are not read; an empty table
    gives no rows. The ids are written once to the shared folder, so a lost
    executor costs no new tokenizing.
    """
    spark = docs.sparkSession
    stored = written(
        tokenized(docs, tokenizer_file, end_id, id_column, text, source), "tokens", "zstd"
    )
    sums = stored.groupBy("source", "part").agg(F.sum("n").alias("n"))
    sources = sums.groupBy("source").agg(F.sum("n").alias("n"))
    # Bounded by max_queues; everything else waits in the last queue.
    top = sources.orderBy(F.desc("n"), F.asc_nulls_first("source")).limit(max_queues - 1).collect()
    total = sources.agg(F.sum("n")).first()[0] or 0
    totals = [r["n"] for r in top]
    names = [r["source"] for r in top]
    if rest := total - sum(totals):
        totals.append(rest)
    shares, tail = list(totals), {}
    if weights is not None:
        scale = total / max(1e-300, sum(weights.values()))
        for q, name in enumerate(names):
            if name in weights:
                shares[q] = max(1, round(weights[name] * scale))
        if rest and (small := set(weights) - set(names)):
            wanted = F.col("source").isin([n for n in small if n is not None])
            if None in small:
                wanted = F.coalesce(wanted, F.lit(True))
            given = sources.filter(wanted).collect()
            tail = {r["source"]: max(1, round(weights[r["source"]] * scale)) for r in given}
            shares[-1] = max(1, rest + sum(tail[r["source"]] - r["n"] for r in given))
    schedule = Schedule(totals, shares, window * size)

    named = spark.createDataFrame(
        [(name, q) for q, name in enumerate(names)], "source string, queue int"
    )
    parts = sums.join(F.broadcast(named), sums.source.eqNullSafe(named.source), "left").select(
        sums.source, "part", "n", F.coalesce("queue", F.lit(len(names))).alias("queue")
    )
    # Tokens of the queue in earlier parts, then of earlier sources in the part.
    by_part = parts.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = (
        Window.partitionBy("queue", "part")
        .orderBy(F.asc_nulls_first("source"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    bases = by_part.select("queue", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inner = parts.select(
        "queue", "part", "source", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("inner")
    )
    places = inner.join(bases, ["queue", "part"]).select(
        F.col("part").alias("p"), F.col("source").alias("s"), "queue", (F.col("base") + F.col("inner")).alias("base")
    )
    # Written, so that its size is known and the ids stay in place where it is small.
    places = written(places, "places")
    placed = stored.join(places, (stored.part == places.p) & stored.source.eqNullSafe(places.s)).select(
        "doc", "ids", "queue", (F.col("base") + F.col("at")).alias("first")
    )
    if rest:
        placed = placed.filter(F.col("queue") < len(names)).unionByName(
            turns(stored, parts.filter(F.col("queue") == len(names)), tail, rest).withColumn("queue", F.lit(len(names)))
        )
    kind = stored.schema["doc"].dataType.simpleString()
    named_kind = pa.schema(
        [("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
         ("sequence_id", pa.int64()), ("offset", pa.int64())]
    )
    plan = (totals, shares, window * size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Schedule(*plan)
        for batch in batches:
            rows, out = [], []
            columns = (batch.column(i).to_pylist() for i in (1, 2, 3))
            for row, (ids, queue, first) in enumerate(zip(*columns, strict=True)):
                for start, length, sequence, offset in own.pieces(queue, first, len(ids) // 4, size, window):
                    rows.append(row)
                    out.append((start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, sequence, offset))
            made = [pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), named_kind, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), *made], names=["doc", *named_kind.names]
                )

    if not schedule.windows:
        return spark.createDataFrame(
            [], f"{'doc'} {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
        ).withColumnRenamed("doc", id_column)
    return placed.mapInArrow(
        run,
        f"doc {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint",
    ).withColumnRenamed("doc", id_column)


def with_checksums(pieces: DataFrame, ids: str = "ids") -> DataFrame:
    """Replace the ids by ``ids_crc32``, the CRC-32 of their bytes (a built-in)."""
    return pieces.withColumn("ids_crc32", F.crc32(ids)).drop(ids)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
