"""Exact substring removal by fixed-block anchors.

A run of ``window`` words holds at least one aligned block of ``(window + 1) // 2``
words. So the index takes the non-overlapping blocks of every text, every
rolling window of a block's size probes it, and a block that is found anywhere
else is an anchor. The anchors are extended to maximal repeats: each run of
``window`` words around an anchor is compared with all others of its kind, and
the runs that occur twice cover exactly the maximal exact repeats.

Hashes travel sorted and packed, one row for each task and range of hashes. A
task names a hash twice at most however often it holds it, so neither a hot
passage nor a third of all rows being copies gathers in one place, and no pair
is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.batches import U64, chunks, pack_planes, unpack_planes, utf8, window_hashes, word_hashes, words
from sheaf.session import written

WINDOW = 35
# Words of texts whose hashes a task holds at a time.
FLUSH_WORDS = 4_000_000
KEY = 16
PROBE_BYTES = 6


def block_size(window: int) -> int:
    return (window + 1) // 2


class TextWords:
    """Words of some rows of a batch, with hashes and places in their texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data = data
        self.starts, self.ends, self.bounds = words(data, offsets)
        self.count = np.diff(self.bounds)
        self.row = np.repeat(np.arange(len(self.count)), self.count)
        self.place = np.arange(len(self.starts)) - np.repeat(self.bounds[:-1], self.count)

    def hashes(self, seed: int) -> np.ndarray:
        return word_hashes(self.data, self.starts, self.ends, seed)

    def inside(self, size: int) -> np.ndarray:
        """Places at which a run of ``size`` words of one text begins."""
        n = max(0, len(self.row) - size + 1)
        return self.row[:n] == self.row[size - 1 :] if n else np.zeros(0, bool)


def each_chunk(column: pa.Array) -> Iterator[tuple[int, int, TextWords]]:
    data, offsets = utf8(column)
    for first, last in chunks(offsets):
        yield first, last, TextWords(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])


def key_array(column: pa.Array) -> np.ndarray:
    """Fixed-size keys as an array of byte rows."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, KEY)


def _cuts(buckets: int, hashes: np.ndarray) -> np.ndarray:
    """Bounds of each bucket's range in sorted 64-bit hashes."""
    edges = np.array([(b << 64) // buckets for b in range(buckets)], U64)
    return np.append(np.searchsorted(hashes, edges), len(hashes))


def _anchor_rows(probes: list, blocks: list, buckets: int) -> pa.RecordBatch | None:
    """One row per range of hashes: probes (each twice at most) and index entries."""
    if not probes:
        return None
    found = np.sort(np.concatenate(probes))
    more = np.ones(len(found), bool)
    more[2:] = found[2:] != found[:-2]
    found = found[more]
    hashes, keys, numbers = (np.concatenate(x) for x in zip(*blocks, strict=True))
    order = np.argsort(hashes, kind="stable")
    hashes, keys, numbers = hashes[order], keys[order], numbers[order]
    at, own = _cuts(buckets, found << U64(16)), _cuts(buckets, hashes << U64(16))
    rows = [b for b in range(buckets) if at[b] < at[b + 1]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(rows, pa.int32()),
            pa.array([pack_planes(found[at[b] : at[b + 1]], PROBE_BYTES) for b in rows], pa.binary()),
            pa.array([pack_planes(hashes[own[b] : own[b + 1]], PROBE_BYTES) for b in rows], pa.binary()),
            pa.array([keys[own[b] : own[b + 1]].tobytes() for b in rows], pa.binary()),
            pa.array([numbers[own[b] : own[b + 1]].tobytes() for b in rows], pa.binary()),
        ],
        names=["bucket", "probes", "hashes", "keys", "numbers"],
    )


def anchors(texts: DataFrame, window: int, buckets: int) -> DataFrame:
    """``key, blocks``: the blocks of each text that occur elsewhere, too.

    Hashes of 48 bits: a false anchor costs a comparison, never a result.
    """
    size = block_size(window)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes, blocks, held = [], [], 0
        for batch in batches:
            keys = key_array(batch.column(0))
            for first, last, text in each_chunk(batch.column(1)):
                rolling = window_hashes(text.hashes(1), size, 1) >> U64(16)
                use = text.inside(size) & (text.count[text.row[: len(rolling)]] >= window)
                block = np.flatnonzero(use & (text.place[: len(rolling)] % size == 0))
                probes.append(rolling[use])
                blocks.append(
                    (rolling[block], keys[first:last][text.row[block]], (text.place[block] // size).astype("<i4"))
                )
                held += len(rolling)
                if held >= FLUSH_WORDS:
                    if (out := _anchor_rows(probes, blocks, buckets)) is not None:
                        yield out
                    probes, blocks, held = [], [], 0
        if (out := _anchor_rows(probes, blocks, buckets)) is not None:
            yield out

    def probe(table: pa.Table) -> pa.Table:
        every = np.sort(np.concatenate([unpack_planes(p, PROBE_BYTES) for p in table["probes"].to_pylist()]))
        repeated = np.unique(every[1:][every[1:] == every[:-1]])
        hashes = np.concatenate([unpack_planes(p, PROBE_BYTES) for p in table["hashes"].to_pylist()])
        keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint8).reshape(-1, KEY)
        numbers = np.frombuffer(b"".join(table["numbers"].to_pylist()), "<i4")
        at = np.minimum(np.searchsorted(repeated, hashes), max(0, len(repeated) - 1))
        hit = repeated[at] == hashes if len(repeated) else np.zeros(len(hashes), bool)
        # Copies of a text name the same blocks.
        named = np.concatenate([keys[hit], numbers[hit].view(np.uint8).reshape(-1, 4)], axis=1)
        named = np.unique(np.ascontiguousarray(named).view(f"V{KEY + 4}").ravel())
        named = named.view(np.uint8).reshape(-1, KEY + 4)
        return pa.table(
            {
                "key": pa.array([x.tobytes() for x in named[:, :KEY]], pa.binary()),
                "block": np.ascontiguousarray(named[:, KEY:]).view("<i4").ravel(),
            }
        )

    packed = texts.select("key", "text").mapInArrow(
        index, "bucket int, probes binary, hashes binary, keys binary, numbers binary"
    )
    hits = packed.groupBy("bucket").applyInArrow(probe, "key binary, block int")
    return hits.groupBy("key").agg(F.collect_list("block").alias("blocks"))


def _around(text: TextWords, blocks: list, window: int) -> np.ndarray:
    """Places whose run of ``window`` words holds an anchor."""
    size = block_size(window)
    n = max(0, len(text.row) - window + 1)
    edge = np.zeros(len(text.row) + 1, np.int64)
    if (rows := [np.full(len(b), r) for r, b in enumerate(blocks) if b]) and n:
        row = np.concatenate(rows)
        start = np.concatenate([b for b in blocks if b]) * size
        low = text.bounds[row] + np.maximum(0, start - (window - size))
        high = text.bounds[row] + np.minimum(start, text.count[row] - window) + 1
        use = low < high
        np.add.at(edge, low[use], 1)
        np.add.at(edge, high[use], -1)
    return (np.cumsum(edge)[:n] > 0) & text.inside(window)


def _run_rows(held: list, buckets: int) -> pa.RecordBatch | None:
    """Runs that a task holds once with their places, and those it holds more often."""
    if not held:
        return None
    hashes, checks, keys, places = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((checks, hashes))
    hashes, checks = hashes[order], checks[order]
    new = np.ones(len(hashes) + 1, bool)
    new[1:-1] = (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])
    one, many = np.flatnonzero(new[:-1] & new[1:]), np.flatnonzero(new[:-1] & ~new[1:])
    at, more = _cuts(buckets, hashes[one]), _cuts(buckets, hashes[many])
    rows = [b for b in range(buckets) if at[b] < at[b + 1] or more[b] < more[b + 1]]

    def column(values: np.ndarray, which: np.ndarray, cuts: np.ndarray) -> pa.Array:
        return pa.array([values[which[cuts[b] : cuts[b + 1]]].tobytes() for b in rows], pa.binary())

    def packed(which: np.ndarray, cuts: np.ndarray) -> pa.Array:
        return pa.array([pack_planes(hashes[which[cuts[b] : cuts[b + 1]]], 8) for b in rows], pa.binary())

    return pa.RecordBatch.from_arrays(
        [
            pa.array(rows, pa.int32()),
            packed(one, at),
            column(checks, one, at),
            column(keys, order[one], at),
            column(places, order[one], at),
            packed(many, more),
            column(checks, many, more),
        ],
        names=["bucket", "hashes", "checks", "keys", "places", "many", "many_checks"],
    )


def lone_runs(anchored: DataFrame, window: int, buckets: int) -> DataFrame:
    """``key, lone``: runs of ``window`` words around anchors that occur nowhere else.

    Runs are told apart by 80 bits. Those that do repeat need not be sent back.
    """

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            keys, blocks = key_array(batch.column(0)), batch.column(2).to_pylist()
            for first, last, text in each_chunk(batch.column(1)):
                at = np.flatnonzero(_around(text, blocks[first:last], window))
                if not len(at):
                    continue
                check = (window_hashes(text.hashes(2), window, 2)[at] >> U64(48)).astype("<u2")
                held.append(
                    (window_hashes(text.hashes(1), window, 1)[at], check, keys[first:last][text.row[at]],
                     text.place[at].astype("<i4"))
                )
                n += len(at)
                if n >= FLUSH_WORDS // 2:
                    yield _run_rows(held, buckets)
                    held, n = [], 0
        if (out := _run_rows(held, buckets)) is not None:
            yield out

    def compare(table: pa.Table) -> pa.Table:
        def joined(name: str, kind: str) -> np.ndarray:
            return np.frombuffer(b"".join(table[name].to_pylist()), kind)

        def hashes(name: str) -> np.ndarray:
            return np.concatenate([unpack_planes(p, 8) for p in table[name].to_pylist()])

        one, many = hashes("hashes"), hashes("many")
        every = np.concatenate([one, many])
        checks = np.concatenate([joined("checks", "<u2"), joined("many_checks", "<u2")])
        order = np.lexsort((checks, every))
        every, checks = every[order], checks[order]
        new = np.ones(len(every) + 1, bool)
        new[1:-1] = (every[1:] != every[:-1]) | (checks[1:] != checks[:-1])
        lone = order[new[:-1] & new[1:]]
        lone = lone[lone < len(one)]
        keys = joined("keys", np.uint8).reshape(-1, KEY)[lone]
        return pa.table(
            {"key": pa.array([k.tobytes() for k in keys], pa.binary()), "place": joined("places", "<i4")[lone]}
        )

    packed = anchored.select("key", "text", "blocks").mapInArrow(
        collect,
        "bucket int, hashes binary, checks binary, keys binary, places binary, many binary, many_checks binary",
    )
    runs = packed.groupBy("bucket").applyInArrow(compare, "key binary, place int")
    return runs.groupBy("key").agg(F.collect_list("place").alias("lone"))


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, text: str = "text", buckets: int | None = None
) -> DataFrame:
    """Remove each word covered by a run of ``window`` words that also starts elsewhere.

    Words are ``[^\\x20\\x09-\\x0D]+``. Runs are judged on the input, within
    one text and between texts alike, and copies of a text are each other's
    repeats. Returns ``row`` (a struct of all other columns), ``n_words,
    n_removed, kept`` (the words left, joined by one space) and ``spans`` (the
    removed ranges of words, as structs of start and end; the end is not in).

    A null text has no words. Texts of fewer words than ``window`` stay whole.
    Null ids, repeated rows and clashing names do not matter, as rows are
    known by their texts and all other columns stay inside ``row``.
    """
    spark = docs.sparkSession
    if buckets is None:
        buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    others = [docs[c] for c in docs.columns if c != text]
    # A struct must have a field.
    row = F.struct(*others) if others else F.struct(F.lit(None).cast("string").alias("none"))
    value = F.coalesce(docs[text].cast("string"), F.lit(""))
    keyed = docs.select(row.alias("row"), value.alias("text")).withColumn("key", F.unhex(F.md5("text")))
    hits = written(anchors(keyed, window, buckets), "anchors")
    # Copies meet here; what is kept of a text is worked out once.
    distinct = keyed.groupBy("key").agg(
        F.first("text").alias("text"), F.first("row").alias("row"), F.count(F.lit(1)).alias("copies")
    )
    lone = lone_runs(distinct.join(hits, "key"), window, buckets)
    single = (
        distinct.filter("copies = 1").join(hits, "key", "left").join(lone, "key", "left")
        .select("row", "text", "blocks", "lone")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, lone = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            counts, removed, kept, spans = [], [], [], []
            for first, last, words_of in each_chunk(batch.column(1)):
                gone = _covered(words_of, blocks[first:last], lone[first:last], window)
                for r in range(last - first):
                    a, b = words_of.bounds[r], words_of.bounds[r + 1]
                    own, text_words = gone[a:b], _words_of(words_of, a, b)
                    if own.any():
                        text_words = [w for w, g in zip(text_words, own.tolist(), strict=True) if not g]
                    edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).tolist()
                    counts.append(int(b - a))
                    removed.append(int(own.sum()))
                    kept.append(b" ".join(text_words).decode())
                    spans.append([{"start": s, "end": e} for s, e in zip(edges[::2], edges[1::2], strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.string()), pa.array(spans, _SPANS)],
                names=["row", "n_words", "n_removed", "kept", "spans"],
            )

    kind = keyed.schema["row"].dataType.simpleString()
    out = f"row {kind}, n_words bigint, n_removed bigint, kept string, spans array<struct<start:bigint,end:bigint>>"
    cut_texts = single.mapInArrow(cut, out)

    # Of copies nothing stays, unless they are shorter than a window.
    short = F.split(F.trim(F.regexp_replace("text", _SPACES, " ")), " ")
    sized = keyed.select("key", "row", F.regexp_count("text", F.lit(_WORD)).cast("bigint").alias("n_words"), "text")
    sized = sized.select(
        "key", "row", "n_words",
        F.when(F.col("n_words") < window, F.array_join(short, " ")).otherwise("").alias("kept"),
    )
    copied = distinct.filter("copies > 1").select("key")
    long = F.col("n_words") >= window
    copies = sized.join(copied, "key").select(
        "row",
        "n_words",
        F.when(long, F.col("n_words")).otherwise(F.lit(0).cast("bigint")).alias("n_removed"),
        "kept",
        F.when(long, F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_words").alias("end"))))
        .otherwise(F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"))
        .alias("spans"),
    )
    return cut_texts.unionByName(copies)


_WORD, _SPACES = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _words_of(text: TextWords, first: int, last: int) -> list[bytes]:
    if first == last:
        return []
    return text.data[text.starts[first] : text.ends[last - 1]].tobytes().split()


def _covered(text: TextWords, blocks: list, lone: list, window: int) -> np.ndarray:
    """Words inside a run that repeats."""
    repeats = _around(text, [b or [] for b in blocks], window)
    for r, places in enumerate(lone):
        if places:
            repeats[text.bounds[r] + np.array(places)] = False
    edge = np.zeros(len(text.row) + 1, np.int64)
    at = np.flatnonzero(repeats)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return np.cumsum(edge)[:-1] > 0
