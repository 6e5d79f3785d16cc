"""Token ids in Arrow stream files of fixed-size lists.

A file holds one stream of record batches, with two columns of fixed-size
lists: the ids of a sequence, in two bytes each where the vocabulary fits them,
and a mask, in bits, that is set where there is an id and not where the last
sequence of the file is filled up. Every batch but the last has
the same number of sequences, so all of them take the same number of bytes and
the place of any sequence follows from its number. A mapped file is read
without a copy. A second stream lists the documents of the file: their ids,
first tokens and lengths.

Texts are dealt by ranges of their ids; each task encodes its range, writes it
as files of whole documents and reports them. Only the files that committed tasks have
reported make up the result, so a task that is run again leaves files that
nobody reads.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.batches import chunks, utf8
from sheaf.llm.packing import word_cache
from sheaf.session import new_path, written

SEQUENCE = 2048
# Sequences of a batch, and of a file before it is closed behind a document.
BATCH, FILE = 256, 8192
# Bytes of text of a task, in as many tasks at most; texts of about so many are encoded together.
TASK_BYTES, MOST_TASKS = 1 << 24, 20_000
ENCODED_BYTES = 1 << 21
# Reports of so many tasks are written together.
REPORTS = 1024
FILL = 0


def storage(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path that all executors share, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def layout(size: int, wide: bool) -> pa.Schema:
    number = pa.uint32() if wide else pa.uint16()
    return pa.schema([("ids", pa.list_(number, size)), ("mask", pa.list_(pa.bool_(), size))])


def is_wide(tokenizer_file: str, end_id: int) -> bool:
    """Whether the ids of a tokenizer need four bytes."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer_file).get_vocab(with_added_tokens=True)
    return max(end_id, *vocabulary.values()) > np.iinfo(np.uint16).max


class Writer:
    """One pair of streams: the sequences and the documents in them."""

    def __init__(self, stem: str, size: int, batch: int, wide: bool, doc: pa.DataType) -> None:
        where, path = storage(stem)
        where.create_dir(posixpath.dirname(path), recursive=True)
        self.size, self.batch, self.schema = size, batch, layout(size, wide)
        self.tokens = self.documents = self.sequences = 0
        self.held: list[np.ndarray] = []
        self.waiting = 0
        self.index = pa.schema([("doc", doc), ("start", pa.int64()), ("length", pa.int64())])
        self.sinks = [where.open_output_stream(path + end) for end in (".arrow", ".documents.arrow")]
        self.streams = [pa.ipc.new_stream(s, k) for s, k in zip(self.sinks, (self.schema, self.index), strict=True)]

    def add(self, docs: pa.Array, ids: list[np.ndarray]) -> None:
        lengths = np.array([len(x) for x in ids], np.int64)
        starts = self.tokens + np.cumsum(lengths) - lengths
        self.streams[1].write_batch(pa.RecordBatch.from_arrays([docs, pa.array(starts), pa.array(lengths)], schema=self.index))
        self.documents += len(ids)
        self.tokens += int(lengths.sum())
        self.held += ids
        self.waiting += int(lengths.sum())
        if self.waiting >= self.size * self.batch:
            self.flush(self.waiting // (self.size * self.batch) * self.batch)

    def flush(self, sequences: int) -> None:
        """Write so many sequences, the last one filled up where ids are wanting."""
        flat = np.concatenate(self.held)
        whole = sequences * self.size
        ids, mask = np.full(whole, FILL, self.schema.field("ids").type.value_type.to_pandas_dtype()), np.zeros(whole, bool)
        n = min(whole, len(flat))
        ids[:n], mask[:n] = flat[:n], True
        for first in range(0, sequences, self.batch):
            cut = slice(first * self.size, min(sequences, first + self.batch) * self.size)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(a[cut]), self.size) for a in (ids, mask)]
            self.streams[0].write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.sequences += sequences
        self.held, self.waiting = [flat[n:]], len(flat) - n

    def close(self) -> None:
        if self.waiting:
            self.flush(-(-self.waiting // self.size))
        for stream, sink in zip(self.streams, self.sinks, strict=True):
            stream.close()
            sink.close()


class Sequences:
    """Random access to the sequences of one file; views of the file where it can be mapped."""

    def __init__(self, path: str) -> None:
        where, at = storage(path)
        self.source = pa.memory_map(at) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(at)
        self.schema = pa.ipc.read_schema(pa.ipc.read_message(self.source))
        self.size = self.schema.field("ids").type.list_size
        self.first = self.source.tell()
        self.rows, self.step = self._measure()
        self.held: tuple[int, pa.RecordBatch] | None = None

    def _measure(self) -> tuple[int, int]:
        try:
            batch = pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)
        except EOFError:
            return 1, 1
        return batch.num_rows, self.source.tell() - self.first

    def batch(self, number: int) -> pa.RecordBatch:
        if self.held is None or self.held[0] != number:
            self.source.seek(self.first + number * self.step)
            self.held = number, pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)
        return self.held[1]

    def ids(self, number: int) -> np.ndarray:
        """All ids of a batch, as a view."""
        return self.batch(number).column("ids").flatten().to_numpy(zero_copy_only=True)

    def __getitem__(self, sequence: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of one sequence, as views."""
        number, row = divmod(sequence, self.rows)
        # Behind the last batch the stream has an end mark of 8 bytes.
        if sequence < 0 or self.first + number * self.step > self.source.size() - 16:
            raise IndexError(sequence)
        batch = self.batch(number)
        if row >= batch.num_rows:
            raise IndexError(sequence)
        return self.ids(number)[row * self.size : (row + 1) * self.size], batch.column("mask")[row].values

    def run(self, start: int, length: int) -> Iterator[np.ndarray]:
        """The ids of tokens ``start`` to ``start + length``, batch by batch."""
        per = self.rows * self.size
        while length:
            number, place = divmod(start, per)
            part = self.ids(number)[place : place + length]
            if not len(part):
                raise IndexError(start)
            yield part
            start, length = start + len(part), length - len(part)


def documents_of(path: str) -> Iterator[pa.RecordBatch]:
    """``doc, start, length`` of the documents of a file."""
    where, at = storage(path.removesuffix(".arrow") + ".documents.arrow")
    with where.open_input_file(at) as source, pa.ipc.open_stream(source) as stream:
        yield from stream


@dataclass(frozen=True)
class TokenFiles:
    """The files of one table: ``part, file, path, sequences, tokens, documents, first`` each.

    ``first`` counts the tokens of all files before, ``part`` and ``file`` give
    their order. ``doc_kind`` is the type of the document ids.
    """

    files: DataFrame
    doc_kind: str

    def dealt(self) -> DataFrame:
        """One file a task, as far as there are tasks."""
        n = self.files.count()
        return self.files.select("part", "file", "path", "first").repartitionByRange(max(1, min(n, MOST_TASKS)), "part", "file")

    def documents(self, ids: bool = False) -> DataFrame:
        """Every document, read from the files: ``doc, start, n_tokens, ids_crc32`` and, if wanted, ``ids``.

        ``start`` counts the tokens of all documents before it.
        """

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path, first in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    sequences = Sequences(path)
                    for docs in documents_of(path):
                        found, raw = [], []
                        for start, length in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist(), strict=True):
                            parts, crc = [], 0
                            for part in sequences.run(start, length):
                                part = part.astype("<u4", copy=False)
                                crc = zlib.crc32(part, crc)
                                if ids:
                                    parts.append(part.tobytes())
                            found.append(crc)
                            raw.append(b"".join(parts))
                        starts = pa.array(docs.column(1).to_numpy() + first)
                        columns = [docs.column(0), starts, docs.column(2), pa.array(found, pa.int64())]
                        names = ["doc", "start", "n_tokens", "ids_crc32"]
                        if ids:
                            columns.append(pa.array(raw, pa.binary()))
                            names.append("ids")
                        yield pa.RecordBatch.from_arrays(columns, names=names)

        kind = f"doc {self.doc_kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if ids else "")
        return self.dealt().mapInArrow(read, kind)

    def sequences(self) -> DataFrame:
        """Every sequence in order: ``part, file, sequence, ids, mask``."""

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, file, path in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    where, at = storage(path)
                    done = 0
                    with where.open_input_file(at) as source, pa.ipc.open_stream(source) as stream:
                        for made in stream:
                            n = made.num_rows
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([part] * n, pa.int32()), pa.array([file] * n, pa.int32()), pa.array(range(done, done + n), pa.int64()),
                                 made.column(0).cast(pa.list_(pa.int64())), made.column(1).cast(pa.list_(pa.bool_()))],
                                names=["part", "file", "sequence", "ids", "mask"],
                            )
                            done += n

        return self.dealt().mapInArrow(
            read, "part int, file int, sequence bigint, ids array<bigint>, mask array<boolean>"
        )


def write(
    docs: DataFrame,
    tokenizer_file: str,
    end_id: int = 2,
    size: int = SEQUENCE,
    batch: int = BATCH,
    file: int = FILE,
    task_bytes: int = TASK_BYTES,
    id_column: str = "doc_id",
    text: str = "text",
) -> TokenFiles:
    """Encode every text, append ``end_id`` and write all ids in the order of the document ids.

    Null ids come first; rows of one id are documents of their own, in the
    order of their place in the input. A null or empty text has the end id
    only. A document of any length lies in one file. Other columns are not
    read. An empty table gives no file.
    """
    spark, wide = docs.sparkSession, is_wide(tokenizer_file, end_id)
    chosen = docs.select(docs[f"`{id_column}`"].alias("doc"), docs[f"`{text}`"].cast("string").alias("text"))
    total = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(1, min(MOST_TASKS, -(-total // task_bytes)))
    order = [F.asc_nulls_first("doc"), F.asc("place")]
    placed = chosen.withColumn("place", F.monotonically_increasing_id())
    dealt = placed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("doc", "text")
    folder = new_path(spark, "sequences")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, own = TaskContext.get().partitionId(), 0, None

        def report() -> pa.RecordBatch:
            own.close()
            return pa.RecordBatch.from_pylist(
                [{"part": part, "file": number, "path": stem + ".arrow", "sequences": own.sequences,
                  "tokens": own.tokens, "documents": own.documents}],
                schema=pa.schema([("part", pa.int32()), ("file", pa.int32()), ("path", pa.string()),
                                  ("sequences", pa.int64()), ("tokens", pa.int64()), ("documents", pa.int64())]),
            )

        cache = word_cache(tokenizer_file)
        for rows in batches:
            data, offsets = utf8(rows.column(1))
            for a, b in chunks(offsets, ENCODED_BYTES):
                texts = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)]
                ids = [x.astype(np.uint32 if wide else np.uint16) for x in cache.encode(texts, end_id)]
                docs_of, ends, first = rows.column(0).slice(a, b - a), np.cumsum([len(x) for x in ids]), 0
                while first < len(ids):
                    if own is None:
                        stem = f"{folder}/part-{part:06d}-{number:05d}-{uuid.uuid4().hex}"
                        own = Writer(stem, size, batch, wide, rows.column(0).type)
                    # Documents up to the one that fills the file.
                    before = int(ends[first - 1]) if first else 0
                    last = min(len(ids), int(np.searchsorted(ends, before + file * size - own.tokens)) + 1)
                    own.add(docs_of.slice(first, last - first), ids[first:last])
                    first = last
                    if own.tokens >= file * size:
                        yield report()
                        own, number = None, number + 1
        if own is not None:
            yield report()

    kind = "part int, file int, path string, sequences bigint, tokens bigint, documents bigint"
    # A row for each file, put together to as few tables as they fill.
    files = written(dealt.mapInArrow(store, kind).repartition(-(-tasks // REPORTS)), "files")
    # Sums by part are at most MOST_TASKS rows; files are counted on within their part.
    ahead = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy(F.col("part").alias("of")).agg(F.sum("tokens").alias("sum"))
    bases = parts.select("of", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("base"))
    inner = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    numbered = files.withColumn("inner", F.coalesce(F.sum("tokens").over(inner), F.lit(0)))
    numbered = numbered.join(F.broadcast(bases), F.col("part") == F.col("of"))
    numbered = numbered.select(*files.columns, (F.col("base") + F.col("inner")).alias("first"))
    return TokenFiles(numbered, chosen.schema["doc"].dataType.simpleString())
