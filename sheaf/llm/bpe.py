"""Byte-level BPE: encode texts by a rank file and decode ids to their bytes.

The library does the merges. Its regular expression backtracks, so a very long
text is cut first where no match can cross: between a character that is not
white space and the white space behind it. A match is either one white space
with a run of other characters, or white space alone, and nothing looks back,
so both sides split as they would together.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sheaf.llm.batches import texts

PIECE_CHARS = 1 << 16
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \n])")
# The library's stack overflows on a run of some million white spaces. All but
# its last character are one match, which needs no regular expression.
_LONG_SPACE = re.compile(r"[^\S\x1c-\x1f]{100000,}")


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The library's encoding of a local rank file, one for each process."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces of ``size`` characters, up to the next safe cut.

    A run without white space, or of white space alone, stays in one piece.
    """
    first = 0
    while len(text) - first > size:
        cut = _CUT.search(text, first + size)
        if cut is None:
            break
        yield text[first : cut.start()]
        first = cut.start()
    yield text[first:]


def _encode_piece(own, text: str) -> list[int]:
    ids, first = [], 0
    for run in _LONG_SPACE.finditer(text):
        last = run.end() - (run.end() < len(text))
        ids += own.encode_ordinary(text[first : run.start()])
        ids += own._encode_single_piece(text[run.start() : last].encode())
        first = last
    return ids + own.encode_ordinary(text[first:])


def encode_text(text: str, rank_file: str, pattern: str, size: int = PIECE_CHARS) -> np.ndarray:
    own = encoding(rank_file, pattern)
    if len(text) <= size:
        return np.array(own.encode_ordinary(text), dtype="<u4")
    return np.concatenate(
        [np.array(_encode_piece(own, p), dtype="<u4") for p in safe_pieces(text, size)]
    )


def decode_ids(ids: np.ndarray, rank_file: str, pattern: str) -> bytes:
    """The raw bytes of the ids; they need not be valid UTF-8."""
    return encoding(rank_file, pattern).decode_bytes(ids.tolist())


def encode(
    docs: DataFrame, rank_file: str, pattern: str, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Ids of every whole text: ``<id_column>, ids`` (little-endian unsigned 32-bit).

    Row-local: nothing is shuffled. A null text counts as empty and has no
    ids; repeated rows and null row ids come through as they are; other
    columns are not read. The rank file is a path that every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encode_text(t, rank_file, pattern).tobytes() for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary())], names=["row", "ids"]
            )

    source = docs.select(docs[id_column].alias("row"), docs[text].cast("string").alias("text"))
    kind = source.schema["row"].dataType.simpleString()
    return source.mapInArrow(run, f"row {kind}, ids binary").withColumnRenamed("row", id_column)


def decode(
    encoded: DataFrame, rank_file: str, pattern: str, id_column: str = "doc_id", ids: str = "ids"
) -> DataFrame:
    """Raw bytes of every row of ids: ``<id_column>, ids, decoded``; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [
                decode_ids(np.frombuffer(v or b"", "<u4"), rank_file, pattern)
                for v in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(raw, pa.binary())],
                names=["row", "ids", "decoded"],
            )

    source = encoded.select(encoded[id_column].alias("row"), encoded[ids].alias("ids"))
    kind = source.schema["row"].dataType.simpleString()
    return source.mapInArrow(run, f"row {kind}, ids binary, decoded binary").withColumnRenamed(
        "row", id_column
    )
