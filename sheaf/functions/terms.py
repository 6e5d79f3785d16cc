"""Terms of texts in Arrow batches: found, numbered and counted in the tasks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable

import numpy as np

from sheaf.functions.text import TABLE_ROW, TERM_BUCKETS

# Maximal runs of two or more word characters, in any script.
find_terms: Callable[[str], list[str]] = re.compile(r"\w{2,}").findall
# What counts as blank in a line.
BLANK = " \t\n\x0b\x0c\r"
REMEMBERED = 500_000


class Buckets(dict):
    """A number below ``TERM_BUCKETS`` for every term, from the first four hex digits of its MD5."""

    def __missing__(self, term: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        number = self[term] = int(hashlib.md5(term.encode()).hexdigest()[:4], 16) % TERM_BUCKETS
        return number


bucket_of = Buckets()


class ChunkTerms:
    """The lines worth scoring of a batch of texts and the buckets of their terms.

    ``rows`` holds the number of chunks of each text, ``pos`` the line of each
    chunk; ``chunk``, ``bucket`` and ``tf`` have an entry for every distinct
    bucket of a chunk.
    """

    def __init__(self, texts: Iterable[str | None]) -> None:
        rows, pos, sizes, buckets, number = [], [], [], [], bucket_of.__getitem__
        for text in texts:
            before = len(pos)
            for i, line in enumerate((text or "").lower().split("\n")):
                if i and line.strip(BLANK) and not line.startswith(TABLE_ROW):
                    found = list(map(number, find_terms(line)))
                    pos.append(i)
                    sizes.append(len(found))
                    buckets += found
            rows.append(len(pos) - before)
        self.rows, self.pos = np.array(rows, np.int64), np.array(pos, np.int32)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        both, self.tf = np.unique(owner * TERM_BUCKETS + np.array(buckets, np.int64), return_counts=True)
        self.chunk, self.bucket = np.divmod(both, TERM_BUCKETS)
