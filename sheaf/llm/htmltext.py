"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of tags and runs of words. Words score by the place they
stand in, tags score below zero, and the content is the contiguous stretch with
the highest sum, found in one scan. The weights are log odds counted on
labelled pages: those that mark their article themselves.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Labelled pages the weights are counted on, in the order of the hashes of their ids.
LABELLED_PAGES = 2000
MARKS = frozenset(("article", "main"))
# Elements whose words are not text of the page.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "select", "object")
BOILERPLATE = frozenset(("nav", "footer", "aside", "form", "head", "menu", "dialog", "button", "header"))
# Words of a class, id or role that name page furniture.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer header menu modal nav navbar navigation newsletter notice paywall popup promo related "
    "share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<end2>/?)(?P<name2>[a-z][a-z0-9:-]*)(?P<rest2>[^<>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

Key = tuple[str, str, bool, bool, int]


def furniture(name: str, rest: str) -> bool:
    if name in BOILERPLATE:
        return True
    return any(
        part.lower() in FURNITURE for values in NAMED.findall(rest) for value in values for part in PART.findall(value)
    )


def tokens(page: str) -> Iterator[tuple[Key, str, bool]]:
    """``key, text, block``: what a tag or run of words is, its text, and if a block ends here.

    A key holds: tag or words, the element, if it stands in page furniture, if
    in a link, and its place: 1 inside the marked article, 0 outside it, 2 on a
    page that marks none.
    """
    marked = re.search(r"<(?:article|main)\b", page, re.IGNORECASE) is not None
    stack: list[tuple[str, bool]] = []
    element, link, at = "", False, 0

    def place() -> tuple[bool, int]:
        """Furniture counts up to the innermost mark only."""
        inside, furnished = False, False
        for name, plain in reversed(stack):
            if name in MARKS:
                inside = True
                break
            furnished |= plain
        return furnished, (int(inside) if marked else 2)

    state = place()
    for m in TOKEN.finditer(page):
        if m.start() > at:
            yield ("w", element, state[0], link, state[1]), page[at : m.start()], False
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name, ends = name.lower(), bool(m["end"] or m["end2"])
        rest = m["rest"] or m["rest2"] or ""
        before = state
        if name == "a":
            link = not ends
        elif name not in INLINE and name not in VOID:
            link = False
            if ends:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
            elif name == "p" or not rest.rstrip().endswith("/"):
                if name in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6") and stack and stack[-1][0] in ("p", name):
                    stack.pop()
                stack.append((name, furniture(name, rest) and not (name == "header" and place()[1] == 1)))
            element = stack[-1][0] if stack else ""
            state = place()
        if name == "br":
            yield ("t", name, state[0], link, state[1]), " ", False
        else:
            here = before if ends else state
            yield ("t", name, here[0], link, here[1]), "", name not in INLINE
    if at < len(page):
        yield ("w", element, state[0], link, state[1]), page[at:], False


class Weights:
    """Scores of words and tags by their keys; a key never seen falls back to a coarser one."""

    def __init__(self, counts: dict[tuple, tuple[int, int]] | None = None) -> None:
        self.scores: dict[tuple, float] = {}
        total: Counter = Counter()
        for key, (inside, outside) in (counts or {}).items():
            for k in self.coarser(key):
                total[k, 1] += inside
                total[k, 0] += outside
        for k in {k for k, _ in total}:
            odds = math.log((total[k, 1] + 0.5) / (total[k, 0] + 0.5))
            self.scores[k] = max(-4.0, min(4.0, odds)) if k[0] == "w" else -0.25 - max(0.0, min(4.0, -odds))

    @staticmethod
    def coarser(key: tuple) -> list[tuple]:
        kind, element, plain, link, place = key
        return [key, (kind, element, plain, link), (kind, plain, link, place), (kind, plain, link)]

    def of(self, key: tuple) -> float:
        for k in self.coarser(key):
            if k in self.scores:
                return self.scores[k]
        kind, _, plain, link, place = key
        if kind == "t":
            return -1.0 if plain else -0.25
        return -3.0 if plain or place == 0 else -0.5 if link else 1.0


def extract(page: str, weights: Weights) -> str:
    """Blocks of the best stretch, in page order, joined by a line feed."""
    found, scores = [], []
    for key, text, block in tokens(page):
        score = weights.of(key)
        if key[0] == "w":
            text = html.unescape(text)
            score *= len(text.split())
        found.append((key, text, block))
        scores.append(score)
    best, first, last, total, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, first, last = total, start, i + 1
    blocks, own = [], []
    for key, text, block in [*found[first:last], (("t",), "", True)]:
        if block:
            if line := " ".join("".join(own).split()):
                blocks.append(line)
            own = []
        elif not key[2]:  # furniture inside the article is none of its text
            own.append(text)
    return "\n".join(blocks)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for batch in batches:
        for page in batch.column(0).to_pylist():
            for key, text, _ in tokens(page):
                n = len(html.unescape(text).split()) if key[0] == "w" else 1
                if n:
                    total[key, key[4] == 1 and not key[2]] += n
    rows = [(*key, inside, n) for (key, inside), n in total.items()]
    kinds = [pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int32(), pa.bool_(), pa.int64()]
    columns = list(zip(*rows, strict=True)) or [()] * 7
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
        names=["kind", "element", "plain", "link", "place", "inside", "n"],
    )


def fit(pages: DataFrame, id_column: str = "page_id", column: str = "html", limit: int = LABELLED_PAGES) -> Weights:
    """Weights counted on ``limit`` pages at most that mark their article.

    Without such pages the weights are fixed ones. The driver gets one number
    for each kind of element.
    """
    labelled = pages.select(pages[id_column].alias("id"), pages[column].alias("html")).filter(
        F.col("html").rlike(r"(?i)<(article|main)\b")
    )
    chosen = labelled.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(limit)
    sample = labelled.join(F.broadcast(chosen), "id").select("html")
    kinds = "kind string, element string, plain boolean, link boolean, place int, inside boolean, n bigint"
    keys = ["kind", "element", "plain", "link", "place"]
    rows = sample.mapInArrow(_counted, kinds).groupBy(*keys).agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside"),
        F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("outside"),
    )
    return Weights({tuple(r[k] for k in keys): (r["inside"], r["outside"]) for r in rows.collect()})


def main_text(pages: DataFrame, weights: Weights, column: str = "html") -> DataFrame:
    """Add ``text`` to every page; its columns come back in the struct ``row``.

    Null html, and a page on which nothing scores above zero, give an empty
    text. Each page is worked on by itself, repeated ones too.
    """
    scores = weights.scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Weights()
        own.scores = scores
        for batch in batches:
            found = [extract(page or "", own) for page in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["row", "text"])

    others = [pages[c] for c in pages.columns if c != column]
    row = F.struct(*others) if others else F.struct(F.lit(None).cast("string").alias("none"))
    rows = pages.select(row.alias("row"), pages[column].cast("string").alias("html"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, text string")
