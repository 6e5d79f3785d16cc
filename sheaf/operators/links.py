"""Link extraction over a table of web pages."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Hrefs that lead to a full-text file, and hosts to skip.
FULL_TEXT = r"(?i)((?<!e)\.pdf$|/pdf/|/articlepdf/|/article-pdf/)"
SKIPPED_HOST = "scholar.google"
# Page blocks whose links belong to other papers, by element,
# attribute and value.
EXCLUDED_BLOCKS = (("div", "id", "recommended-articles"), ("ol", "class", "references"))
_HREF = r"(?is)<a\s[^>]*?href=[\"']([^\"']*)[\"']"


def url_base(url: Column) -> Column:
    """Scheme, host and path; parameters, query and fragment dropped."""
    return F.regexp_replace(url, r"[;?#].*$", "")


def cut_blocks(html: str, element: str, attribute: str, value: str) -> str:
    """Cut out each such element up to its own closing tag, however deep it is nested.

    One walk over the element's tags keeps the depth; what stays is copied once.
    An element that is never closed reaches to the end of the page.
    """
    tags = re.compile(rf"<{element}(?=[\s>])[^>]*>?|</{element}\s*>", re.IGNORECASE)
    marked = re.compile(rf"[^>]*\s{attribute}=[\"']{value}[\"'][^>]*>", re.IGNORECASE)
    kept, start, depth = [], 0, 0
    for tag in tags.finditer(html):
        opens = html[tag.start() + 1] != "/"
        if depth:
            depth += 1 if opens else -1
            if not depth:
                start = tag.end()
        elif opens and marked.match(tag[0]):
            kept.append(html[start : tag.start()])
            depth = 1
    return "".join(kept) + ("" if depth else html[start:])


def without_blocks(html: Column, blocks: Sequence[tuple[str, str, str]] = EXCLUDED_BLOCKS) -> Column:
    @F.arrow_udf(T.StringType())
    def cut(pages: pa.Array) -> pa.Array:
        out = []
        for page in pages.to_pylist():
            for block in blocks if page else ():
                page = cut_blocks(page, *block)
            out.append(page)
        return pa.array(out, pa.string())

    return cut(html)


def anchors(
    pages: DataFrame, html: Column, keep: Sequence[str] = ("page_id", "url")
) -> DataFrame:
    """Rows ``page_id, url, pos, href`` in document order."""
    hrefs = F.regexp_extract_all(html, F.lit(_HREF), 1)
    return pages.select(*keep, F.posexplode(hrefs).alias("pos", "href"))


def full_text_links(
    links: DataFrame, pattern: str = FULL_TEXT, skipped_host: str = SKIPPED_HOST
) -> DataFrame:
    return links.where(
        (F.col("href") != "")
        & F.col("href").rlike(pattern)
        & ~F.col("href").contains(skipped_host)
    )


def first_per_base(links: DataFrame, page: str = "page_id") -> DataFrame:
    """First link of every base URL in a page.

    A minimum by position combines before the shuffle; ranking would not.
    """
    others = [c for c in links.columns if c not in (page, "pos", "href")]
    return (
        links.groupBy(page, url_base(F.col("href")).alias("base"))
        .agg(F.min_by(F.struct("pos", "href", *others), "pos").alias("f"))
        .select(page, "f.*")
    )


def resolve(page_url: Column, href: Column) -> Column:
    """Absolute links stay; others are appended to the page's base URL."""
    return F.when(href.startswith("http"), href).otherwise(F.concat(url_base(page_url), href))


def downloadable(links: DataFrame, marker: str = "pdf") -> DataFrame:
    resolved = links.withColumn("target", resolve(F.col("url"), F.col("href")))
    return resolved.where(F.col("target").contains(marker))


def link_counts(pages: DataFrame, links: DataFrame, page: str = "page_id") -> DataFrame:
    counted = links.groupBy(page).agg(F.count("*").alias("n_links"))
    return (
        pages.select(page)
        .join(counted, page, "left")
        .withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    )


def pages_without_links(pages: DataFrame, links: DataFrame, page: str = "page_id") -> DataFrame:
    """The failed list: an anti join needs no counting."""
    return pages.select(page).join(links.select(page).distinct(), page, "left_anti")


def row_cap(df: DataFrame, order: str, num_papers: int) -> DataFrame:
    """The first ``num_papers - 1`` rows by ``order`` (a top-k, no full sort)."""
    return df.orderBy(order).limit(max(num_papers - 1, 0))
