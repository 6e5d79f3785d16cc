"""Queries over the links of web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.operators import links as L
from sheaf.plans.registry import Tables, query

# Pages with the blocks and file links of a publisher's site added.
_EXCLUDED = """'<div class="x" id="recommended-articles"><div><a href="/pdf/other' || page_id || '.pdf">o</a></div>'
  || '<div><div>deep</div></div><a href="/pdf/late' || page_id || '.pdf">l</a></div>'
  || '<ol class="references"><li><ol><li>x</li></ol><a href="https://a.example.org/pdf/ref">r</a></li></ol>'"""


def _with(blocks: str) -> str:
    return f"""
select page_id, url, replace(html, '</article>', '</article>'
  || {blocks}
  || '<a href="https://scholar.google.com/pdf/s.pdf">s</a>'
  || case when page_id % 5 = 0 then '' else
     '<a class="d" href="/pdf/p' || page_id || '">1</a>'
  || '<a href="https://f.example.org/articlepdf/' || page_id || '?v=1">2</a>'
  || '<a href="https://f.example.org/articlepdf/' || page_id || '?v=2">3</a>'
  || '<a href="/x/file.pdf">4</a><a href="/x/DATA.PDF">5</a><a href="/x/data.pdf?dl=1">6</a>' end
) as html from @pages
"""


PAGES = _with(_EXCLUDED)
_HREFS = """regexp_extract_all({0}, '(?is)<a\\s[^>]*?href=["'']([^"'']*)["'']', 1)"""
_LINKS = f"""
pages_plus as ({_with("''")}),
links as (select page_id, url, unnest({_HREFS.format('html')}) as href,
                 generate_subscripts({_HREFS.format('html')}, 1) - 1 as pos from pages_plus),
wanted as (select * from links where href <> '' and href not like '%scholar.google%'
           and regexp_matches(href, '(?i)((^|[^e])\\.pdf$|/pdf/|/articlepdf/|/article-pdf/)')),
firsts as (select * from wanted qualify row_number() over
           (partition by page_id, regexp_replace(href, '[;?#].*$', '') order by pos) = 1)
"""


def _pages(t: Tables):
    return t.derive(PAGES)


def _wanted(t: Tables):
    pages = _pages(t)
    return L.full_text_links(L.anchors(pages, L.without_blocks(F.col("html"))))


@query(
    "b1_url_base",
    "select page_id, regexp_replace(url, '[;?#].*$', '') as base from @pages",
)
def _(t: Tables):
    return t.pages.select("page_id", L.url_base(F.col("url")).alias("base"))


@query(
    "b2_links_outside_blocks",
    f"with {_LINKS} select page_id, cast(pos as int) as pos, href from links",
)
def _(t: Tables):
    return L.anchors(_pages(t), L.without_blocks(F.col("html"))).select("page_id", "pos", "href")


@query(
    "b3_full_text_links",
    f"with {_LINKS} select page_id, cast(pos as int) as pos, href from wanted",
)
def _(t: Tables):
    return _wanted(t).select("page_id", "pos", "href")


@query(
    "b4_first_link_per_base",
    f"with {_LINKS} select page_id, cast(pos as int) as pos, href from firsts",
)
def _(t: Tables):
    return L.first_per_base(_wanted(t)).select("page_id", "pos", "href")


@query(
    "b5_resolved_links",
    f"""with {_LINKS}, r as (
        select page_id, href, case when starts_with(href, 'http') then href
               else regexp_replace(url, '[;?#].*$', '') || href end as target from firsts)
    select * from r where contains(target, 'pdf')""",
)
def _(t: Tables):
    firsts = L.first_per_base(_wanted(t))
    return L.downloadable(firsts).select("page_id", "href", "target")


@query(
    "b6_link_counts",
    f"""with {_LINKS}
    select p.page_id, count(f.href) as n_links, count(f.href) = 0 as failed
    from @pages p left join firsts f using (page_id) group by p.page_id""",
)
def _(t: Tables):
    pages = t.pages
    firsts = L.first_per_base(_wanted(t))
    counts = L.link_counts(pages, firsts)
    failed = L.pages_without_links(pages, firsts).withColumn("failed", F.lit(True))
    return counts.join(failed, "page_id", "left").withColumn(
        "failed", F.coalesce("failed", F.lit(False))
    )


@query(
    "b7_row_cap",
    "select page_id, url from @pages order by page_id limit 99",
)
def _(t: Tables):
    return L.row_cap(t.pages.select("page_id", "url"), "page_id", 100)
