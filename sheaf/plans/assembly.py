"""Queries over document assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.operators import documents as D
from sheaf.plans.registry import Tables, query
from sheaf.session import new_path
from sheaf.streaming import ingest

# Files of a paper: the turns of a conversation, every third one empty.
FILES = """
select 'xmls/' || conv_id || '_' || (turn + 1) as path, conv_id || '_' || (turn + 1) as stem,
       case when (conv_id + turn) % 3 = 0 then '' else text end as text
from @conversations
"""


def _files(t: Tables):
    files = t.derive(FILES)
    return files.withColumn("part", D.file_parts(F.col("stem"))).select(
        F.col("part.row").alias("doc_id"), F.col("part.i").alias("i"), "text"
    )


_PICKED = f"""
files as ({FILES}),
parts as (select cast(split_part(stem, '_', 1) as bigint) as doc_id,
                 cast(split_part(stem, '_', 2) as int) as i, text from files),
picked as (select * from parts where i <= 6
           qualify row_number() over (partition by doc_id order by i) <= 3),
assembled as (select d.doc_id, count(p.i) as n_files,
                     coalesce(string_agg(p.text, '' order by p.i), '') as text
              from @documents d left join picked p using (doc_id) group by d.doc_id)
"""


def _assembled(t: Tables):
    papers = D.attach_files(t.documents.select("doc_id"), _files(t), "doc_id")
    return papers.select(
        "doc_id",
        F.coalesce(F.size("files"), F.lit(0)).cast("long").alias("n_files"),
        D.concat_texts(F.col("files")).alias("text"),
    )


@query(
    "d1_attach_files",
    f"""with {_PICKED} select d.doc_id, count(p.i) as n_candidates
        from @documents d left join (select * from parts where i <= 6) p using (doc_id)
        group by d.doc_id""",
)
def _(t: Tables):
    all_six = D.attach_files(t.documents.select("doc_id"), _files(t), "doc_id", keep=6)
    return all_six.select(
        "doc_id", F.coalesce(F.size("files"), F.lit(0)).cast("long").alias("n_candidates")
    )


@query("d2_concat_texts", f"with {_PICKED} select doc_id, md5(text) as text_md5 from assembled")
def _(t: Tables):
    return _assembled(t).select("doc_id", F.md5("text").alias("text_md5"))


@query("d3_first_three_files", f"with {_PICKED} select doc_id, n_files from assembled")
def _(t: Tables):
    return _assembled(t).select("doc_id", "n_files")


@query(
    "d4_non_empty",
    f"with {_PICKED} select doc_id, n_files from assembled where length(text) > 0",
)
def _(t: Tables):
    return D.non_empty(_assembled(t)).select("doc_id", "n_files")


HOLES = """
select nullif(source, 'src3') as doi, doc_id,
       case when doc_id % 7 < 5 then null else lang end as lang,
       case when doc_id % 2 = 0 then null else n_chars end as n_chars
from @documents
"""


@query(
    "d5_one_row_per_doi",
    f"""with h as ({HOLES})
    select doi, first(lang order by doc_id) filter (where lang is not null) as lang,
           first(n_chars order by doc_id) filter (where n_chars is not null) as n_chars
    from h where doi is not null group by doi""",
)
def _(t: Tables):
    return D.one_per_key(t.derive(HOLES), "doi", "doc_id")


@query(
    "d6_append_batch",
    """select doc_id as doi, md5(text) as text_md5, source from @documents
       union all select item_id, md5(text), null from @benchmark""",
)
def _(t: Tables):
    previous = t.documents.select(F.col("doc_id").alias("doi"), F.md5("text").alias("text_md5"), "source")
    new = t.benchmark.select(F.col("item_id").alias("doi"), F.md5("text").alias("text_md5"))
    return D.append_batch(previous, new)


@query(
    "d6_append_stream",
    "select event_type, count(*) as n, count(distinct event_id) as n_ids from @events group by event_type",
)
def _(t: Tables):
    target = new_path(t.spark, "stream-append")
    ingest.append_new_files(
        t.spark, t.folder, t.events.schema, target, pattern="events.parquet", fmt="parquet"
    )
    return (
        t.spark.read.parquet(target)
        .groupBy("event_type")
        .agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_ids"))
    )


@query(
    "a9_incremental_stream",
    "select event_type, count(*) as n, round(sum(value), 2) as total from @events group by event_type",
)
def _(t: Tables):
    """Land the events in many files, ingest half of them, then the rest."""
    landing, target = new_path(t.spark, "stream-landing"), new_path(t.spark, "stream-ingest")
    events = t.events
    even = F.col("event_id") % 2 == 0
    for part in (events.where(even), events.where(~even)):
        part.write.mode("append").parquet(landing)
        ingest.append_new_files(t.spark, landing, events.schema, target, fmt="parquet")
    return (
        t.spark.read.parquet(target)
        .groupBy("event_type")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    )


@query(
    "d7_last_token",
    """select doc_id, regexp_extract(trim(string_split(text, chr(10))[1]), '(\\S+)$', 1) as token
       from @documents""",
)
def _(t: Tables):
    first_line = F.split("text", "\n")[0]
    return t.documents.select("doc_id", D.last_token(first_line).alias("token"))
