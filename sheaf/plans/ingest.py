"""Queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.plans.registry import Tables, query
from sheaf.session import new_path
from sheaf.sources import landing, tables, xml

PAGE_KEYS = 30


@query(
    "a1_land_works",
    """
    with items as (
      select year(o_orderdate) as y, cast(floor(o_orderkey / 30) * 30 as bigint) as o,
             o_orderkey as k, o_orderpriority as p
      from @orders),
    grid as (
      select y, o from (select distinct o from items), (select unnest(range(1997, 2002)) as y)
      where o < 10000),
    stops as (
      select y, min(o) as stop from grid
      where not exists (select 1 from items i where i.y = grid.y and i.o = grid.o)
      group by y)
    select cast(i.y as bigint) as year, i.o as page_offset, '10.1/' || i.k as doi,
           'https://doi.example.org/' || i.k as url
    from items i left join stops s on i.y = s.y
    where i.y between 1997 and 2001 and i.o < 10000 and (s.stop is null or i.o < s.stop)
      and i.p <> '5-LOW'
    """,
)
def _(t: Tables):
    item = F.struct(
        F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("10.1/"), "o_orderkey")).alias("DOI"),
        F.concat(F.lit("https://doi.example.org/"), "o_orderkey").alias("URL"),
    )
    pages = (
        t.orders.select(
            (F.floor(F.col("o_orderkey") / PAGE_KEYS) * PAGE_KEYS).alias("offset"),
            F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("year"),
            F.year("o_orderdate").alias("y"),
            item.alias("item"),
        )
        .groupBy("year", "offset")
        .agg(F.collect_list(F.when(F.col("y") == F.col("year"), F.col("item"))).alias("items"))
        .select("year", "offset", F.to_json(F.struct(F.struct("items").alias("message"))).alias("body"))
    )
    works = landing.land_works(pages, most_recent_year=2001, years=5)
    return works.select(
        F.col("year").cast("long").alias("year"),
        F.col("offset").alias("page_offset"),
        F.col("DOI").alias("doi"),
        F.col("URL").alias("url"),
    )


@query(
    "a2_csv_scan",
    "select doc_id, lang, source, n_chars, md5(text) as text_md5 from @documents",
)
def _(t: Tables):
    path = new_path(t.spark, "csv")
    docs = t.documents
    tables.write_csv(docs, path)
    back = tables.read_csv(t.spark, path, docs.schema)
    return back.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


@query(
    "a3_table_sink",
    """select event_type, count(*) as n, round(sum(value), 2) as total, max(event_id) as last_id
       from @events group by event_type""",
)
def _(t: Tables):
    path = new_path(t.spark, "table")
    tables.write_table(t.events, path, partition_by=("event_type",))
    return (
        t.spark.read.parquet(path)
        .groupBy("event_type")
        .agg(
            F.count("*").alias("n"),
            F.round(F.sum("value"), 2).alias("total"),
            F.max("event_id").alias("last_id"),
        )
    )


def _keyed_objects(t: Tables):
    """One object of at most 500 records per line."""
    record = F.struct("event_type", "user_id", "value")
    return (
        t.events.groupBy(F.floor(F.col("event_id") / 500).alias("b"))
        .agg(F.map_from_entries(F.collect_list(F.struct(F.col("event_id").cast("string"), record))).alias("m"))
        .select(F.to_json("m").alias("value"))
    )


@query(
    "a4_keyed_json_scan",
    "select cast(event_id as varchar) as id, event_type, user_id, value from @events",
)
def _(t: Tables):
    path = new_path(t.spark, "keyed")
    _keyed_objects(t).write.text(path)
    rows = tables.read_keyed_json(t.spark, path)
    return tables.records(rows, "event_type string, user_id bigint, value double")


# Objects over many lines, as written by hand: braces and quotes in texts, lists, and members that are no record.
OBJECTS = """
select k, pos, value from (
  select event_id % 3 as k, event_id as pos,
    '  "' || event_id || '": {"event_type": "' || event_type || '",\n    "user_id": ' || user_id || ', "note": "a } or {\\\\" ['
    || event_type || '", "list": [{"n": ' || user_id || '}, "]"]}' || ',\n' || case when event_id % 7 = 0 then '"t' || event_id || '": "}' || event_type || '",' else '' end as value
  from @events
  union all select distinct event_id % 3, cast(-1 as bigint), '{' from @events
  union all select distinct event_id % 3, cast(1000000000000 as bigint), '"end": null}' from @events)
"""


@query(
    "a4_split_objects",
    """select cast(event_id as varchar) as id, event_type, user_id, 'a } or {" [' || event_type as note, user_id as first_of_list, null as raw
       from @events union all
       select 't' || event_id, null, null, null, null, '}' || event_type from @events where event_id % 7 = 0 union all
       select 'end', null, null, null, null, null from (select distinct event_id % 3 from @events)""",
)
def _(t: Tables):
    path = new_path(t.spark, "objects")
    rows = t.derive(OBJECTS).repartition("k").sortWithinPartitions("k", "pos")
    rows.select("value", "k").write.partitionBy("k").text(path)
    found = tables.read_keyed_json(t.spark, path, one_per_line=False)
    record = F.from_json("raw", "event_type string, user_id bigint, note string, list array<string>")
    is_record = F.col("raw").startswith("{")
    return found.withColumn("r", F.when(is_record, record)).select(
        "id", "r.event_type", "r.user_id", "r.note",
        F.get_json_object(F.col("r.list")[0], "$.n").cast("bigint").alias("first_of_list"),
        F.when(~is_record, F.col("raw")).alias("raw"),
    )


@query(
    "a5_keyed_json_sink",
    """select '{"' || event_id || '":{"event_type":"' || event_type || '","user_id":' || user_id
              || '}}' as value from @events""",
)
def _(t: Tables):
    path = new_path(t.spark, "keyed-out")
    tables.write_keyed_json(t.events, "event_id", F.struct("event_type", "user_id"), path)
    return t.spark.read.text(path)


TEI = """
select 'xmls/' || doc_id || '_1' || case when doc_id % 3 = 0 then '.grobid.tei.xml' else '.xml' end as path,
  case when doc_id % 10 = 9 then '<TEI><teiHeader>' || doc_id else
  '<TEI' || case when doc_id % 2 = 0 then ' xmlns="http://www.tei-c.org/ns/1.0"' else '' end
  || '><teiHeader><fileDesc><titleStmt>'
  || case when doc_id % 4 = 0 then '<title level="a" type="main"/>' else '<title>Paper &lt;' || source || '&gt; 20 &#8451;</title>' end
  || '</titleStmt><sourceDesc><title level="j">A journal</title></sourceDesc></fileDesc><profileDesc><abstract><p>Lang ' || lang || '</p></abstract>'
  || '</profileDesc></teiHeader><text><body><div><p>'
  || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
             chr(10), '</p><p>')
  || '</p></div></body></text></TEI>' end as content
from @documents
"""


@query(
    "a6_tei_documents",
    """
    select doc_id || '_1' as stem, md5(case when doc_id % 10 = 9 then '' else
      'Paper #: ' || doc_id || '_1' || chr(10)
      || case when doc_id % 4 = 0 then '' else 'Title: Paper <' || source || '> 20 ' || chr(8451) end || chr(10)
      || 'Lang ' || lang || chr(10)
      || trim(regexp_replace(text, '\\n{2,}', chr(10), 'g'), chr(10) || ' ') || chr(10) end)
      as text_md5
    from @documents
    """,
)
def _(t: Tables):
    files = t.derive(TEI)
    return files.select(
        xml.paper_stem(F.col("path")).alias("stem"),
        F.md5(xml.tei_text(F.col("path"), F.col("content"))).alias("text_md5"),
    )


BIOC = """
select conv_id * 100 + turn as paper,
  case when turn % 3 = 0 then '' else '<?xml version="1.0"?><collection><source>s</source><document><id>0</id></document>' end
  || '<document><passage><text>Paper number ' || (conv_id * 100 + turn) || '</text></passage>'
  || '<passage><text>' || replace(replace(text, '&', '&amp;'), '<', '&lt;') || '</text>'
  || '<annotation id="1"><infon key="type">treated_pce</infon><infon key="identifier"></infon><text>'
  || length(text) || '</text></annotation>'
  || '<annotation id="2"><infon key="type">passivating_molecule</infon><infon key="identifier">mol'
  || turn || '</infon><text>' || role || '</text></annotation></passage>'
  || case when turn % 2 = 0 then '<relation><infon key="type">test_1</infon><node refid="1"/><node refid="2"/></relation>' else '' end
  || '</document>' || case when turn % 3 = 0 then '' else '</collection>' end as content
from @conversations
"""


@query(
    "a7_bioc_annotations",
    """
    with c as (select conv_id * 100 + turn as paper, * from @conversations)
    select cast(paper as varchar) as paper, 1 as passage, cast(4294967296 as bigint) as pos,
           '1' as node_id, 'treated_pce' as var_name, null as identifier,
           cast(length(text) as varchar) as text,
           case when turn % 2 = 0 then 'test_1' end as test_name
    from c union all
    select cast(paper as varchar), 1, 4294967297, '2', 'passivating_molecule', 'mol' || turn, role,
           case when turn % 2 = 0 then 'test_1' end
    from c
    """,
)
def _(t: Tables):
    parsed = xml.parse_bioc(t.derive(BIOC))
    related = xml.bioc_relations(parsed).select("paper", "node_id", "test_name")
    notes = xml.bioc_annotations(parsed).withColumn("passage", F.col("passage").cast("int"))
    return notes.join(related, ["paper", "node_id"], "left")


# One collection of many documents per file; what is annotated stands in
# sentences, passages and the documents themselves.
COLLECTIONS = """
select k, paper, value from (
  select conv_id % 4 as k, conv_id * 100 + turn as paper,
    '<document><id>' || conv_id || '</id><passage><text>Paper number ' || (conv_id * 100 + turn) || '</text></passage>'
    || '<passage><sentence><text>' || replace(replace(text, '&', '&amp;'), '<', '&lt;') || '</text>'
    || '<annotation id="1"><infon key="type">time</infon><text>' || length(text) || '</text></annotation>'
    || '<relation><infon key="type">in_sentence</infon><node refid="1"/></relation></sentence>'
    || '<annotation id="2"><infon key="type">humidity</infon><text>' || turn || '</text></annotation>'
    || '<relation><infon key="type">in_passage</infon><node refid="2"/></relation></passage>'
    || '<annotation id="3"><infon key="type">role</infon><text>' || role || '</text></annotation>'
    || '<relation><infon key="type">in_document</infon><node refid="1"/><node refid="3"/></relation></document>' as value
  from @conversations
  union all select distinct conv_id % 4, cast(-1 as bigint), '<?xml version="1.0"?><collection><source>s</source>' from @conversations
  union all select distinct conv_id % 4, cast(1000000000000 as bigint), '</collection>' from @conversations)
"""


@query(
    "a7_split_collections",
    """
    with c as (select cast(conv_id * 100 + turn as varchar) as paper, * from @conversations),
    a as (
      select paper, 1 as passage, cast(4294967297 as bigint) as pos, '1' as node_id, 'time' as var_name,
        cast(length(text) as varchar) as value from c
      union all select paper, 1, 4294967296, '2', 'humidity', cast(turn as varchar) from c
      union all select paper, null, 8589934592, '3', 'role', role from c),
    r(rel_pos, test_name, node_id) as (
      values (0, 'in_passage', '2'), (1, 'in_sentence', '1'), (2, 'in_document', '1'), (2, 'in_document', '3'))
    select a.*, cast(r.rel_pos as bigint) as rel_pos, r.test_name from a join r using (node_id)
    """,
)
def _(t: Tables):
    path = new_path(t.spark, "bioc")
    rows = t.derive(COLLECTIONS).repartition("k").sortWithinPartitions("k", "paper")
    rows.select("value", "k").write.partitionBy("k").text(path)
    parsed = xml.read_bioc(t.spark, path)
    notes = xml.bioc_annotations(parsed).withColumnRenamed("text", "value").withColumn("passage", F.col("passage").cast("int"))
    return notes.drop("identifier").join(xml.bioc_relations(parsed), ["paper", "node_id"])


@query(
    "a8_text_files",
    "select cast(sum(length(text) + 1) as bigint) as n_chars from @documents",
)
def _(t: Tables):
    path = new_path(t.spark, "texts")
    t.documents.select("text").write.option("maxRecordsPerFile", 1000).text(path)
    return tables.read_text_files(t.spark, path).agg(F.sum(F.length("text")).alias("n_chars"))


@query(
    "a9_unprocessed_files",
    """select 'in/doc_' || doc_id || '.pdf' as path from @documents
       where doc_id not in (select doc_id from @labels)""",
)
def _(t: Tables):
    inputs = t.documents.select(F.concat(F.lit("in/doc_"), "doc_id", F.lit(".pdf")).alias("path"))
    done = t.labels.select(F.concat(F.lit("out/doc_"), "doc_id", F.lit(".xml")).alias("path"))
    return landing.unprocessed(inputs, done)
