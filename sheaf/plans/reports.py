"""Queries behind the report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.operators import reports as V
from sheaf.plans.registry import Tables, query
from sheaf.plans.records import NAMES, _DICT, _PASS2

EPOCHS = ("0.2", "0.7", "1.2")


@query(
    "v1_melted_losses",
    """select event_type as model_name, is_train, epoch, round(loss, 6) as loss from (
         select event_type, event_id % 2 = 0 as is_train, avg(value) as "0.2", avg(value) / 2 as "0.7", avg(value) / 4 as "1.2"
         from @events group by all) unpivot (loss for epoch in ("0.2", "0.7", "1.2")) where is_train""",
)
def _(t: Tables):
    wide = t.events.groupBy(F.col("event_type").alias("model_name"), (F.col("event_id") % 2 == 0).alias("is_train")).agg(
        *[(F.avg("value") / d).alias(e) for e, d in zip(EPOCHS, (1, 2, 4))]
    )
    columns = [F.col(f"`{e}`") for e in EPOCHS]
    long = V.melt(wide, ["model_name", "is_train"], columns, "epoch", "loss").where("is_train")
    return long.withColumn("loss", F.round("loss", 6))


@query(
    "v2_melted_retrieval",
    """select lang, metric, round(score, 6) as score from (
         select lang, avg(quality) as accuracy, cast(avg(toxic) as double) as recall from @documents join @labels using (doc_id) group by lang)
       unpivot (score for metric in (accuracy, recall))""",
)
def _(t: Tables):
    wide = (
        t.documents.select("doc_id", "lang")
        .join(t.labels, "doc_id")
        .groupBy("lang")
        .agg(F.avg("quality").alias("accuracy"), F.avg("toxic").alias("recall"))
    )
    return V.melt(wide, ["lang"], ["accuracy", "recall"], "metric", "score").withColumn("score", F.round("score", 6))


GAPS = """
select case when event_id % 3 = 0 then null else event_type end as molecule,
       case when event_id % 7 = 0 then null else value end as time, user_id as paper from @events
"""


@query(
    "v3_completeness",
    f"""with g as ({GAPS}), s as (
      select 'papers' as "table", 'molecule' as "column", 100.0::double * count(molecule) / count(*) as f from g
      union all select 'papers', 'paper', 100.0::double * count(paper) / count(*) from g
      union all select 'tests', 'time', 100.0::double * count(time) / count(*) from g)
    select "table", "column", round(f, 6) as filled_pct, round(100 - f, 6) as missing_pct from s""",
)
def _(t: Tables):
    gaps = t.derive(GAPS)
    both = V.completeness(gaps, ["molecule", "paper"], "papers").unionByName(V.completeness(gaps, ["time"], "tests"))
    return both.withColumns({c: F.round(c, 6) for c in ("filled_pct", "missing_pct")})


@query(
    "v4_conversion_funnel",
    f"""with n as (select distinct name from ({NAMES}) where name is not null and name <> 'none'),
      d as ({_DICT}), x as (select name, any_value(converted) as smiles from ({_PASS2}) group by name),
      f as (select n.name, d.converted, x.smiles from n left join d on n.name = d.name left join x on n.name = x.name),
      s as (select 0 as place, 'extracted' as stage, count(*) as n from f
            union all select 1, 'converted', count(converted) from f
            union all select 2, 'structures', count(smiles) from f)
    select place, stage, n, round(100.0::double * n / (select n from s where place = 0), 6) as pct from s""",
)
def _(t: Tables):
    names = t.derive(NAMES).where("name is not null and name <> 'none'").select("name").distinct()
    lookup = t.derive(_PASS2).withColumnRenamed("converted", "smiles")
    rows = names.join(t.derive(_DICT), "name", "left").join(lookup, "name", "left")
    stages = {
        "extracted": F.col("name").isNotNull(),
        "converted": F.col("converted").isNotNull(),
        "structures": F.col("smiles").isNotNull(),
    }
    return V.funnel(rows, stages).withColumn("pct", F.round("pct", 6))


@query(
    "v5_box_statistics",
    """select l_returnflag as model, round(min(l_extendedprice), 4) as minimum,
         round(quantile_cont(l_extendedprice, 0.25), 4) as q1, round(quantile_cont(l_extendedprice, 0.5), 4) as median,
         round(quantile_cont(l_extendedprice, 0.75), 4) as q3, round(max(l_extendedprice), 4) as maximum
       from @lineitem group by 1""",
)
def _(t: Tables):
    rows = t.lineitem.select(F.col("l_returnflag").alias("model"), "l_extendedprice")
    out = V.box_statistics(rows, "model", "l_extendedprice")
    return out.select("model", *[F.round(c, 4).alias(c) for c in ("minimum", "q1", "median", "q3", "maximum")])


@query(
    "v6_epoch_labels",
    "select event_type || chr(10) || '(' || user_id || ' epochs)' as label, count(*) as n from @events group by 1",
)
def _(t: Tables):
    label = V.epoch_label(F.col("event_type"), F.col("user_id"))
    return t.events.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query(
    "v7_data_set_shapes",
    """select 'documents' as data_set, (select count(*) from @documents) as n_rows, 5 as n_columns
       union all select 'labelled', (select count(*) from @documents join @labels using (doc_id)), 7
       union all select 'events', (select count(*) from @events where value > 100), 6""",
)
def _(t: Tables):
    return V.shapes(
        {
            "documents": t.documents,
            "labelled": t.documents.join(t.labels, "doc_id"),
            "events": t.events.where("value > 100"),
        }
    )


@query(
    "v8_null_counts",
    f"""with g as ({GAPS}) select 'molecule' as "column", count(*) - count(molecule) as n_null from g
        union all select 'time', count(*) - count(time) from g union all select 'paper', count(*) - count(paper) from g""",
)
def _(t: Tables):
    return V.null_counts(t.derive(GAPS))
