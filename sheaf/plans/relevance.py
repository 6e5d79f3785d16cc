"""Queries over relevance classification and chunk filtering."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions.similarity import cosine, euclidean
from sheaf.functions.text import term_frequency
from sheaf.operators import chunks as R
from sheaf.operators import relevance as T
from sheaf.plans.registry import Tables, query
from sheaf.session import new_path, written

NAMES = ("the", "des", "der", "los")
PHRASES = ("tion", "und")
QUERY = "What is the relation of the treated and the control, des entre que der und los"

_NAMES_SQL = ", ".join(f"'{n}'" for n in NAMES)


@query(
    "t1_term_frequency",
    f"""select doc_id, len(list_filter(string_split_regex(lower(text), '\\s+'),
               lambda w: w in ({_NAMES_SQL}))) as n from @documents""",
)
def _(t: Tables):
    n = term_frequency(F.col("text"), NAMES).cast("long")
    return t.documents.select("doc_id", n.alias("n"))


@query(
    "t2_keyword_filter",
    f"""select doc_id, lang from @documents
    where (contains(lower(text), 'the') or contains(lower(text), 'des')
           or contains(lower(text), 'der') or contains(lower(text), 'los'))
      and (contains(lower(text), 'tion') or contains(lower(text), 'und'))
      and len(list_filter(string_split_regex(lower(text), '\\s+'),
              lambda w: w in ({_NAMES_SQL}))) > 2""",
)
def _(t: Tables):
    return T.keyword_filter(t.documents, "text", NAMES, PHRASES).select("doc_id", "lang")


def _labelled(t: Tables):
    return t.documents.join(t.labels, "doc_id").select(
        "doc_id", "text", "lang", F.col("toxic").alias("label"), "quality"
    )


@query(
    "t3_balanced_classes",
    """
    with x as (select doc_id, toxic as label from @documents join @labels using (doc_id)),
    k as (select 2 * count(*) as k from x where label = 1)
    select doc_id, label from x where label = 1
    union all
    select doc_id, label from (select *, row_number() over (order by md5(doc_id || '-42'), doc_id) as r
                               from x where label = 0) where r <= (select k from k)
    """,
)
def _(t: Tables):
    rows = t.labels.join(t.documents.select("doc_id"), "doc_id")
    rows = rows.select("doc_id", F.col("toxic").alias("label"))
    return T.balance_classes(rows, "doc_id", "label")


_TF_SQL = """
tf as (select doc_id, term, count(*) as tf from (
         select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) as term
         from @documents) group by all),
vocab as (select term, sum(tf) as total, count(*) as df from tf group by term
          order by total desc, term limit 4000),
w as (select doc_id, term, tf * (ln((1.0::double + (select count(*) from @documents)) / (1 + df)) + 1) as w
      from tf join vocab using (term)),
v as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as tfidf from w)
"""


@query(
    "t4_tfidf",
    f"""with {_TF_SQL}
    select term, count(*) as df, round(sum(tfidf), 5) as weight, round(max(tfidf), 6) as heaviest
    from v group by term""",
)
def _(t: Tables):
    v = T.tfidf(t.documents, "doc_id", "text")
    return v.groupBy("term").agg(
        F.count("*").alias("df"),
        F.round(F.sum("tfidf"), 5).alias("weight"),
        F.round(F.max("tfidf"), 6).alias("heaviest"),
    )


@query(
    "t5_train_test",
    """
    with r as (select doc_id, row_number() over (order by md5(doc_id || '-42'), doc_id) as r,
                      count(*) over () as n from @documents)
    select doc_id, r <= ceil(n * 0.2::double) as is_test from r
    """,
)
def _(t: Tables):
    return T.train_test(t.documents.select("doc_id"), "doc_id")


def _features(t: Tables):
    """Split, featurise on the train side, and keep the vectors for all fits."""
    split = T.train_test(_labelled(t), "doc_id")
    split = written(split, "labelled-split")
    model = T.TfidfFeatures("text").fit(split.where(~F.col("is_test")))
    vectors = model.transform(split).select("doc_id", "lang", "label", "is_test", "features")
    vectors = written(T.class_weights(vectors, "label", train=F.expr("not is_test")), "labelled-features")
    return vectors.where(~F.col("is_test")), vectors.where("is_test")


def _fit_and_predict(t: Tables, name: str):
    train, test = _features(t)
    estimator = T.classifiers(train.count())[name]
    scored = estimator.fit(train).transform(test)
    return scored.select("doc_id", "label", F.col("prediction").cast("int").alias("prediction"))


for _id, _name in (
    ("t6_logistic_regression", "Logistic Regression"),
    ("t8_linear_svm", "SVM"),
    ("t9_random_forest", "Random Forest"),
    ("t10_gradient_boosting", "Gradient Boosting"),
):
    query(_id)(lambda t, name=_name: _fit_and_predict(t, name))


def _searched(t: Tables, name: str):
    train, test = _features(t)
    estimator, grid = T.classifier_grids(train.count())[name]
    best = T.grid_search(train, estimator, grid).bestModel
    scored = best.transform(test).select("label", F.col("prediction").cast("int").alias("p"))
    return T.confusion(scored, "label", "p").withColumn("model", F.lit(name))


for _id, _name in (
    ("t11_grid_search", "Naive Bayes"),
    ("t11_grid_search_logistic", "Logistic Regression"),
    ("t11_grid_search_svm", "SVM"),
):
    query(_id)(lambda t, name=_name: _searched(t, name))


_PAIRS = "pairs as (select lang, quality as y, toxic as p from @documents join @labels using (doc_id))"


def _pairs(t: Tables):
    return t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").select(
        "lang", F.col("quality").alias("y"), F.col("toxic").alias("p")
    )


@query(
    "t12_confusion",
    f"""with {_PAIRS}, c as (select lang,
        count(*) filter (where y = 1 and p = 1) as tp, count(*) filter (where y = 0 and p = 1) as fp,
        count(*) filter (where y = 1 and p = 0) as fn, count(*) filter (where y = 0 and p = 0) as tn
        from pairs group by lang)
    select *, round(1 - (coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 9)
           as ber from c""",
)
def _(t: Tables):
    out = T.confusion(_pairs(t), "y", "p", by=["lang"])
    return out.withColumn("ber", F.round("ber", 9))


@query(
    "t13_classification_report",
    f"""with {_PAIRS}, classes as (
        select lang, y as class, 1 as sup, cast(y = p as int) as hit, 0 as pred from pairs
        union all select lang, p, 0, 0, 1 from pairs),
      s as (select lang, class, sum(sup) as support, sum(hit) as hits, sum(pred) as predicted
            from classes group by all),
      r as (select lang, class, cast(support as bigint) as support,
                   coalesce(hits / nullif(predicted, 0), 0) as precision,
                   coalesce(hits / nullif(support, 0), 0) as recall from s),
      acc as (select lang, avg(cast(y = p as int)) as accuracy from pairs group by lang)
    select lang, class, support, round(precision, 9) as precision, round(recall, 9) as recall,
           round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) as f1,
           round(accuracy, 9) as accuracy
    from r join acc using (lang)""",
)
def _(t: Tables):
    pairs = _pairs(t)
    report = T.classification_report(pairs, "y", "p", by=["lang"])
    out = report.join(T.accuracy(pairs, "y", "p", by=["lang"]), "lang")
    return out.select(
        "lang", "class", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy")]
    )


@query(
    "t14_model_comparison",
    """
    with m as (select source as model, case when toxic = 1 then 'after' else 'before' end as stage,
                      avg(quality) as accuracy, avg(n_chars) as ber
               from @documents join @labels using (doc_id) group by all)
    select model, round(max(accuracy) filter (where stage = 'before'), 9) as accuracy_before,
           round(max(ber) filter (where stage = 'before'), 6) as ber_before,
           round(max(accuracy) filter (where stage = 'after'), 9) as accuracy_after,
           round(max(ber) filter (where stage = 'after'), 6) as ber_after
    from m group by model
    """,
)
def _(t: Tables):
    stage = F.when(F.col("toxic") == 1, "after").otherwise("before")
    metrics = (
        t.documents.select("doc_id", "source", "n_chars")
        .join(t.labels, "doc_id")
        .groupBy(F.col("source").alias("model"), stage.alias("stage"))
        .agg(F.round(F.avg("quality"), 9).alias("accuracy"), F.round(F.avg("n_chars"), 6).alias("ber"))
    )
    return T.compare_stages(metrics, ("before", "after"), ("accuracy", "ber"))


# Term weights of the train side, log-probabilities by label and term, scores of the test side.
_BAYES = """
lab as (select doc_id, text, toxic as label from @documents join @labels using (doc_id)),
r as (select *, row_number() over (order by md5(doc_id || '-42'), doc_id) <= ceil((select count(*) from lab) * 0.2::double) as is_test
      from lab),
tf as (select doc_id, label, is_test, term, count(*) as tf from (
         select doc_id, label, is_test, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) as term from r) group by all),
vocab as (select term, sum(tf) as total, count(*) as df from tf where not is_test group by term order by total desc, term limit 4000),
w as (select doc_id, label, is_test, term,
             tf * (ln((1.0::double + (select count(*) from r where not is_test)) / (1 + df)) + 1) as w from tf join vocab using (term)),
v as (select doc_id, label, is_test, term, w / sqrt(sum(w * w) over (partition by doc_id)) as x from w),
classes as (select label as class, ln(count(*) / (select count(*) from r where not is_test)) as prior
            from r where not is_test group by label),
sums as (select label as class, term, sum(x) as s from v where not is_test group by all),
lp as (select class, term, ln((coalesce(s, 0) + 1) / (sum(coalesce(s, 0)) over (partition by class) + (select count(*) from vocab))) as lp
       from classes cross join vocab left join sums using (class, term)),
hits as (select doc_id, class, sum(x * lp) as s from v join lp using (term) where is_test group by all),
scores as (select r.doc_id, r.label, class, prior + coalesce(s, 0) as score
           from r cross join classes left join hits using (doc_id, class) where is_test)
"""


@query(
    "t7_naive_bayes",
    f"with {_BAYES} select doc_id, label, arg_max(class, score) as prediction from scores group by doc_id, label",
)
def _(t: Tables):
    split = written(T.train_test(_labelled(t), "doc_id"), "labelled-split")
    model = T.TermBayes.fit(split.where("not is_test"), "doc_id", "text", "label")
    test = split.where("is_test").select("doc_id", "text", "label")
    return model.predict(test, "doc_id", "text").join(test.select("doc_id", "label"), "doc_id")


@query(
    "t15_saved_model",
    f"""with {_BAYES} select doc_id, label, round(sum(exp(score - best)) filter (where class = 1) / sum(exp(score - best)), 6) as probability
        from (select *, max(score) over (partition by doc_id) as best from scores) group by doc_id, label""",
)
def _(t: Tables):
    split = written(T.train_test(_labelled(t), "doc_id"), "labelled-split")
    path = new_path(t.spark, "model")
    T.TermBayes.fit(split.where("not is_test"), "doc_id", "text", "label").save(path)
    test = split.where("is_test").select("doc_id", "text", F.col("label").alias("own"))
    scored = T.TermBayes.load(t.spark, path).transform(test, "doc_id", "text").where("label = 1")
    return scored.join(test.select("doc_id", "own"), "doc_id").select(
        "doc_id", F.col("own").alias("label"), F.round("probability", 6).alias("probability")
    )


# Documents with null and repeated keys; ``rid`` tells rows apart.
KEYED = """
select doc_id as rid, case when doc_id % 50 = 7 then null when doc_id % 50 = 9 then doc_id - 1 else doc_id end as doc_id,
       lang, case when doc_id % 200 = 11 then null else text end as text
from @documents
"""
_CHUNKS = f"""
docs as ({KEYED}),
raw as (select rid, doc_id, unnest(string_split(text, chr(10))) as chunk,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from docs),
chunks as (select * from raw where pos > 0 and regexp_matches(chunk, '\\S')
           and not starts_with(chunk, chr(9) || chr(9) || chr(9)))
"""
_ASKED = "case " + " ".join(f"when b = {b} then {n}" for b, n in R.query_buckets(QUERY).items()) + " else 0 end"
_SCORES = f"""
{_CHUNKS},
tf as (select rid, pos, b, count(*) as tf from (
         select rid, pos, cast('0x' || substr(md5(term), 1, 4) as int) % {R.BUCKETS} as b from (
           select rid, pos, unnest(regexp_extract_all(lower(chunk), '[\\p{{L}}\\p{{N}}_]{{2,}}')) as term
           from chunks)) group by all),
dfs as (select b, count(*) as df from tf group by b),
every as (select range as b, coalesce(df, 0) as df from range({R.BUCKETS}) left join dfs on range = b),
vocab as (select b, idf, {_ASKED} * idf as q from (
            select b, ln((1.0::double + (select count(*) from chunks)) / (1 + df)) + 1 as idf from every)),
sums as (select rid, pos, sum(tf * idf * tf * idf) as ww, sum(tf * idf * q) as wq
         from tf join vocab using (b) group by all),
scores as (select rid, doc_id, pos, chunk,
             round(coalesce(wq / nullif(sqrt(ww) * (select sqrt(sum(q * q)) from vocab), 0), 0), 9) as cos
           from chunks left join sums using (rid, pos)),
kept as (select s.* from scores s join (select rid, round(avg(cos), 9) as m from scores group by rid)
         using (rid) where cos >= m)
"""


def _keyed(t: Tables):
    return t.derive(KEYED)


def _scores(t: Tables):
    scored = R.scored_chunks(_keyed(t), QUERY)
    return scored.select("doc_id", F.explode("scored").alias("c")).select("doc_id", "c.pos", "c.cos")


@query(
    "r1_chunks",
    f"with {_CHUNKS} select doc_id, cast(pos as int) as pos, md5(chunk) as chunk_md5 from chunks",
)
def _(t: Tables):
    return R.chunk_rows(_keyed(t), "doc_id").select("doc_id", "pos", F.md5("chunk").alias("chunk_md5"))


@query(
    "r2_chunk_scores",
    f"with {_SCORES} select doc_id, cast(pos as int) as pos, cos from scores",
)
def _(t: Tables):
    return _scores(t)


_QVEC = "q as (select embedding::double[] as q from @embeddings where vec_id = 0)"
_DIST = "sqrt(list_sum(list_transform(list_zip(embedding, q.q), lambda p: (p[1]::double - p[2]) ** 2)))"
_COS = "list_cosine_similarity(embedding::double[], q.q)"


def _query_vector(t: Tables):
    return t.embeddings.where("vec_id = 0").select("embedding").scalar()


@query(
    "r3_cosine",
    f"with {_QVEC} select vec_id, round({_COS}, 6) as cos from @embeddings, q",
)
def _(t: Tables):
    asked = t.embeddings.withColumn("q", _query_vector(t))
    return asked.select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("cos"))


@query(
    "r4_euclidean",
    f"with {_QVEC} select vec_id, round({_DIST}, 6) as dist from @embeddings, q",
)
def _(t: Tables):
    asked = t.embeddings.withColumn("q", _query_vector(t))
    return asked.select("vec_id", F.round(euclidean(F.col("embedding"), F.col("q")), 6).alias("dist"))


@query(
    "r5_combined_score",
    f"""with {_QVEC} select vec_id, round(0.7::double * {_COS} - 0.3::double * {_DIST}, 6) as score
        from @embeddings, q""",
)
def _(t: Tables):
    scored = R.vector_scores(t.embeddings, "embedding", _query_vector(t))
    return scored.select("vec_id", F.round("score", 6).alias("score"))


@query(
    "r6_above_group_mean",
    f"""with {_QVEC}, s as (select vec_id, label, {_COS} as cos from @embeddings, q),
        m as (select label, round(avg(cos), 9) as m from s group by label)
    select vec_id, label, round(cos, 6) as cos from s join m using (label) where round(cos, 9) >= m""",
)
def _(t: Tables):
    scored = R.vector_scores(t.embeddings, "embedding", _query_vector(t))
    kept = R.above_group_mean(scored.select("vec_id", "label", "cos"), "label", "cos")
    return kept.select("vec_id", "label", F.round("cos", 6).alias("cos"))


@query(
    "r7_reassembled_text",
    f"""with {_SCORES}, a as (select rid, count(*) as n_kept, string_agg(chunk, chr(10) order by pos) as x
                              from kept group by rid)
    select d.doc_id, coalesce(n_kept, 0) as n_kept, md5(coalesce(x, '')) as text_md5
    from docs d left join a using (rid)""",
)
def _(t: Tables):
    scored = R.scored_chunks(_keyed(t), QUERY).withColumn("kept", R.mean_filter(F.col("scored")))
    text = R.assemble(F.col("text"), F.col("kept"))
    return scored.select("doc_id", F.size("kept").cast("long").alias("n_kept"), F.md5(text).alias("text_md5"))


@query(
    "r8_filtered_documents",
    f"""with {_SCORES}, a as (select rid, string_agg(chunk, chr(10) order by pos) as x
                              from kept group by rid)
    select d.doc_id, lang, coalesce(x, '') as filtered_text from docs d left join a using (rid)""",
)
def _(t: Tables):
    out = R.filter_documents(_keyed(t), "text", QUERY)
    return out.select("doc_id", "lang", "filtered_text")


@query(
    "r9_above_percentile",
    f"""with {_QVEC}, s as (select vec_id, 0.7::double * {_COS} - 0.3::double * {_DIST} as score
                            from @embeddings, q),
        b as (select round(quantile_cont(score, 0.7), 9) as b from s)
    select vec_id, round(score, 6) as score from s, b where round(score, 9) >= b""",
)
def _(t: Tables):
    scored = R.vector_scores(t.embeddings, "embedding", _query_vector(t))
    kept = R.above_percentile(scored.select("vec_id", "score"), "score", 0.7)
    return kept.select("vec_id", F.round("score", 6).alias("score"))


@query(
    "r9_chunks_above_percentile",
    f"""with {_SCORES}, b as (select round(quantile_cont(cos, 0.7), 9) as b from scores)
    select doc_id, cast(pos as int) as pos, cos from scores, b where cos >= b""",
)
def _(t: Tables):
    scores = written(_scores(t), "chunk-scores")
    return R.above_percentile(scores, "cos", 0.7)


@query(
    "flagship_relevant_text",
    f"""with {_SCORES}, a as (select rid, count(*) as n_kept, string_agg(chunk, chr(10) order by pos) as x
                              from kept group by rid),
      n as (select rid, count(*) as n_chunks from chunks group by rid),
      f as (select d.rid, d.lang, l.quality, coalesce(n_kept, 0) as n_kept,
                   coalesce(n_chunks, 0) as n_chunks, length(coalesce(x, '')) as kept_chars
            from docs d left join a using (rid) left join n using (rid)
                 left join @labels l on d.doc_id = l.doc_id)
    select lang, count(*) as n_docs, cast(sum(n_chunks) as bigint) as n_chunks,
           cast(sum(n_kept) as bigint) as n_kept, cast(sum(kept_chars) as bigint) as kept_chars,
           round(100.0::double * count(quality) / count(*), 6) as labelled_pct
    from f group by lang""",
)
def _(t: Tables):
    """Relevant text per language, with the share of labelled documents."""
    kept = R.filter_documents(_keyed(t), "text", QUERY)
    flat = kept.select(
        "doc_id",
        "lang",
        F.coalesce(F.size("kept"), F.lit(0)).alias("n_kept"),
        F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
        F.length("filtered_text").alias("kept_chars"),
    )
    return (
        flat.join(t.labels.select("doc_id", "quality"), "doc_id", "left")
        .groupBy("lang")
        .agg(
            F.count("*").alias("n_docs"),
            F.sum("n_chunks").alias("n_chunks"),
            F.sum("n_kept").alias("n_kept"),
            F.sum("kept_chars").alias("kept_chars"),
            F.round(100.0 * F.count("quality") / F.count("*"), 6).alias("labelled_pct"),
        )
    )
