"""Queries over modelling and its reports."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sheaf.functions import chemistry
from sheaf.operators import linear
from sheaf.operators import modelling as M
from sheaf.operators import neighbours as N
from sheaf.operators.relevance import train_test
from sheaf.plans.registry import Tables, query
from sheaf.session import written

NUMERIC = ("l_quantity", "l_discount", "l_tax")
MODEL_ROWS = """
select l_orderkey * 1000 + l_linenumber as id, l_quantity, l_discount, l_tax, l_returnflag,
       l_extendedprice / 1000 as label from @lineitem
"""


def _features(t: Tables):
    """One split for all models, written before the vectors are built."""
    split = written(train_test(t.derive(MODEL_ROWS), "id"), "regression-rows")
    rows = M.assembled(split, NUMERIC, ("l_returnflag",), train=F.expr("not is_test"))
    return rows.select("label", "features", "is_test")


def _fit(t: Tables, name: str):
    rows = _features(t)
    train = rows.where("not is_test")
    model = M.regressors(scale=M.ridge_scale(train))[name].fit(train)
    return M.regression_metrics(model.transform(rows.where("is_test"))).withColumn("model", F.lit(name))


_SPLIT = """
c as (select o_orderkey as id, case when o_orderkey % 97 = 5 then 'RARE' else o_orderpriority end as cat from @orders),
r as (select *, row_number() over (order by md5(id || '-42'), id) <= ceil((select count(*) from c) * 0.2::double) as is_test from c),
cats as (select distinct cat from r where not is_test)
"""


@query(
    "m1_one_hot",
    f"""with {_SPLIT} select k.cat as category, count(*) filter (where r.cat = k.cat) as n
        from cats k, r where is_test group by k.cat""",
)
def _(t: Tables):
    key = F.col("o_orderkey")
    cat = F.when(key % 97 == 5, "RARE").otherwise(F.col("o_orderpriority"))
    split = train_test(t.orders.select(key.alias("id"), cat.alias("cat")), "id")
    _, test, names = M.one_hot(split.where("not is_test"), split.where("is_test"), "cat")
    places = test.select(F.posexplode(vector_to_array("cat_hot")).alias("place", "hit"))
    sums = places.groupBy("place").agg(F.sum("hit").cast("bigint").alias("n"))
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("place") + 1)
    return sums.select(named.alias("category"), "n")


SMILES = """
select p_partkey, p_size, case p_size % 7
    when 0 then repeat('C', 1 + cast(floor(p_retailprice) as int) % 9) || '(=O)O'
    when 1 then 'c1ccccc1N' || repeat('C', p_size % 5)
    when 2 then '[NH3+]' || repeat('C', 1 + p_size % 4) || '[I-]'
    when 3 then 'O=C(O)c1ccc2ccccc2c1' || repeat('Cl', p_size % 3)
    when 4 then 'C1CC1Br' when 5 then '' else null end as smiles
from @part
"""
_ATOMS = "regexp_extract_all(smiles, '\\[[^\\]]*\\]|Br|Cl|[BCNOPSFIbcnops]')"
_HYDROGEN = "not regexp_matches(a, '^\\[[0-9]*H[+-]?\\]$')"


@query(
    "m2_structure_flags",
    f"""with s as ({SMILES}) select p_partkey,
      cast(coalesce(contains(smiles, 'C') and not regexp_matches(smiles, '\\[.*?\\]'), false) as int) as organic,
      cast(coalesce(regexp_matches(smiles, 'N|C\\(=O\\)O|OH|C=O'), false) as int) as functional_group_rich from s""",
)
def _(t: Tables):
    return M.structure_flags(t.derive(SMILES), "smiles").select(
        "p_partkey", "organic", "functional_group_rich"
    )


@query(
    "m3_flag_clusters",
    f"""with s as ({SMILES}), f as (select p_partkey,
      cast(coalesce(contains(smiles, 'C') and not regexp_matches(smiles, '\\[.*?\\]'), false) as int) as organic,
      cast(coalesce(regexp_matches(smiles, 'N|C\\(=O\\)O|OH|C=O'), false) as int) as rich from s where smiles is not null),
    r as (select *, row_number() over (order by md5(p_partkey || '-42'), p_partkey)
                 <= ceil((select count(*) from f) * 0.2::double) as is_test from f),
    -- two flags give four points at most, each of them a centre
    centres as (select organic as c_organic, rich as c_rich, cast(row_number() over (order by organic, rich) - 1 as int) as cluster
                from (select distinct organic, rich from r where not is_test)),
    placed as (select organic, rich, is_test, (select arg_min(cluster, {{'d': (c_organic - organic) ** 2 + (c_rich - rich) ** 2, 'i': cluster}})
               from centres) as cluster from r)
    select organic, rich as functional_group_rich, is_test, cluster, count(*) as n from placed group by all""",
)
def _(t: Tables):
    flags = M.structure_flags(t.derive(SMILES), "smiles").where("smiles is not null")
    split = train_test(flags, "p_partkey")
    train, test = M.flag_clusters(
        split.where("not is_test"), split.where("is_test"), ("organic", "functional_group_rich")
    )
    both = train.unionByName(test)
    return both.groupBy("organic", "functional_group_rich", "is_test", "cluster").agg(
        F.count("*").alias("n")
    )


@query(
    "m4_molecule_features",
    f"""with s as ({SMILES}) select p_partkey, smiles,
      case when smiles <> '' then len(list_filter({_ATOMS}, lambda a: {_HYDROGEN})) end as heavy_atoms,
      case when smiles <> '' then len(list_filter({_ATOMS}, lambda a: {_HYDROGEN}
           and not (a in ('C', 'c') or regexp_matches(a, '^\\[[0-9]*[Cc]([^a-z]|$)')))) end as hetero_atoms,
      case when smiles <> '' then len(regexp_extract_all(regexp_replace(smiles, '\\[[^\\]]*\\]', '', 'g'), '%[0-9][0-9]|[0-9]')) // 2 end as rings
    from s""",
)
def _(t: Tables):
    out = M.molecule_features(t.derive(SMILES).select("p_partkey", "smiles"), "smiles")
    return out.select("p_partkey", "smiles", "heavy_atoms", "hetero_atoms", "rings")


@query(
    "m5_assembled_features",
    """select cast(3 + count(distinct l_returnflag) + 1 as int) as n_features, count(*) as n,
              round(avg(l_quantity), 6) as mean_quantity from @lineitem""",
)
def _(t: Tables):
    rows = M.assembled(t.derive(MODEL_ROWS), NUMERIC, ("l_returnflag",))
    values = vector_to_array("features")
    return rows.groupBy(F.size(values).alias("n_features")).agg(
        F.count("*").alias("n"), F.round(F.avg(values[0]), 6).alias("mean_quantity")
    )


# Linear models in SQL: sums of the train rows by seed, then elimination for
# least squares and ridge, and coordinate descent for the lasso.
_X = ("l_quantity", "l_discount", "l_tax", "l_returnflag = 'A'", "l_returnflag = 'N'", "l_returnflag = 'R'")


def _linear_sql(seeds: str) -> str:
    p = len(_X)
    xs = [f"x{i}" for i in range(1, p + 1)]
    centred = ", ".join(f"cast({c} as double) - avg(cast({c} as double)) over () as {x}" for c, x in zip(_X, xs))
    sums = ", ".join(f"sum({x}) as s_{x}" for x in xs)
    grams = ", ".join(f"sum({a} * {b}) - sum({a}) * sum({b}) / count(*) as g_{a}{b}" for i, a in enumerate(xs) for b in xs[i:])
    cross = ", ".join(f"sum({x} * y) - sum({x}) * sum(y) / count(*) as c_{x}" for x in xs)

    def matrix(of, alpha: float) -> str:
        rows = [
            ", ".join(f"g_{min(a, b)}{max(a, b)}" + (f" + {alpha}" if a == b else "") for b in of) + f", c_{a}" for a in of
        ]
        return "[" + ", ".join(f"[{r}]" for r in rows) + "]::double[][]"

    # The last mark follows from the others, so least squares goes without it.
    starts = [("Linear Regression", xs[:-1], 0.0), ("Ridge", xs, 1.0)]
    eliminate = " union all ".join(f"select '{n}' as model, seed, 1 as k, {len(of)} as p, {matrix(of, a)} as m from t" for n, of, a in starts)
    return f"""
    with recursive d as (select id, {centred}, label - avg(label) over () as y from ({MODEL_ROWS})),
    seeds as ({seeds}),
    h as (select seed, d.*, md5(id || '-' || seed) as h from d, seeds),
    cut as (select seed, h as last from h qualify row_number() over (partition by seed order by h, id)
                 = ceil((select count(*) from d) * 0.2::double)),
    -- rows of one id stay on one side
    r as (select h.* exclude (h), h <= last as is_test from h join cut using (seed)),
    t as (select seed, count(*) as n, sum(y) as s_y, {sums}, {grams}, {cross} from r where not is_test group by seed),
    solved as ({eliminate} union all
      select model, seed, k + 1, p, list_transform(range(1, p + 1), lambda i: list_transform(range(1, p + 2), lambda j:
        case when i = k then m[k][j] / m[k][k] else m[i][j] - m[i][k] / m[k][k] * m[k][j] end)) from solved where k <= p),
    descent as (select seed, 0 as step, list_transform(range({p}), lambda i: 0.0::double) as w, n, {matrix(xs, 0.0)} as m from t
      union all
      select seed, step + 1, list_transform(range(1, {p + 1}), lambda i: case when i <> step % {p} + 1 then w[i] else
        (with_sign.rho / abs(with_sign.rho)) * greatest(abs(with_sign.rho) - n, 0) / m[i][i] end), n, m
      from (select *, m[step % {p} + 1][{p + 1}] - list_sum(list_transform(range(1, {p + 1}), lambda k:
              case when k = step % {p} + 1 then 0 else m[step % {p} + 1][k] * w[k] end)) as rho from descent) with_sign
      where step < {p * 60}),
    fits as (select model, seed, list_transform(range(1, {p + 1}), lambda i: coalesce(m[i][p + 1], 0)) as w from solved where k = p + 1
             union all select 'Lasso', seed, w from descent where step = {p * 60}),
    e as (select model, seed, y, y - (s_y / n + {" + ".join(f"w[{i}] * ({x} - s_{x} / n)" for i, x in enumerate(xs, 1))}) as missed
          from r join fits using (seed) join t using (seed) where is_test),
    scores as (select model, seed, 1 - sum(missed * missed) / (var_pop(y) * count(*)) as r2,
                      avg(abs(missed)) as mae, avg(missed * missed) as mse from e group by all)
    """


def _rounded(metrics):
    return metrics.select("Model", "Seed", *[F.round(c, 6).alias(c) for c in ("R2", "MAE", "MSE")])


def _linear_rows(t: Tables):
    rows = M.assembled(t.derive(MODEL_ROWS), NUMERIC, ("l_returnflag",))
    return rows.select("id", "label", "features")


_SCORES = 'round(r2, 6) as "R2", round(mae, 6) as "MAE", round(mse, 6) as "MSE"'


@query(
    "m6_repeated_splits",
    _linear_sql("select cast(range as int) as seed from range(1000) order by md5(range || '-42'), range limit 100")
    + f' select model as "Model", seed as "Seed", {_SCORES} from scores',
)
def _(t: Tables):
    """100 splits for each of the three linear models."""
    return _rounded(linear.repeated_fits(_linear_rows(t), "id", M.seeds(t.spark, 100))[0])


for _id, _name in (("m9_linear", "Linear Regression"), ("m9_ridge", "Ridge"), ("m9_lasso", "Lasso")):
    query(_id, _linear_sql("select 42 as seed") + f" select model, {_SCORES} from scores where model = '{_name}'")(
        lambda t, name=_name: _rounded(
            linear.repeated_fits(_linear_rows(t), "id", [42], {name: linear.SOLVERS[name]})[0]
        ).select(F.col("Model").alias("model"), "R2", "MAE", "MSE")
    )


@query(
    "m7_sampled_ids",
    "select o_custkey from (select distinct o_custkey from @orders) order by md5(o_custkey || '-42'), o_custkey limit 100",
)
def _(t: Tables):
    return M.sample_ids(t.orders, "o_custkey", 100)


for _id, _name in (
    ("m8_random_forest", "Random Forest"),
    ("m10_gradient_boosting", "Gradient Boosting"),
    ("m11_adaboost", "AdaBoost"),
):
    query(_id)(lambda t, name=_name: _fit(t, name))


@query("m12_grid_search")
def _(t: Tables):
    rows = _features(t)
    train = rows.where("not is_test")
    estimator, grid = M.regressor_grids(scale=M.ridge_scale(train))["Ridge"]
    best = M.search(train, estimator, grid).bestModel
    scored = best.transform(rows.where("is_test"))
    return M.regression_metrics(scored).withColumn("reg_param", F.lit(best.getRegParam()))


_KNN_SPLIT = """
e as (select vec_id, embedding::double[] as v, label, row_number() over (order by md5(vec_id || '-42'), vec_id)
             <= ceil((select count(*) from @embeddings) * 0.2::double) as is_test from @embeddings),
d as (select q.vec_id, t.vec_id as t, t.label as y, {dist} as dist from e q, e t where q.is_test and not t.is_test),
near as (select * from d qualify row_number() over (partition by vec_id order by dist, t) <= 5)
"""
_L2 = "sqrt(list_sum(list_transform(list_zip(q.v, t.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
_L1 = "list_sum(list_transform(list_zip(q.v, t.v), lambda p: abs(p[1] - p[2])))"


def _knn_sides(t: Tables):
    split = train_test(t.embeddings, "vec_id")
    return split.where("not is_test"), split.where("is_test")


@query(
    "m13_knn_regression",
    f"with {_KNN_SPLIT.format(dist=_L2)} select vec_id, round(avg(y), 6) as prediction from near group by vec_id",
)
def _(t: Tables):
    train, test = _knn_sides(t)
    out = N.knn_regression(train, test, "vec_id", "vec_id", "embedding", "label")
    return out.select("vec_id", F.round("prediction", 6).alias("prediction"))


@query(
    "m13_knn_weighted_manhattan",
    f"""with {_KNN_SPLIT.format(dist=_L1)} select vec_id, round(coalesce(avg(y) filter (where dist = 0),
        sum(y / nullif(dist, 0)) / sum(1 / nullif(dist, 0))), 6) as prediction from near group by vec_id""",
)
def _(t: Tables):
    train, test = _knn_sides(t)
    out = N.knn_regression(train, test, "vec_id", "vec_id", "embedding", "label", p=1, weights="distance")
    return out.select("vec_id", F.round("prediction", 6).alias("prediction"))


@query("m12_knn_search")
def _(t: Tables):
    rows = t.embeddings.select("vec_id", "embedding", "label")
    out = N.knn_search(rows, "vec_id", "embedding", "label", ks=(3, 5, 10, 20))
    return out.withColumn("R2", F.round("R2", 6))


@query(
    "m14_regression_metrics",
    """select l_returnflag as model, round(1 - sum((l_extendedprice - p) ** 2) / (var_pop(l_extendedprice) * count(*)), 6) as "R2",
       round(avg(abs(l_extendedprice - p)), 4) as "MAE", round(avg((l_extendedprice - p) ** 2) / 1000000, 4) as "MSE"
       from (select *, l_extendedprice * (1 + l_tax) as p from @lineitem) group by 1""",
)
def _(t: Tables):
    rows = t.lineitem.select(
        F.col("l_returnflag").alias("model"),
        F.col("l_extendedprice").alias("label"),
        (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("prediction"),
    )
    out = M.regression_metrics(rows, by=["model"])
    return out.select(
        "model", F.round("R2", 6).alias("R2"), F.round("MAE", 4).alias("MAE"), F.round(F.col("MSE") / 1000000, 4).alias("MSE")
    )


@query("m15_feature_importance")
def _(t: Tables):
    rows = M.assembled(t.derive(MODEL_ROWS), NUMERIC, ("l_returnflag",))
    model = M.regressors()["Gradient Boosting"].fit(rows)
    return M.importances(model, rows, derived=("l_tax",), names={"l_quantity": "Quantity"})


@query(
    "m16_residuals",
    """select l_returnflag as model, count(*) as n, round(avg(p - l_extendedprice), 4) as mean_residual
       from (select *, l_extendedprice * (1 + l_tax) as p from @lineitem) group by 1""",
)
def _(t: Tables):
    rows = t.lineitem.select(
        F.col("l_returnflag").alias("model"),
        F.col("l_extendedprice").alias("label"),
        (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("prediction"),
    )
    return M.residuals(rows).groupBy("model").agg(
        F.count("*").alias("n"), F.round(F.avg("residual"), 4).alias("mean_residual")
    )


METRICS = """
select l_returnflag as "Model", l_suppkey as "Seed", avg(l_discount) as "R2", avg(l_tax) as "MAE", avg(l_quantity) as "MSE"
from @lineitem group by l_returnflag, l_suppkey
"""


def _metrics(t: Tables):
    return t.lineitem.groupBy(F.col("l_returnflag").alias("Model"), F.col("l_suppkey").alias("Seed")).agg(
        F.avg("l_discount").alias("R2"), F.avg("l_tax").alias("MAE"), F.avg("l_quantity").alias("MSE")
    )


@query(
    "m17_mean_metrics",
    f"""with m as ({METRICS}) select "Model", round(avg("R2"), 9) as "R2", round(avg("MAE"), 9) as "MAE",
        round(avg("MSE"), 9) as "MSE" from m group by 1""",
)
def _(t: Tables):
    out = M.mean_metrics(_metrics(t))
    return out.select("Model", *[F.round(c, 9).alias(c) for c in ("R2", "MAE", "MSE")])


@query(
    "m18_approach_table",
    """with s as (select l_returnflag as model, l_linestatus as metric, l_linenumber as a, avg(l_extendedprice) as score
                  from @lineitem group by all)
    select model, metric, """
    + ", ".join(f"round(max(score) filter (where a = {a}), 2) as approach_{a}" for a in range(1, 5))
    + " from s group by model, metric",
)
def _(t: Tables):
    scores = t.lineitem.groupBy(
        F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("metric"), F.col("l_linenumber").alias("approach")
    ).agg(F.avg("l_extendedprice").alias("score"))
    return M.approach_table(scores, (1, 2, 3, 4))


@query(
    "u2_row_function",
    """select l_linenumber, sum(case when l_discount > l_tax then l_quantity else -l_quantity end) as balance
       from @lineitem group by 1""",
)
def _(t: Tables):
    signed = F.when(F.col("l_discount") > F.col("l_tax"), F.col("l_quantity")).otherwise(-F.col("l_quantity"))
    return t.lineitem.groupBy("l_linenumber").agg(F.sum(signed).alias("balance"))


@query(
    "u3_many_columns_function",
    f"""with s as ({SMILES}) select smiles, count(*) as n,
      cast(coalesce(contains(smiles, 'C') and not regexp_matches(smiles, '\\[.*?\\]'), false) as int) as organic,
      cast(coalesce(regexp_matches(smiles, 'N|C\\(=O\\)O|OH|C=O'), false) as int) as rich from s group by smiles""",
)
def _(t: Tables):
    flags = F.struct(
        chemistry.is_organic(F.col("smiles")).alias("organic"),
        chemistry.is_functional_rich(F.col("smiles")).alias("rich"),
    )
    counted = t.derive(SMILES).groupBy("smiles").agg(F.count("*").alias("n"))
    return counted.select("smiles", "n", flags.alias("s")).select("smiles", "n", "s.*")
