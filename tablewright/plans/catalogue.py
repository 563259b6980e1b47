"""The catalogue of queries on the fixture tables, and the SQL that says the same.

Money is summed in whole cents, so that sums do not depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import metrics as M
from ..operators import dataset as D
from ..operators import experiment as R
from ..operators import features as X
from ..operators import models as E
from ..operators import profile as P
from ..operators import search as S
from ..operators.boosting import BoostedTrees
from ..operators.time_folds import rolling_origin, time_folds
from ..sources.io import records, table

#: Threshold of a positive order, in units of money; a tenth of the orders.
LARGE = 450000
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
RULES = {"l_quantity": "standardise", "l_extendedprice": "maxabs", "l_discount": "skip", "l_tax": "skip"}
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = (f, sql)
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in QUERIES.items() if s is not None}


def cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


def positive():
    return (F.col("o_totalprice") >= LARGE).cast("long")


# --- target encoding ---------------------------------------------------------------------------


@query("target_encode_loo", f"select o_orderkey, o_custkey, cast(sum(y) over w - y as double) / nullif(count(*) over w - 1, 0) as loo from (select *, cast(o_totalprice >= {LARGE} as bigint) as y from orders) window w as (partition by o_custkey)")
def target_encode_loo(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", positive().alias("y"))
    return X.leave_one_out(rows, "o_custkey", F.col("y"), "loo").drop("y")


@query("target_encode_loo_mean", "select o_orderkey, o_custkey, cast(sum(y) over w - y as double) / nullif(count(*) over w - 1, 0) / 100 as loo_mean from (select *, cast(round(o_totalprice * 100) as bigint) as y from orders) window w as (partition by o_custkey)")
def target_encode_loo_mean(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", cents("o_totalprice").alias("y"))
    return X.leave_one_out(rows, "o_custkey", F.col("y"), "loo_mean").select("o_orderkey", "o_custkey", (F.col("loo_mean") / 100).alias("loo_mean"))


SPLIT = "select *, row_number() over (order by md5('42|' || cast(o_orderkey as varchar)), o_orderkey) <= ceil(0.3 * count(*) over ()) as is_test from orders"


def split_orders(spark, d, *columns):
    return D.split_train_test(table(spark, d, "orders").select("o_orderkey", *columns), "o_orderkey")


@query("target_encode_apply", f"with s as ({SPLIT}), m as (select o_custkey, cast(sum(cast(o_totalprice >= {LARGE} as bigint)) as double) / count(*) as encoded from s where not is_test group by 1) select o_orderkey, s.o_custkey, encoded from s left join m on s.o_custkey = m.o_custkey where is_test")
def target_encode_apply(spark, d):
    s = split_orders(spark, d, "o_custkey", "o_totalprice")
    means = X.fit_group_means(s.filter("not is_test"), "o_custkey", positive(), "encoded")
    return X.apply_group_means(s.filter("is_test"), means, "o_custkey").select("o_orderkey", "o_custkey", "encoded")


# --- dataset -----------------------------------------------------------------------------------

MISSING = "select o_orderkey, o_custkey, case when o_orderkey % 11 = 0 then null when o_orderkey % 7 = 0 then 0 else o_totalprice end as price from orders"


def with_missing(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(k % 11 == 0, None).when(k % 7 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("price"))


@query("clean_dropna", f"select * from ({MISSING}) where price is not null")
def clean_dropna(spark, d):
    return D.drop_missing(with_missing(spark, d))


@query("drop_zero_target", f"select * from ({MISSING}) where price > 0")
def drop_zero_target(spark, d):
    return D.drop_missing(with_missing(spark, d)).filter("price > 0")


@query("sample_exact_n", "select o_orderkey, o_custkey from orders order by md5('23|' || cast(o_orderkey as varchar)), o_orderkey limit 500")
def sample_exact_n(spark, d):
    return D.sample_exact(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 500, seed=23)


@query("split_train_test", f"select o_orderkey, is_test from ({SPLIT})")
def split_train_test(spark, d):
    return split_orders(spark, d)


@query("fold_assignment", "select o_orderkey, cast(cast('0x' || substr(md5('42|' || cast(o_orderkey as varchar)), 1, 6) as bigint) % 3 as integer) as fold from orders")
def fold_assignment(spark, d):
    return table(spark, d, "orders").select("o_orderkey", D.fold_of("o_orderkey", 3).alias("fold"))


@query("label_threshold", "select event_id, case when value >= 150 then 'popular' else 'unpopular' end as popularity_class from events")
def label_threshold(spark, d):
    return table(spark, d, "events").select("event_id", D.label("value", 150).alias("popularity_class"))


@query("class_balance", "select case when value >= 150 then 'popular' else 'unpopular' end as popularity_class, count(*) as n, round(100.0 * count(*) / (select count(*) from events), 2) as percent from events group by 1")
def class_balance(spark, d):
    counts = table(spark, d, "events").groupBy(D.label("value", 150).alias("popularity_class")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).select("popularity_class", "n", F.round(100.0 * F.col("n") / F.col("all"), 2).alias("percent"))  # one row


@query("derive_project_drop", "select l_orderkey, l_linenumber, l_extendedprice / 60000 as price_units, l_quantity from lineitem")
def derive_project_drop(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return rows.withColumn("price_units", F.col("l_extendedprice") / 60000).drop("l_extendedprice")


@query("interaction_log1p", "select l_orderkey, l_linenumber, round(l_quantity * l_discount * ln(1 + l_extendedprice), 6) as interaction from lineitem")
def interaction_log1p(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") * F.col("l_discount") * F.log1p("l_extendedprice"), 6).alias("interaction"))


@query("impute_mean", f"with o as ({MISSING}), m as (select cast(sum(cast(round(price * 100) as bigint)) as double) / count(price) / 100 as mean from o) select o_orderkey, coalesce(price, mean) as price, cast(price is null as integer) as price_missing from o, m")
def impute_mean(spark, d):
    rows = with_missing(spark, d).select("o_orderkey", "price")
    mean = rows.agg((F.sum(cents("price")).cast("double") / F.count("price") / 100).alias("mean"))  # one row
    return rows.crossJoin(F.broadcast(mean)).select("o_orderkey", F.coalesce("price", "mean").alias("price"), F.col("price").isNull().cast("int").alias("price_missing"))


# --- exploration -------------------------------------------------------------------------------


@query("describe_numeric", " union all ".join(f"select '{c}' as \"column\", count({c}) as n, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, min({c}) as low, quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.5) as median, quantile_cont({c}, 0.75) as q3, max({c}) as high from lineitem" for c in NUMERIC))
def describe_numeric(spark, d):
    return P.describe(table(spark, d, "lineitem").select(*NUMERIC), NUMERIC).withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("null_profile", " union all ".join(f"select '{c}' as \"column\", count({c}) as non_null, count(*) - count({c}) as nulls from ({MISSING})" for c in ("o_orderkey", "o_custkey", "price")))
def null_profile(spark, d):
    return P.null_profile(with_missing(spark, d))


PAIRS = " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from lineitem" for a in NUMERIC for b in NUMERIC)


def pairs(spark, d):
    return P.correlations(table(spark, d, "lineitem").select(*NUMERIC), NUMERIC).withColumn("r", F.round("r", 6))


@query("corr_matrix_long", PAIRS)
def corr_matrix_long(spark, d):
    return pairs(spark, d)


@query("corr_with_target", f"select b as feature, r from ({PAIRS}) where a = 'l_quantity' order by r desc, b")
def corr_with_target(spark, d):
    return pairs(spark, d).filter("a = 'l_quantity'").select(F.col("b").alias("feature"), "r").orderBy(F.desc("r"), "feature")


@query("corr_strong_pairs", f"select * from ({PAIRS}) where (r >= 0.001 and r < 1) or (r <= -0.001 and r > -1)")
def corr_strong_pairs(spark, d):
    return P.strong_pairs(pairs(spark, d), 0.001)


@query("histogram_50", "with e as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem) select cast(least(floor((l_extendedprice - lo) / ((hi - lo) / 50)), 49) as bigint) as bin, count(*) as n from lineitem, e group by 1")
def histogram_50(spark, d):
    return P.histogram(table(spark, d, "lineitem").select("l_extendedprice"), "l_extendedprice")


@query("value_counts", "select event_type, count(*) as n from events group by 1 order by n desc, event_type")
def value_counts(spark, d):
    return P.value_counts(table(spark, d, "events"), "event_type")


@query("top_rows", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 5")
def top_rows(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5)


@query("bottom_rows", "select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey desc limit 5")
def bottom_rows(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", F.desc("o_orderkey")).limit(5)


# --- scaling -----------------------------------------------------------------------------------


def scale_query(name, rules, sql):
    @query(name, f"with s as (select {', '.join(f'{c} as {n}_c, {s} as {n}_s' for n, (c, s) in sql.items())} from lineitem) select l_orderkey, l_linenumber, {', '.join(f'round(({n} - {n}_c) / {n}_s, 6) as {n}' for n in sql)} from lineitem, s")
    def run(spark, d):
        rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *rules)
        return rows.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(n) for n, c in zip(rules, X.scaled(X.scales(rows, rules)), strict=True)])


_SQL_SCALES = {"standardise": lambda n: (f"avg({n})", f"stddev_pop({n})"), "maxabs": lambda n: ("0", f"max(abs({n}))"), "minmax": lambda n: (f"min({n})", f"max({n}) - min({n})"), "skip": lambda n: ("0", "1")}
for _name, _rules in (("scale_standard", dict.fromkeys(NUMERIC, "standardise")), ("scale_maxabs", dict.fromkeys(NUMERIC, "maxabs")), ("scale_minmax", dict.fromkeys(NUMERIC[1:], "minmax")), ("normalise_by_rule", RULES)):
    scale_query(_name, _rules, {n: _SQL_SCALES[r](n) for n, r in _rules.items()})


@query("one_hot", "select l_orderkey, l_linenumber, " + ", ".join(f"cast(l_returnflag is not distinct from '{v}' as integer) as \"l_returnflag_{v}\"" for v in ("A", "N", "R")) + " from lineitem")
def one_hot(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *X.one_hot("l_returnflag", ["A", "N", "R"]))


# --- evaluation --------------------------------------------------------------------------------
# The "models" here are plain SQL: the mean of the training rows' customer, or of all of them. Values are in units of money.

PREDICTED = f"""select o_orderkey, o_totalprice as y, coalesce(g, a) as p from (select * from ({SPLIT}) where is_test) t
    left join (select o_custkey as k, cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / count(*) / 100 as g from ({SPLIT}) where not is_test group by 1) m on t.o_custkey = m.k,
    (select cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / count(*) / 100 as a from ({SPLIT}) where not is_test)"""
CLASSES = f"select o_orderkey, case when y >= 300000 then 'high' else 'low' end as truth, case when p >= 300000 then 'high' else 'low' end as predicted from ({PREDICTED})"


def predicted(train: DataFrame, test: DataFrame) -> DataFrame:
    means = X.fit_group_means(train, "o_custkey", cents("o_totalprice"), "g")
    everyone = train.agg((F.sum(cents("o_totalprice")).cast("double") / F.count("*")).alias("a"))  # one row
    joined = X.apply_group_means(test, means, "o_custkey").crossJoin(F.broadcast(everyone))
    return joined.select("o_orderkey", F.col("o_totalprice").alias("y"), (F.coalesce("g", "a") / 100).alias("p"))


def predictions(spark, d):
    s = split_orders(spark, d, "o_custkey", "o_totalprice")
    return predicted(s.filter("not is_test"), s.filter("is_test"))


def classes(spark, d):
    p = predictions(spark, d)
    return p.select("o_orderkey", D.label("y", 300000, "high", "low").alias("truth"), D.label("p", 300000, "high", "low").alias("predicted"))


@query("confusion_matrix", f"with c as ({CLASSES}), l as (select 'high' as x union all select 'low') select a.x as truth, b.x as prediction, count(c.truth) as n from l a cross join l b left join c on c.truth = a.x and c.predicted = b.x group by 1, 2")
def confusion_matrix(spark, d):
    return M.confusion_matrix(classes(spark, d), "truth", "predicted")


_REPORT = f"""with c as ({CLASSES}), l as (select 'high' as x union all select 'low'),
    n as (select x, count(*) filter (truth = x and predicted = x) as h, count(*) filter (truth = x) as s, count(*) filter (predicted = x) as p from l, c group by x),
    r as (select x as label, coalesce(h / nullif(p, 0), 0.0) as precision, coalesce(h / nullif(s, 0), 0.0) as recall, coalesce(2 * h / nullif(p + s, 0), 0.0) as f1, s as support, h from n),
    o as (select label, precision, recall, f1, support from r
        union all select 'accuracy', sum(h) / sum(support), sum(h) / sum(support), sum(h) / sum(support), sum(support) from r
        union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from r
        union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) from r)
    select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, cast(support as bigint) as support from o"""


@query("classification_report", _REPORT)
def classification_report(spark, d):
    r = M.classification_report(classes(spark, d), "truth", "predicted")
    return r.select("label", *[F.round(n, 6).alias(n) for n in ("precision", "recall", "f1")], "support")


@query("binary_metrics", f"""with c as ({CLASSES}), n as (select count(*) as a, count(*) filter (truth = 'high') as y, count(*) filter (predicted = 'high') as p, count(*) filter (truth = 'high' and predicted = 'high') as h, count(*) filter (truth = 'low' and predicted = 'low') as l from c)
    select round((h + l) / a, 6) as accuracy, round((h / y + l / (a - y)) / 2, 6) as "balancedAccuracy", round(h / p, 6) as "precision", round(h / y, 6) as recall, round(2 * h / (y + p), 6) as "F1" from n""")
def binary_metrics(spark, d):
    out = M.evaluate(classes(spark, d), M.classification("high"), "truth", "predicted")
    return out.select(*[F.round(n, 6).alias(n) for n in out.columns])


_REGRESSION = 'round(avg(abs(y - p)), 4) as "MAE", round(avg((y - p) * (y - p)) / 1e6, 4) as "MSE", round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) as "R2", round(sqrt(avg((y - p) * (y - p))), 4) as "RMSE", round(sqrt(avg((y - p) * (y - p)) / var_pop(y)), 6) as "RRSE", round(stddev_pop(abs(y - p)), 4) as "StdDevAE"'


def rounded(df: DataFrame) -> DataFrame:
    """MSE in millions, so that rounding leaves as many digits as for the others."""
    digits = {"R2": 6, "RRSE": 6}
    return df.select(*[F.round(F.col(n) / 1e6 if n == "MSE" else F.col(n), digits.get(n, 4)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


@query("regression_metrics", f"select {_REGRESSION} from ({PREDICTED})")
def regression_metrics(spark, d):
    return rounded(M.evaluate(predictions(spark, d), M.REGRESSION, "y", "p"))


@query("rel_freq_within", f'select avg(cast(abs(y - p) <= 100000 as integer)) as "RelFreqErrWithin[100000]" from ({PREDICTED})')
def rel_freq_within(spark, d):
    return M.evaluate(predictions(spark, d), (M.rel_freq_within(100000),), "y", "p")


def _models_sql() -> str:
    mean = f"select o_orderkey, o_totalprice as y, (select cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / count(*) / 100 from ({SPLIT}) where not is_test) as p from ({SPLIT}) where is_test"
    return f"select 'customer_mean' as model, {_REGRESSION} from ({PREDICTED}) union all select 'global_mean' as model, {_REGRESSION} from ({mean})"


def board(spark, d):
    s = split_orders(spark, d, "o_custkey", "o_totalprice")

    def group(train):
        return lambda test: predicted(train, test)

    def constant(train):
        mean = train.agg((F.sum(cents("o_totalprice")).cast("double") / F.count("*") / 100).alias("p"))  # one row
        return lambda test: test.crossJoin(F.broadcast(mean)).select("o_orderkey", F.col("o_totalprice").alias("y"), "p")

    return rounded(E.compare({"customer_mean": group, "global_mean": constant}, s.filter("not is_test"), s.filter("is_test"), (M.r2(), *[m for m in M.REGRESSION if m.name != "R2"]), "y", "p"))


@query("leaderboard", f'select * from ({_models_sql()}) order by "R2" desc, model')
def leaderboard(spark, d):
    return board(spark, d)


@query("best_model", f'select model, "R2" from ({_models_sql()}) order by "R2" desc, model limit 1')
def best_model(spark, d):
    return board(spark, d).select("model", "R2").orderBy(F.desc("R2"), "model").limit(1)


FOLDED = "select *, cast('0x' || substr(md5('42|' || cast(o_orderkey as varchar)), 1, 6) as bigint) % 3 as fold from orders"
_FOLDS = " union all ".join(f"select avg(abs(o_totalprice - p)) as mae, sqrt(avg((o_totalprice - p) * (o_totalprice - p))) as rmse from ({FOLDED}) t, (select cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / count(*) / 100 as p from ({FOLDED}) where fold <> {i}) where fold = {i}" for i in range(3))


@query("cv_metric_summary", f'select round(avg(mae), 4) as "mean[MAE]", round(stddev_pop(mae), 4) as "std[MAE]", round(avg(rmse), 4) as "mean[RMSE]", round(stddev_pop(rmse), 4) as "std[RMSE]" from ({_FOLDS})')
def cv_metric_summary(spark, d):
    def constant(train):
        mean = train.agg((F.sum(cents("o_totalprice")).cast("double") / F.count("*") / 100).alias("p"))  # one row
        return lambda test: test.crossJoin(F.broadcast(mean))

    out = E.cross_validate(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 3, constant, (M.mae(), M.rmse()), "o_totalprice", "p")
    return out.select(*[F.round(F.col(f"`{n}`"), 4).alias(n) for n in out.columns])


@query("regressor_as_classifier", f"select o_orderkey, case when p >= 300000 then 'high' else 'low' end as predicted_class, case when p >= 300000 then 1.0 else 0.0 end::double as p_high, case when p >= 300000 then 0.0 else 1.0 end::double as p_low from ({PREDICTED})")
def regressor_as_classifier(spark, d):
    return predictions(spark, d).select("o_orderkey", *E.regressor_as_classifier("p", 300000, "high", "low"))


@query("nearest_neighbour_1", "select query_key, neighbour_key, neighbour_target from (select q.p_partkey as query_key, t.p_partkey as neighbour_key, t.p_retailprice as neighbour_target, row_number() over (partition by q.p_partkey order by (q.p_size - t.p_size) * (q.p_size - t.p_size)::double + (q.p_retailprice - t.p_retailprice) * (q.p_retailprice - t.p_retailprice), t.p_partkey) as k from part q, part t where q.p_partkey % 50 = 0 and q.p_partkey <> t.p_partkey) where k = 1")
def nearest_neighbour_1(spark, d):
    """The rows whose key is divisible by 50, against all rows."""
    part = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return E.nearest_neighbour(part.filter("p_partkey % 50 = 0"), part, "p_partkey", ["p_size", "p_retailprice"], "p_retailprice")


# --- models, by their metrics on held-out rows (no SQL: rows only) --------------------------------


def model_rows(spark, d, classify: bool):
    rows = table(spark, d, "lineitem").select("l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", F.md5(F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate")).alias("row"), ((F.col("l_quantity") >= 45).cast("double") if classify else F.col("l_quantity")).alias("target"))
    test = F.conv(F.substring("row", 1, 6), 16, 10).cast("long") % 10 < 3
    train = rows.filter(~test)
    return train, rows.filter(test), train.count()


REGISTRY = X.Registry()
REGISTRY.register("price", lambda: X.FeatureSpec(("l_extendedprice",), rule="standardise"))
REGISTRY.register("rates", lambda: X.FeatureSpec(("l_discount", "l_tax"), rule="maxabs"))
REGISTRY.register("flags", lambda: X.FeatureSpec(("l_returnflag", "l_linestatus"), categorical=True))
#: The units that a model has by default; more can be added to them.
DEFAULT = ("price", "rates", "flags")


def learner(name: str, estimator, features: tuple[str, ...] = DEFAULT, add: tuple[str, ...] = (), **more) -> E.Learner:
    return E.Learner(name, estimator, tuple(REGISTRY.collect(*features, *add)), **more)


def model_query(kind: str, name: str, factory, classify: bool):
    @query(f"model_{kind}_{name}")
    def run(spark, d):
        train, test, _ = model_rows(spark, d, classify)
        fitted = learner(name, factory).fit(train)
        ms = M.classification(1.0) if classify else M.REGRESSION
        return M.evaluate(fitted.transform(test), ms, "target", "prediction").select(F.lit(name).alias("model"), "*")


for _n, _f in E.CLASSIFIERS.items():
    model_query("classifier", _n, _f, True)
for _n, _f in E.REGRESSORS.items():
    model_query("regressor", _n, _f, False)


def priced_orders(spark, d):
    """Orders with their price as target; the customer is the group of the encoder."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.dayofyear("o_orderdate").alias("day"), F.col("o_totalprice").alias("target"))
    units = (X.FeatureSpec(("day",), rule="standardise"), X.FeatureSpec(("o_orderpriority",), categorical=True))
    encoder = X.TargetEncoder("o_custkey", cents("target") / 100, "customer_mean")
    linear = E.REGRESSORS["linear_regression"]
    return rows, [E.Learner("linear", linear, units), E.Learner("linear_encoded", linear, units, (encoder,)), E.Learner("tree_encoded", E.REGRESSORS["decision_tree"], units, (encoder,))]


@query("compare_learners")
def compare_learners(spark, d):
    rows, learners = priced_orders(spark, d)
    return R.evaluate_learners(rows, "o_orderkey", learners)


@query("cross_validate_learner")
def cross_validate_learner(spark, d):
    rows, learners = priced_orders(spark, d)
    return R.cross_validate_learner(rows, "o_orderkey", learners[1])


TRAIN_LINES = "select * from lineitem where cast('0x' || substr(md5(l_orderkey || '|' || l_linenumber || '|' || l_partkey), 1, 6) as bigint) % 10 >= 3"


def train_lines(spark, d):
    rows = table(spark, d, "lineitem")
    return rows, rows.filter(F.conv(F.substring(F.md5(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey")), 1, 6), 16, 10).cast("long") % 10 >= 3)


@query("linear_regression_line", f"select round(regr_slope(l_extendedprice, l_quantity), 3) as slope, round(regr_intercept(l_extendedprice, l_quantity), 2) as intercept from ({TRAIN_LINES})")
def linear_regression_line(spark, d):
    """The fitted regression of one feature, against the closed form."""
    _, train = train_lines(spark, d)
    fitted = E.pipeline(LinearRegression(solver="normal", labelCol="target"), ["l_quantity"], []).fit(train.select("l_quantity", F.col("l_extendedprice").alias("target"))).stages[-1]
    return spark.createDataFrame([(float(fitted.coefficients[0]), float(fitted.intercept))], "slope double, intercept double").select(F.round("slope", 3).alias("slope"), F.round("intercept", 2).alias("intercept"))


@query("scale_fitted_on_train", f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity - m) / s, 6) as l_quantity from lineitem, (select avg(l_quantity) as m, stddev_pop(l_quantity) as s from ({TRAIN_LINES}))")
def scale_fitted_on_train(spark, d):
    rows, train = train_lines(spark, d)
    fitted = X.scales(train, {"l_quantity": "standardise"})
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *X.scaled(fitted)).withColumn("l_quantity", F.round("l_quantity", 6))


@query("model_per_group", "select l_returnflag, count(*) as n, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept from lineitem group by l_returnflag")
def model_per_group(spark, d):
    return E.per_group(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice").withColumns({"slope": F.round("slope", 4), "intercept": F.round("intercept", 3)})


@query("split_by_time", "select event_id, row_number() over (order by ts desc, event_id desc) <= ceil(0.3 * count(*) over ()) as is_test from events")
def split_by_time(spark, d):
    return D.split_by_time(table(spark, d, "events").select("event_id", "ts"), "ts", "event_id").select("event_id", "is_test")


@query("nearest_neighbour_classifier", """with n as (select q.p_retailprice >= 1500 as y, t.p_retailprice >= 1500 as p, row_number() over (partition by q.p_partkey order by (q.p_size - t.p_size) * (q.p_size - t.p_size)::double, t.p_partkey) as k from part q, part t where q.p_partkey % 50 = 0 and t.p_partkey % 50 <> 0)
    select avg(cast(y = p as integer)) as accuracy, count(*) as n from n where k = 1""")
def nearest_neighbour_classifier(spark, d):
    """1-NN as a model: the rows whose key is divisible by 50 against all others, by size."""
    part = table(spark, d, "part").select("p_partkey", "p_size", (F.col("p_retailprice") >= 1500).cast("double").alias("target"))
    near = E.NearestNeighbour("nearest", "p_partkey", ("p_size",), "skip").fit(part.filter("p_partkey % 50 <> 0")).transform(part.filter("p_partkey % 50 = 0"))
    return near.agg(M.accuracy().of(F.col("target"), F.col("prediction")).alias("accuracy"), F.count("*").alias("n"))


@query("hyperparameter_search")
def hyperparameter_search(spark, d):
    train, test, _ = model_rows(spark, d, False)
    trials = E.search("gradient_boosting", train.persist(), test.persist(), ["l_extendedprice", "l_discount", "l_tax"], ["l_returnflag"], trials=3, first={"maxDepth": 4, "minInstancesPerNode": 48}, maxIter=5)
    return spark.createDataFrame([(t["maxDepth"], t["minInstancesPerNode"], t["RRSE"]) for t in trials], "maxDepth int, minInstancesPerNode int, RRSE double")


@query("score_records")
def score_records(spark, d):
    train, _, _ = model_rows(spark, d, False)
    model = learner("linear", E.REGRESSORS["linear_regression"]).fit(train).model
    schema = T.StructType.fromDDL("l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string")
    one = {"l_extendedprice": 40000.0, "l_discount": 0.05, "l_tax": 0.02, "l_returnflag": "N", "l_linestatus": "O"}
    return E.score(model, records(spark, [one, one | {"l_returnflag": "unseen"}], schema)).select("l_extendedprice", "l_returnflag", "prediction")


# --- missing values, time and whole tables ------------------------------------------------------


@query("histogram_with_nulls", """with v as (select l_extendedprice as x from lineitem where l_linenumber <> 3), e as (select min(x) as lo, max(x) as hi from v)
    select least(floor((x - lo) / ((hi - lo) / 50)), 49)::bigint as bin, count(*) as n from v, e group by 1""")
def histogram_with_nulls(spark, d):
    return P.histogram(table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")).alias("x")), "x")


@query("accuracy_missing_predictions", "select avg(cast((value >= 150) is not distinct from (case when event_id % 10 <> 0 then event_id % 2 = 0 end) as integer)) as accuracy from events")
def accuracy_missing_predictions(spark, d):
    rows = table(spark, d, "events").select((F.col("value") >= 150).alias("y"), F.when(F.col("event_id") % 10 != 0, F.col("event_id") % 2 == 0).alias("p"))
    return M.evaluate(rows, (M.accuracy(),), "y", "p")


@query("confusion_missing_predictions", """with c as (select (value >= 150)::varchar as truth, (case when event_id % 10 <> 0 then event_id % 2 = 0 end)::varchar as prediction from events), l as (select truth as label from c union select prediction from c)
    select a.label as truth, b.label as prediction, (select count(*) from c where truth is not distinct from a.label and prediction is not distinct from b.label) as n from l a, l b""")
def confusion_missing_predictions(spark, d):
    rows = table(spark, d, "events").select((F.col("value") >= 150).cast("string").alias("y"), F.when(F.col("event_id") % 10 != 0, F.col("event_id") % 2 == 0).cast("string").alias("p"))
    return M.confusion_matrix(rows, "y", "p")


@query("nearest_neighbour_join", "select query_key, neighbour_key, neighbour_target from (select q.p_partkey as query_key, t.p_partkey as neighbour_key, t.p_brand as neighbour_target, row_number() over (partition by q.p_partkey order by (q.p_size - t.p_size) * (q.p_size - t.p_size)::double + (q.p_retailprice - t.p_retailprice) * (q.p_retailprice - t.p_retailprice), t.p_partkey) as k from part q, part t where q.p_partkey <> t.p_partkey) where k = 1")
def nearest_neighbour_join(spark, d):
    """The nearest other row of every row."""
    part = table(spark, d, "part")
    return E.nearest_neighbour(part, part, "p_partkey", ["p_size", "p_retailprice"], "p_brand")


@query("time_folds", "select event_id, (cast(rn > n * 1 // 4 as integer) + cast(rn > n * 2 // 4 as integer) + cast(rn > n * 3 // 4 as integer))::integer as fold from (select event_id, row_number() over (order by ts, event_id) as rn, count(*) over () as n from events)")
def folds_in_time(spark, d):
    return time_folds(table(spark, d, "events").select("event_id", "ts"), "ts", "event_id", 3).select("event_id", "fold")


_FOLD = "select value, (cast(rn > n * 1 // 4 as integer) + cast(rn > n * 2 // 4 as integer) + cast(rn > n * 3 // 4 as integer)) as fold from (select value, row_number() over (order by ts, event_id) as rn, count(*) over () as n from events)"
_ORIGIN = " union all ".join(f"select {i} as fold, (select count(*) from f where fold < {i}) as n_train, count(*) as n_test, 'mean' as model, round(avg(abs(value - p)), 6) as MAE, round(sqrt(avg((value - p) * (value - p))), 6) as RMSE from f, (select avg(value) as p from f where fold < {i}) where fold = {i}" for i in (1, 2, 3))


@query("rolling_origin", f'with f as ({_FOLD}) select fold::integer as fold, n_train, n_test, model, MAE as "MAE", RMSE as "RMSE" from ({_ORIGIN})')
def rolling(spark, d):
    """Expanding folds; the mean of the training rows is chosen over nothing by the inner split."""
    def mean(train):
        value = train.agg(F.avg("value").alias("prediction"))  # one row
        return lambda test: test.crossJoin(F.broadcast(value))

    models = {"mean": mean, "zero": lambda train: lambda test: test.withColumn("prediction", F.lit(0.0))}
    out = rolling_origin(table(spark, d, "events").select("event_id", "ts", "value"), "ts", "event_id", models, (M.mae(), M.rmse()), "value")
    return out.withColumns({n: F.round(n, 6) for n in ("MAE", "RMSE")})


@query("boosted_stump", """with r as (select case when p_partkey % 5 = 0 then null else p_size end as x, p_retailprice as y from part), b as (select avg(y) as base from r), c as (select distinct x from r where x is not null), m as (select false as ml union all select true),
    s as (select c.x as threshold, ml, sum(case when r.x <= c.x or (r.x is null and ml) then base - y else 0 end) as gl, count(case when r.x <= c.x or (r.x is null and ml) then 1 end) as hl, sum(base - y) as g, count(*) as h from r, b, c, m group by 1, 2)
    select threshold::double as threshold, ml as missing_left, round(-gl / (hl + 2), 2) as left_value, round(-(g - gl) / (h - hl + 2), 2) as right_value from s where hl >= 30 and h - hl >= 30 order by gl * gl / (hl + 2) + (g - gl) * (g - gl) / (h - hl + 2) desc limit 1""")
def boosted_stump(spark, d):
    """The first split of boosted trees, missing values and all, against all cuts."""
    rows = table(spark, d, "part").select(F.array(F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).cast("double")).alias("x"), F.col("p_retailprice").alias("y"))
    tree = BoostedTrees(featuresCol="x", labelCol="y", rounds=1, maxDepth=1, eta=1.0, regLambda=2.0, minChildWeight=30.0).fit(rows).trees[0]
    left = int(tree.left[0])
    one = (float(tree.threshold[0]), bool(tree.missing_left[0]), float(tree.value[left]), float(tree.value[left + 1]))
    return spark.createDataFrame([one], "threshold double, missing_left boolean, left_value double, right_value double").withColumns({n: F.round(n, 2) for n in ("left_value", "right_value")})


@query("model_boosted_encoded")
def model_boosted_encoded(spark, d):
    """The tuned boosted trees with the customer's encoding, whose missing values they take as they are; ten trees."""
    rows, learners = priced_orders(spark, d)
    boosted = E.Learner("boosted_encoded", lambda n: BoostedTrees(rounds=10, labelCol="target", **E.TUNED), learners[1].features, learners[1].encoders, missing=True)
    return R.evaluate_learners(rows, "o_orderkey", [boosted], R.EvaluationParams(seed=21))


@query("search_parzen")
def search_parzen(spark, d):
    """Trials over all five parameters of boosted trees, the given point first."""
    rows, learners = priced_orders(spark, d)
    split = D.split_train_test(rows, "o_orderkey", seed=21)
    make = lambda p: E.Learner("boosted", lambda n: BoostedTrees(rounds=2, labelCol="target", **p), learners[1].features, learners[1].encoders, missing=True)
    trials = S.search_learner(make, split.filter("not is_test"), split.filter("is_test"), trials=3, first=[S.BOOSTING_FIRST])
    return spark.createDataFrame([(t.number, *[float(t.point[n]) for n in S.BOOSTING], t.loss) for t in trials], "trial int, " + ", ".join(f"{n} double" for n in S.BOOSTING) + ", RRSE double")


@query("case_study_regressors")
def case_study_regressors(spark, d):
    """The regressors of a first study side by side: classes of whole numbers, the nearest row, a forest and a small tree."""
    rows = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice", F.col("p_size").cast("double").alias("target"))
    units = (X.FeatureSpec(("p_retailprice",), rule="standardise"), X.FeatureSpec(("p_brand",), categorical=True))
    learners = [E.Learner("logistic_regression", lambda n: E.MultinomialRegression(), units), E.NearestNeighbour("nearest_neighbour", "p_partkey", ("p_retailprice",))]
    learners += [E.Learner(n, E.REGRESSORS[n], units) for n in ("random_forest", "decision_tree")]
    return R.evaluate_learners(rows, "p_partkey", learners)


@query("scatter_points")
def scatter_points(spark, d):
    """What a plot of price by size shows: a sample of some thousand points."""
    return P.scatter(table(spark, d, "part"), "p_size", "p_retailprice", "p_brand")


@query("train_models", "select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 1) as slope from lineitem group by 1")
def models_of_groups(spark, d):
    """A learner fitted for each of a few groups."""
    lines = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", F.col("l_extendedprice").alias("target"))
    models = E.train_models(lines, "l_returnflag", lambda: E.Learner("linear", lambda n: LinearRegression(solver="normal", labelCol="target"), (X.FeatureSpec(("l_quantity",)),)))
    return spark.createDataFrame([(g, float(m.model.stages[-1].coefficients[0])) for g, m in models.items()], "l_returnflag string, slope double").withColumn("slope", F.round("slope", 1))
