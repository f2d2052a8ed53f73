"""What SQL can check of the models: scaling, linear fits, components, weights, losses and ensembles, over forecasts from last week's return."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions.stages import staged
from factorloom.operators import folds, models, statistics
from factorloom.plans.queries import PREDICTIONS_SQL, forecasts
from factorloom.plans.registry import cols, query, significant, significant_sql

_SPLIT = ("1998-01-01", "1998-03-01")
#: y with a second feature, and its rows before and after the split
_SAMPLES = PREDICTIONS_SQL + f""", s AS (SELECT *, CAST(day(date) AS DOUBLE) AS g FROM y), train AS (SELECT * FROM s WHERE date < DATE '{_SPLIT[0]}'), test AS (SELECT * FROM s WHERE date >= DATE '{_SPLIT[1]}')
"""
_METRICS = ("mse", "mae", "r2", "r2_zero")


def samples(spark, d) -> DataFrame:
    return staged(forecasts(spark, d).withColumn("g", F.dayofmonth("date").cast("double")))


def _scored(prediction: str, name: str) -> str:
    e = f"(({prediction}) - return_1m)"
    cells = {"mse": f"avg({e} * {e})", "mae": f"avg(abs({e}))", "r2": f"1 - sum({e} * {e}) / (var_pop(return_1m) * count(*))", "r2_zero": f"1 - sum({e} * {e}) / sum(return_1m * return_1m)"}
    return f"SELECT '{name}' AS model, {', '.join(significant_sql(x, 6, k) for k, x in cells.items())}, count(*) AS n FROM test, fit"


_FIT = """, m AS (SELECT covar_pop(f, f) AS ff, covar_pop(f, g) AS fg, covar_pop(g, g) AS gg, covar_pop(f, return_1m) AS fy, covar_pop(g, return_1m) AS gy, avg(f) AS af, avg(g) AS ag, avg(return_1m) AS ay,
  regr_slope(return_1m, f) AS sf, regr_intercept(return_1m, f) AS cf, regr_slope(return_1m, g) AS sg, regr_intercept(return_1m, g) AS cg FROM train),
fit AS (SELECT *, (fy * gg - gy * fg) / (ff * gg - fg * fg) AS bf, (gy * ff - fy * fg) / (ff * gg - fg * fg) AS bg FROM m)
"""


@query(_SAMPLES + _FIT + " UNION ALL ".join([_scored("ay + bf * (f - af) + bg * (g - ag)", "linear"), _scored("(cf + sf * f + cg + sg * g) / 2", "ensemble"), _scored("ay", "mean_forecast"), _scored("0", "zero_forecast")]), 12)
def linear_fits(spark, d):
    """Test scores of a linear fit on two features, of the mean of two fits on one, and of the baselines."""
    train, test = folds.date_split(samples(spark, d), *_SPLIT)
    both = models.linear(["f", "g"], "return_1m").fit(train)
    single = [models.linear([x], "return_1m").fit(train) for x in ("f", "g")]
    base = statistics.with_baselines(test, train, "return_1m")
    parts = {"linear": (both.transform(test), "prediction"), "ensemble": (models.ensemble(single, test), "prediction"), "mean_forecast": (base, "mean_forecast"), "zero_forecast": (base, "zero_forecast")}
    scores = [statistics.regression_metrics(p, "return_1m", c).withColumn("model", F.lit(n)) for n, (p, c) in parts.items()]
    return reduce(DataFrame.unionByName, scores).select("model", *[significant(F.col(c), 6).alias(c) for c in _METRICS], "n")


@query(_SAMPLES + "SELECT k AS component, round((1 + CASE k WHEN 0 THEN 1 ELSE -1 END * abs(corr(f, g))) / 2, 6) AS ratio FROM train, (SELECT unnest([0, 1]) AS k) GROUP BY k")
def component_ratios(spark, d):
    """Shares of the two components of two standardised features in their variance."""
    train, _ = folds.date_split(samples(spark, d), *_SPLIT)
    ratios = models.explained_ratio(models.component_regression(["f", "g"], "return_1m", 2).fit(train))
    return spark.createDataFrame(list(enumerate(ratios)), "component int, ratio double")


@query(_SAMPLES + f"SELECT ticker, date, {cols('zf', 'zg')} FROM (SELECT ticker, date, (f - avg(f) OVER ()) / stddev_pop(f) OVER () AS zf, (g - avg(g) OVER ()) / stddev_pop(g) OVER () AS zg FROM s)")
def standardised_features(spark, d):
    """Two features with zero mean and unit population deviation."""
    rows = samples(spark, d)
    z = vector_to_array("features")
    return Pipeline(stages=models.assembled(["f", "g"], scaled=True)).fit(rows).transform(rows).select("ticker", "date", z[0].alias("zf"), z[1].alias("zg"))


@query(_SAMPLES + f", c AS (SELECT l, count(*) AS n FROM train GROUP BY l) SELECT l, n, {cols('weight')} FROM (SELECT l, n, sum(n) OVER () / (count(*) OVER () * n) AS weight FROM c)")
def class_weights(spark, d):
    """Weights under which both classes of the training rows count alike."""
    train, _ = folds.date_split(samples(spark, d), *_SPLIT)
    return models.balanced_weights(train, "l").groupBy("l").agg(F.count("*").alias("n"), F.avg("weight").alias("weight"))


_Q = "least(0.95, greatest(0.05, 0.5 + f / 4))"


@query(_SAMPLES + f", q AS (SELECT *, {_Q} AS q, 1 + g AS w FROM s) SELECT {cols('neg_log_loss', 'accuracy')} FROM (SELECT sum(w * ln(CASE WHEN l = 1 THEN q ELSE 1 - q END)) / sum(w) AS neg_log_loss, sum(CASE WHEN (q > 0.5) = (l = 1) THEN w ELSE 0 END) / sum(w) AS accuracy FROM q)")
def weighted_log_loss(spark, d):
    """Weighted log loss and accuracy of probabilities made from last week's return."""
    q = F.least(F.lit(0.95), F.greatest(F.lit(0.05), F.lit(0.5) + F.col("f") / 4))
    rows = samples(spark, d).withColumns({"probability": array_to_vector(F.array(1 - q, q)), "prediction": (q > 0.5).cast("double"), "w": 1 + F.col("g")})
    return models.log_loss(rows, "l", "w")


@query(_SAMPLES + f"SELECT ticker, date, CASE WHEN q > 0.5 THEN 1 ELSE -1 END AS side_prediction, {cols('certainty')} FROM (SELECT ticker, date, {_Q} AS q, {_Q} AS certainty FROM s)")
def sides(spark, d):
    """Side and certainty from a model's columns."""

    class Given:
        """A fitted model that gives probabilities from last week's return."""

        def transform(self, df):
            q = F.least(F.lit(0.95), F.greatest(F.lit(0.05), F.lit(0.5) + F.col("f") / 4))
            return df.withColumns({"probability": array_to_vector(F.array(1 - q, q)), "prediction": (q > 0.5).cast("double"), "features": F.lit(None), "rawPrediction": F.lit(None)})

    return models.predict_side(Given(), samples(spark, d)).select("ticker", "date", "side_prediction", "certainty")
