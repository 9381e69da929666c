"""Preparation of panels: run_id, unit_id, t, x, y (one row per unit and period, many runs at once).

All operators group by run and unit, so runs are handled side by side and nothing depends on how many
there are. Rows with a null x or y do not enter the sums of their unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = ["run_id", "unit_id"]


def centred(panel: DataFrame) -> DataFrame:
    """x less its mean over the unit."""
    return panel.withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy(*UNIT)))


def standardised(panel: DataFrame) -> DataFrame:
    """x centred and divided by its sample standard deviation over the unit; null where that is 0 or unknown."""
    w = Window.partitionBy(*UNIT)
    return panel.withColumn("x", (F.col("x") - F.avg("x").over(w)) / F.nullif(F.stddev_samp("x").over(w), F.lit(0.0)))


def unit_ols(panel: DataFrame) -> DataFrame:
    """Least squares by unit, with the sums that the cluster likelihood needs.

    alpha and beta are null for a unit whose x does not vary. resid_sd divides by periods - 1.
    sum_y, sum_xy and sum_xx are of the centred x, sum_yy of y shifted by beta times the mean of x,
    so intercepts stay on the scale of the data.
    """
    known = panel.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    x, y = F.col("x"), F.col("y")
    fit = known.groupBy(*UNIT).agg(
        F.count(F.lit(1)).alias("periods"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.regr_slope(y, x).alias("beta"), F.regr_intercept(y, x).alias("alpha"),
        F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"),
    )
    shifted = F.col("mean_y") - F.col("beta") * F.col("mean_x")
    rss = F.greatest(F.col("syy") - F.col("beta") * F.col("sxy"), F.lit(0.0))
    return fit.withColumn("resid_sd", F.sqrt(rss / F.nullif(F.col("periods") - 1, F.lit(0)))).withColumns({"sum_y": F.col("periods") * shifted, "sum_xy": F.col("sxy"), "sum_xx": F.col("sxx"), "sum_yy": F.col("syy") + F.col("periods") * shifted * shifted})


def shifted(panel: DataFrame) -> DataFrame:
    """Centred x, and y less the unit's slope times the mean of x."""
    w = Window.partitionBy(*UNIT)
    return panel.withColumns({"y": F.col("y") - F.regr_slope("y", "x").over(w) * F.avg("x").over(w), "x": F.col("x") - F.avg("x").over(w)})


def orthogonality(panel: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """Whether the x of every unit sums to 0, by run."""
    sums = panel.groupBy(*UNIT).agg(F.sum("x").alias("s"))
    return sums.groupBy("run_id").agg((F.sum(F.abs("s")) < tolerance).alias("orthogonal"))


def held_out(panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all periods but the last of the run, the last)."""
    last = F.max("t").over(Window.partitionBy("run_id"))
    marked = panel.withColumn("_last", last)
    return marked.where(F.col("t") < F.col("_last")).drop("_last"), marked.where(F.col("t") == F.col("_last")).drop("_last")


def default_hyperparameters(units: DataFrame, rho: float = 0.9) -> DataFrame:
    """a1, a2, b1, b2, alpha_sigma, beta_sigma of each run from its least-squares fits.

    K = round(ln units); a1 = (range/(K + 1)/2)² / s² · 0.2, a2 = (max |·|/2)² / s² - a1/(1 - rho),
    with s² the mean residual variance, likewise b1, b2; the inverse gamma has the moments of
    the residual variances. Null where they do not vary.
    """
    v = F.col("resid_sd") * F.col("resid_sd")
    k = F.round(F.ln(F.count(F.lit(1))))
    moments = units.groupBy("run_id").agg(k.alias("k"), F.avg(v).alias("mu"), F.var_samp(v).alias("v"), *[f(c).alias(f"{c}_{n}") for c in ("alpha", "beta") for n, f in (("range", lambda c: F.max(c) - F.min(c)), ("top", lambda c: F.max(F.abs(c))))])
    out = moments.withColumn("alpha_sigma", F.col("mu") * F.col("mu") / F.nullif(F.col("v"), F.lit(0.0)) + 2).withColumn("beta_sigma", F.col("mu") * (F.col("alpha_sigma") - 1))
    for side, c in (("a", "alpha"), ("b", "beta")):
        first = F.pow(F.col(f"{c}_range") / (F.col("k") + 1) / 2, 2) / F.nullif(F.col("mu"), F.lit(0.0)) * 0.2
        out = out.withColumn(f"{side}1", first).withColumn(f"{side}2", F.pow(F.col(f"{c}_top") / 2, 2) / F.nullif(F.col("mu"), F.lit(0.0)) - F.col(f"{side}1") / (1 - rho))
    return out.select("run_id", "a1", "a2", "b1", "b2", "alpha_sigma", "beta_sigma")


def predicted(estimates: DataFrame, new: DataFrame) -> DataFrame:
    """alpha + beta x for the rows of new, beside y; units without an estimate are left out."""
    return new.join(estimates.select(*UNIT, "alpha", "beta"), UNIT).withColumn("fit", F.col("alpha") + F.col("beta") * F.col("x"))


def accuracy(rows: DataFrame, keys: list[str], actual: Column, fit: Column) -> DataFrame:
    """rmse, and r2 against the population variance of the actual values (null where that is 0)."""
    mse = F.avg(F.pow(actual - fit, 2))
    return rows.groupBy(*keys).agg(F.sqrt(mse).alias("rmse"), (1 - mse / F.nullif(F.var_pop(actual), F.lit(0.0))).alias("r2"))
