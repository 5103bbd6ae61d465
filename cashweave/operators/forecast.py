"""Least-squares growth forecasts with bands, one per entity, as Spark aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Model labels, smallest residual spread, and the scale of the bands.
LABEL_EXP = "Exponential Fit"
LABEL_LINEAR = "Linear Fit"
LABEL_FALLBACK = "Linear Fit (exponential unavailable)"
MIN_SIGMA_LOG = 0.05
MIN_SIGMA_SHARE = 0.05
REFERENCE_WIDTH = 15
BAND_LOG, BAND_LINEAR, BAND_WIDENING = 1.5, 2.0, 0.5
VALUE_PARTS = ("liquid", "retirement", "investments")

ORIGIN = 10_957                       # 2000-01-01 as days from the epoch; any fixed day would do
VALUE_DIGITS, LOG_DIGITS = 4, 12      # decimals of values and of their logarithms
EXACT = "decimal(38,0)"


def series(history: DataFrame, keys: Sequence[str] = (), value_col: str | None = None) -> DataFrame:
    """The observed series: date and value. The default value leaves liabilities out."""
    value = (F.col(value_col) if value_col
             else sum((F.coalesce(F.col(c), F.lit(0)) for c in VALUE_PARTS), F.lit(0)))
    return history.select(*keys, "as_of_date", value.cast("double").alias("y"))


def _whole(v: Column, digits: int) -> Column:
    """``v`` to ``digits`` decimals as an integer: sums of integers do not depend on the order of the rows."""
    return F.floor(v * 10.0 ** digits + 0.5).cast(EXACT)


def fit(history: DataFrame, keys: Sequence[str] = (), model: str = "exponential",
        value_col: str | None = None) -> DataFrame:
    """One row per entity with at least two dates: the fitted line and its residual spread.

    All moments are exact sums of integers: days from one fixed origin, values to four decimals and logarithms to
    twelve. They are the same under any partitioning, nothing cancels before the last step, and no pass is needed to
    find the first day. The line is kept as (mean x, mean y, slope). Dates without a value take no part; moments that
    leave 38 digits (values beyond about 10^10 over thousands of dates) raise an error rather than lose digits.
    """
    if model not in ("exponential", "linear"):
        raise ValueError("model must be 'exponential' or 'linear'")
    x, y = (F.unix_date("as_of_date") - ORIGIN).cast(EXACT), F.col("y")
    scaled = {"lin": (_whole(y, VALUE_DIGITS), VALUE_DIGITS), "log": (_whole(F.when(y > 0, F.ln(y)), LOG_DIGITS), LOG_DIGITS)}

    def total(c: Column) -> Column:
        return F.sum(c.cast(EXACT))

    rows = (series(history, keys, value_col).where("y IS NOT NULL").groupBy(*keys)
            .agg(F.count("*").alias("n"), F.min("as_of_date").alias("first_date"),
                 F.max("as_of_date").alias("last_date"), F.min("y").alias("min_y"),
                 F.max_by("y", "as_of_date").alias("last_y"), total(x).alias("sx"), total(x * x).alias("sxx"),
                 *(total(t).alias(f"{name}_{tag}") for tag, (v, _) in scaled.items()
                   for name, t in (("s", v), ("sx", x * v), ("ss", v * v))))
            .where("n >= 2"))
    n = F.col("n").cast(EXACT)

    def spread(a: str, b: str, ab: str) -> Column:
        """n times the sum of products less the product of sums: n squared covariances."""
        left, right = (n * F.col(ab)).cast(EXACT), (F.col(a) * F.col(b)).cast(EXACT)
        return (left - right).cast(EXACT).cast("double")

    dxx = F.nullif(spread("sx", "sx", "sxx"), F.lit(0.0))
    measures = {}
    for tag, (_, digits) in scaled.items():
        dxy, dyy = spread("sx", f"s_{tag}", f"sx_{tag}"), spread(f"s_{tag}", f"s_{tag}", f"ss_{tag}")
        unit = F.lit(10.0 ** digits)
        measures |= {f"mean_{tag}": F.col(f"s_{tag}").cast("double") / F.col("n") / unit,
                     f"slope_{tag}": dxy / dxx / unit,
                     f"sigma_{tag}": F.sqrt(F.greatest(dyy - dxy * dxy / dxx, F.lit(0.0))) / F.col("n") / unit}
    start = F.unix_date("first_date") - ORIGIN
    measures["mean_x"] = (F.col("sx") - n * start).cast(EXACT).cast("double") / F.col("n")
    rows = rows.withColumns(measures)
    exponential = (F.col("min_y") > 0) if model == "exponential" else F.lit(False)
    label = (F.when(exponential, LABEL_EXP).otherwise(LABEL_FALLBACK)
             if model == "exponential" else F.lit(LABEL_LINEAR))

    def pick(name: str) -> Column:
        return F.when(exponential, F.col(f"{name}_log")).otherwise(F.col(f"{name}_lin"))

    floor_lin = F.col("mean_lin") * MIN_SIGMA_SHARE
    return rows.select(
        *keys, "n", "first_date", "last_date", "last_y", label.alias("model"),
        exponential.alias("exponential"),
        F.datediff("last_date", "first_date").alias("span"),
        "mean_x", pick("mean").alias("mean_y"), pick("slope").alias("slope"),
        F.when(exponential, F.greatest("sigma_log", F.lit(MIN_SIGMA_LOG)))
        .otherwise(F.greatest("sigma_lin", floor_lin)).alias("sigma"))


def _with_bands(points: DataFrame, width: float) -> DataFrame:
    """Add prediction and band at ``x``. The linear fallback does not widen into the future."""
    line = F.col("mean_y") + F.col("slope") * (F.col("x") - F.col("mean_x"))
    spread = F.col("sigma") * (width / REFERENCE_WIDTH)
    factor = F.exp(spread * BAND_LOG)
    beyond = F.col("x") - F.col("span")
    widening = F.greatest(F.lit(1.0),
                          1 + beyond / F.greatest(F.col("span"), F.lit(1)) * BAND_WIDENING)
    half = spread * BAND_LINEAR * F.when(F.col("model") == LABEL_LINEAR, widening).otherwise(1.0)
    exponential = F.col("exponential")
    return (points.withColumn("predicted", F.when(exponential, F.exp(line)).otherwise(line))
            .withColumn("lower", F.when(exponential, F.col("predicted") / factor)
                        .otherwise(F.col("predicted") - half))
            .withColumn("upper", F.when(exponential, F.col("predicted") * factor)
                        .otherwise(F.col("predicted") + half)))


def forecast(history: DataFrame, keys: Sequence[str] = (), model: str = "exponential",
             width: float = 15, horizon_days: int = 365, points: int = 200,
             value_col: str | None = None) -> DataFrame:
    """Predictions and bands on an even grid from the first date to ``horizon_days`` past the last."""
    if points < 2:
        raise ValueError("points must be at least 2")
    end = F.col("span") + F.lit(horizon_days)
    point = F.col("point")
    grid = (fit(history, keys, model, value_col)
            .withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
            .withColumn("x", F.when(point == points - 1, end.cast("double"))
                        .otherwise(point * (end / F.lit(points - 1)))))
    return (_with_bands(grid, width)
            .select(*keys, "point", "x",
                    F.date_add("first_date", F.floor("x").cast("int")).alias("as_of_date"),
                    "model", "predicted", "lower", "upper",
                    (F.col("x") > F.col("span")).alias("is_future")))


def forecast_summary(history: DataFrame, keys: Sequence[str] = (), model: str = "exponential",
                     width: float = 15, horizon_days: int = 365,
                     value_col: str | None = None) -> DataFrame:
    """Last value, the prediction at the horizon with its range, and the growth between them."""
    at_end = fit(history, keys, model, value_col).withColumn(
        "x", (F.col("span") + F.lit(horizon_days)).cast("double"))
    current = F.col("last_y")
    growth = F.col("predicted") - current
    return (_with_bands(at_end, width)
            .select(*keys, "model", current.alias("current"),
                    F.col("predicted").alias("projected"), F.col("lower").alias("low"),
                    F.col("upper").alias("high"), growth.alias("growth"),
                    F.when(current > 0, growth / current * 100).otherwise(0.0)
                    .alias("growth_pct")))
