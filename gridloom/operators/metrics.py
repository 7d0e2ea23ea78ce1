"""Error metrics between a reference and an estimate, in one pass over the pairs.

Repeated pairs count once for each row; pairs with a null on either side have no part in what needs both. Without any
pair an ungrouped metric is a row of nulls and zero counts, a grouped one has no row. Further columns are left aside.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import DRY_DEPTH

#: Which way a metric is better.
DIRECTION = {"psnr": "higher", "ssim": "higher", "mase_m": "lower", "rmse_m": "lower", "rmse_wet_m": "lower", "bias_m": "abs_lower"}


def error_metrics(pairs: DataFrame, reference: str, estimate: str, max_depth: float, by: Sequence[str] = (), dry: float = DRY_DEPTH) -> DataFrame:
    """PSNR, SSIM (one window), RMSE (all, wet), MAE (also as mase_m), bias, MSE and counts of each group.

    A perfect estimate has a null PSNR, a group without wet cells a null rmse_wet_m.
    """
    if not max_depth > 0:
        raise ValueError(f"max_depth must be above 0, not {max_depth}")
    x, y = F.col(reference).cast("double"), F.col(estimate).cast("double")
    d, wet = y - x, x >= dry
    sums = pairs.groupBy(*by).agg(
        F.avg(d * d).alias("mse_m2"), F.avg(F.abs(d)).alias("mae_m"), F.avg(d).alias("bias_m"), F.sqrt(F.avg(F.when(wet, d * d))).alias("rmse_wet_m"),
        F.count_if(wet).alias("wet_pixel_count"), F.count_if(~wet).alias("dry_pixel_count"),
        F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"), F.covar_pop(x, y).alias("_xy"),
    )
    c1, c2 = (0.01 * max_depth) ** 2, (0.03 * max_depth) ** 2
    mx, my = F.col("_mx"), F.col("_my")
    ssim = ((2 * mx * my + c1) * (2 * F.col("_xy") + c2)) / ((mx * mx + my * my + c1) * (F.col("_vx") + F.col("_vy") + c2))
    psnr = F.when(F.col("mse_m2") > 0, 20 * F.log10(F.lit(float(max_depth))) - 10 * F.log10("mse_m2"))
    return sums.select(*by, psnr.alias("psnr"), ssim.alias("ssim"), F.sqrt("mse_m2").alias("rmse_m"), "rmse_wet_m", "mae_m", F.col("mae_m").alias("mase_m"), "bias_m", "mse_m2", "dry_pixel_count", "wet_pixel_count")


def compare(metrics: DataFrame, method: str, first: str, second: str) -> DataFrame:
    """Rows (metric, first, second, delta, better) of two methods: whether the first beats the second."""
    names = list(DIRECTION)
    long = metrics.select(method, F.expr(f"stack({len(names)}, {', '.join(f'{chr(39)}{n}{chr(39)}, {n}' for n in names)}) as (metric, value)"))
    wide = long.groupBy("metric").pivot(method, [first, second]).agg(F.first("value"))
    a, b, direction = F.col(first), F.col(second), F.create_map(*[F.lit(x) for kv in DIRECTION.items() for x in kv])[F.col("metric")]
    better = F.when(direction == "higher", a > b).when(direction == "lower", a < b).otherwise(F.abs(a) < F.abs(b))
    return wide.select("metric", a.alias("first_value"), b.alias("second_value"), (a - b).alias("delta"), better.alias("better"))


def summary(cells: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    v = F.col(value)
    return cells.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.avg(v).alias("mean"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"))


def histogram(cells: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n, density) with the upper bound in the last bin; values outside are left out, empty bins too."""
    v = F.col(value)
    number = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1))
    counts = cells.where((v >= low) & (v <= high)).groupBy(number.alias("bin")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("bin", "n", (F.col("n") / F.col("total") / ((high - low) / bins)).alias("density"))


def critical_success(pairs: DataFrame, reference: str, estimate: str, threshold: float) -> DataFrame:
    """Critical success index: hits / (hits + misses + false alarms)."""
    x, y = F.col(reference) >= threshold, F.col(estimate) >= threshold
    return pairs.agg((F.count_if(x & y) / F.count_if(x | y)).alias("csi"))


#: Values that one task sorts to find a percentile, and relative accuracy of the sketches that lead to so few.
SORTED, ACCURACY = 100_000, 10_000


def exact_percentile(values: DataFrame, value: str, percent: float) -> float | None:
    """The interpolated percentile of all values, None without any; nulls are left out.

    Sketches bracket the two ranks in question, the values below the bracket are counted, and what lies within is
    looked at again, until few values or equal ones are left: each pass is an aggregation with map-side states, and
    leaves some 4 of ACCURACY values. No task holds more than SORTED of them.
    """
    share, v = percent / 100, F.col(value)
    if not 0 <= share <= 1:
        raise ValueError(f"percent must be from 0 to 100, not {percent}")
    inside = values.select(v.cast("double").alias(value)).where(v.isNotNull())
    n, low, high = inside.agg(F.count("*"), F.min(value), F.max(value)).first()
    if not n:
        return None
    place = share * (n - 1)
    ranks = sorted({math.floor(place), math.ceil(place)})
    found: dict[int, float] = {}
    for rank in ranks:  # two at most
        part, size, below, a, b = inside, n, 0, low, high
        while size > SORTED and a < b:
            at = (rank - below) / max(1, size - 1)
            ends = [max(0.0, at - 2 / ACCURACY), min(1.0, at + 2 / ACCURACY)]
            x, y = part.agg(F.percentile_approx(value, ends, ACCURACY)).first()[0]
            under, within, lowest, highest = part.agg(F.count_if(v < x), F.count_if((v >= x) & (v <= y)), F.min(F.when((v >= x) & (v <= y), v)), F.max(F.when((v >= x) & (v <= y), v))).first()
            if not under <= rank - below < under + within:  # a sketch off its accuracy: one side of it instead
                x, y = (a, x) if rank - below < under else (y, b)
                under, within, lowest, highest = part.agg(F.count_if(v < x), F.count_if((v >= x) & (v <= y)), F.min(F.when((v >= x) & (v <= y), v)), F.max(F.when((v >= x) & (v <= y), v))).first()
            if within == size and (lowest, highest) == (a, b):  # few values, many times each
                counts = part.groupBy(value).count()
                if counts.count() > SORTED:
                    raise ArithmeticError("the sketches don't narrow the values down")
                part = counts
                break
            part, below, size, a, b = inside.where((v >= x) & (v <= y)), below + under, within, lowest, highest
        if a == b:
            found[rank] = a
            continue
        counts = part if "count" in part.columns else part.groupBy(value).count()
        until = counts.select(value, F.sum("count").over(Window.orderBy(value)).alias("_until"))  # SORTED rows at most
        found[rank] = until.where(F.col("_until") > rank - below).agg(F.min(value)).first()[0]
    first, last = found[ranks[0]], found[ranks[-1]]
    return first if len(ranks) == 1 else (ranks[1] - place) * first + (place - ranks[0]) * last


def error_percentile(pairs: DataFrame, reference: str, estimates: Sequence[str], percent: float, least: float = 1e-6) -> DataFrame:
    """Percentile of the absolute errors of several estimates together, ``least`` at least; null without any."""
    stacked = pairs.select(F.explode(F.array(*(F.abs(F.col(e) - F.col(reference)) for e in estimates))).alias("e"))
    limit = exact_percentile(stacked, "e", percent)
    return pairs.sparkSession.createDataFrame([(None if limit is None else max(limit, least),)], "limit double")
