"""Metric formulas over count columns."""

from pyspark.sql import Column, functions as F


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as DOUBLE; null when ``whole`` is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def discrimination(hit_self: Column, n_self: Column, hit_del: Column, n_del: Column) -> Column:
    """Unpooled two-proportion z between the solve and the hand-off group; 0 when undefined."""
    p_self = F.coalesce(ratio(hit_self, n_self), F.lit(0.0))
    p_del = F.coalesce(ratio(hit_del, n_del), F.lit(0.0))

    def variance(p: Column, n: Column) -> Column:
        return ratio(F.greatest(p * (1 - p), F.lit(0.0)), n)

    error = F.sqrt(variance(p_self, n_self) + variance(p_del, n_del))
    return F.when(error > 0, (p_self - p_del) / error).otherwise(F.lit(0.0))


def rounded(df, digits: int = 6):
    """Every DOUBLE column rounded."""
    return df.select(
        *(
            F.round(name, digits).alias(name) if kind == "double" else F.col(name)
            for name, kind in df.dtypes
        )
    )
