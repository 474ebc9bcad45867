"""Confusion matrices, rates and intervals."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_of(host: Column) -> Column:
    """dev or test, by the parity of the host's SHA-256."""
    return F.when(F.right(F.sha2(host, 256), F.lit(1)).isin(*"02468ace"), "dev").otherwise("test")


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    a, p = F.col("actual"), F.col("predicted")
    return rows.groupBy(*by).agg(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn"))


def _ratio(x: Column, y: Column) -> Column:
    return F.coalesce(F.try_divide(x, y), F.lit(0.0))


def rates(matrix: DataFrame) -> DataFrame:
    """precision, recall, f1 (of the unrounded two) and fpr, to four digits; 0 where they aren't defined."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return matrix.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(_ratio(2 * p * r, p + r), 4), "fpr": F.round(_ratio(fp, fp + tn), 4)})


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = _ratio(successes, n)
    middle, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = (middle - half) / (1 + z * z / n), (middle + half) / (1 + z * z / n)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), low)), F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), high))
