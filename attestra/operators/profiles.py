"""Incidents reduced to count tables and moments, and the backgrounds they are judged against."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNSEEN_MASS = 0.01
WITHIN_FRACTION = 0.4
SHAPE = 2.5


def counts(rows: DataFrame, entity: str, category: Column | str) -> DataFrame:
    """entity, category, n; blank and null categories are no observation."""
    c = F.col(category) if isinstance(category, str) else category
    return rows.select(F.col(entity).alias("entity"), c.cast("string").alias("category")).where("category is not null and category <> ''").groupBy("entity", "category").agg(F.count("*").alias("n"))


def moments(rows: DataFrame, entity: str, value: Column) -> DataFrame:
    """entity, n, mean, m2 of a value; nulls and non-finite values are no observation."""
    v = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    return rows.select(F.col(entity).alias("entity"), v.alias("v")).where("v is not null").groupBy("entity").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("*")).alias("m2"))


def log_floor(value: Column, floor: float) -> Column:
    return F.log(F.greatest(value.cast("double"), F.lit(floor)))


def gaps(rows: DataFrame, entity: str, ts: str, tie: str) -> DataFrame:
    """rows with log_gap: ln of the seconds since the entity's row before, at least one second; null for its first."""
    w = Window.partitionBy(entity).orderBy(ts, tie)
    seconds = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) / 1e6
    return rows.withColumn("log_gap", F.when(seconds.isNotNull(), log_floor(seconds, 1.0)))


def background(counted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """category, n, frequency over a count table. The totals are one row a group, joined back by broadcast."""
    n = counted.groupBy(*by, "category").agg(F.sum("n").alias("n"))
    total = n.groupBy(*by).agg(F.sum("n").alias("_total"), F.count("*").alias("_k"))
    joined = n.join(F.broadcast(total), list(by)) if by else n.crossJoin(F.broadcast(total))
    frequency = F.col("n") / F.col("_total")
    return joined.select(*by, "category", "n", frequency.alias("frequency"), (frequency * (1 - UNSEEN_MASS)).alias("reported_frequency"), (F.lit(UNSEEN_MASS) / F.col("_k")).alias("unseen_frequency"))


def circular(counted: DataFrame, bins: int, concentration: float = 4.0) -> DataFrame:
    """category, frequency: counts over a circle of bins, smoothed by a von Mises kernel (bins is small and fixed)."""
    spark = counted.sparkSession
    # the kernel depends on the distance only, so it has one normaliser
    weight = [math.exp(concentration * math.cos(2 * math.pi * d / bins)) for d in range(bins)]
    kernel = spark.createDataFrame([(str(i), str(j), weight[(i - j) % bins] / sum(weight)) for i in range(bins) for j in range(bins)], "category string, bin string, w double")
    n = counted.groupBy("category").agg(F.sum("n").alias("n"))
    total = n.agg(F.sum("n").alias("_total"))
    smooth = n.join(F.broadcast(kernel), "category").groupBy("bin").agg(F.sum(F.col("n") * F.col("w")).alias("s"))
    return smooth.crossJoin(F.broadcast(total)).select(F.col("bin").alias("category"), (F.col("s") / F.col("_total")).alias("frequency"))


def normal_prior(rows: DataFrame, value: Column, within: float = WITHIN_FRACTION) -> DataFrame:
    """One row of hyper-parameters (mean, precision, shape, scale) from a background sample."""
    v = rows.select(F.avg(value).alias("mean"), F.var_samp(value).alias("v"))
    inside = F.greatest(F.col("v") * within, F.lit(1e-9))
    between = F.greatest(F.col("v") - inside, F.lit(1e-9))
    return v.select("mean", (inside / between).alias("precision"), F.lit(SHAPE).alias("shape"), (inside * (SHAPE - 1)).alias("scale"))
