"""Aggregations the built-ins lack: concentration, modes with a fixed tie rule, agreement and resampling."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hhi(x: str) -> Column:
    """Concentration: sum of squares over squared sum, from two partial sums."""
    return F.try_divide(F.sum(F.col(x) * F.col(x)), F.pow(F.sum(x), F.lit(2)))


def weighted_mean(x: str, w: str) -> Column:
    both = F.col(x).isNotNull() & F.col(w).isNotNull()
    return F.try_divide(F.sum(F.when(both, F.col(x) * F.col(w))), F.sum(F.when(both, F.col(w))))


def modal(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value per group; ties go to the least value.  Counts are taken before values meet their group."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc(value))
    return n.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def value_counts(df: DataFrame, value: str) -> DataFrame:
    n = df.groupBy(value).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


def confusion(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """tp, fp, fn, tn and the rates from them; rates are null on an empty denominator."""
    n = lambda c: F.count(F.when(c, 1))
    c = df.agg(n(truth & guess).alias("tp"), n(~truth & guess).alias("fp"), n(truth & ~guess).alias("fn"), n(~truth & ~guess).alias("tn"))
    r = lambda a, b: F.round(F.try_divide(a, b), 6)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.withColumn("precision", r(tp, tp + fp)).withColumn("recall", r(tp, tp + fn)).withColumn("accuracy", r(tp + tn, tp + fp + fn + tn))


def kappa_wilson(df: DataFrame, z: float = 1.96) -> DataFrame:
    """Cohen's kappa and the Wilson interval of accuracy of a :func:`confusion` frame."""
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    po = (tp + tn) / n
    pe = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    mid, half = (po + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(po * (1 - po) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return df.select(
        F.round(F.try_divide(po - pe, 1 - pe), 6).alias("kappa"), F.round(mid - half, 6).alias("wilson_low"), F.round(mid + half, 6).alias("wilson_high")
    )


def bootstrap_kappa(df: DataFrame, truth: Column, guess: Column, draws: int = 400, seed: int = 5) -> DataFrame:
    """The 2.5 and 97.5 percentiles of kappa over seeded multinomial resamples of the four cell counts.

    The cells are all that resampling rows would change, so no row is collected.
    """
    cells = confusion(df, truth, guess).select("tp", "fp", "fn", "tn")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for r in batch.to_pylist():
                c = np.array([r["tp"], r["fp"], r["fn"], r["tn"]], dtype=float)
                n = int(c.sum())
                if not n:
                    continue
                s = np.random.default_rng(seed).multinomial(n, c / n, draws) / n
                po, pe = s[:, 0] + s[:, 3], (s[:, 0] + s[:, 1]) * (s[:, 0] + s[:, 2]) + (s[:, 2] + s[:, 3]) * (s[:, 1] + s[:, 3])
                k = np.where(pe < 1, (po - pe) / np.where(pe < 1, 1 - pe, 1), 0.0)
                yield pa.RecordBatch.from_pylist([{"kappa_low": float(np.quantile(k, 0.025)), "kappa_high": float(np.quantile(k, 0.975))}])

    return cells.mapInArrow(draw, "kappa_low double, kappa_high double")


def ledger(df: DataFrame, day: Column, caller: str, hit: Column, cost: Column, saved: Column) -> DataFrame:
    """Per day and caller: calls, billed calls, hits, cost and what hits saved."""
    n = lambda c: F.count(F.when(c, 1))
    return df.groupBy(day.alias("day"), caller).agg(
        F.count("*").alias("calls"), n(~hit).alias("billed"), n(hit).alias("hits"),
        F.round(F.sum(F.when(~hit, cost).otherwise(0.0)), 4).alias("cost"), F.round(F.sum(F.when(hit, saved).otherwise(0.0)), 4).alias("saved"),
    )
