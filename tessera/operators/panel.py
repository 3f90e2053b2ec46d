"""Panel window operators: rows of an entity in date order. All share one window, so one shuffle and one sort."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.scalar import clipped, positive, ratio

ANNUAL = 252**0.5


def by_entity(entity: str = "ticker", order: str = "date"):
    return W.partitionBy(entity).orderBy(order)


def rolling(fn: Callable[[Column], Column], c: Column, n: int, w=None, first: int | None = None, last: int = 0) -> Column:
    """fn over n rows, null unless all n values are there."""
    frame = (w or by_entity()).rowsBetween(-(n - 1) if first is None else first, last)
    return F.when(F.count(c).over(frame) >= n, fn(c).over(frame))


def rolling_mean(c: Column, n: int, w=None) -> Column:
    return rolling(F.avg, c, n, w)


def rolling_std(c: Column, n: int, w=None) -> Column:
    return rolling(F.stddev_samp, c, n, w)


def lag(c: Column, k: int, w=None) -> Column:
    return F.lag(c, k).over(w or by_entity())


def diff(c: Column, w=None) -> Column:
    return c - lag(c, 1, w)


def log_return(close: Column, w=None) -> Column:
    return F.ln(positive(ratio(close, lag(close, 1, w))))


def realized_vol(returns: Column, n: int, w=None) -> Column:
    return rolling_std(returns, n, w) * ANNUAL


def lag_features(returns: Column, lags: Iterable[int], name: str = "log_return", w=None) -> dict[str, Column]:
    return {f"{name}_lag_{k}d": lag(returns, k, w) for k in lags}


def rolling_moments(returns: Column, windows: Iterable[int], w=None) -> dict[str, Column]:
    out = {}
    for n in windows:
        out[f"rolling_mean_{n}d"] = rolling_mean(returns, n, w)
        out[f"rolling_std_{n}d"] = rolling_std(returns, n, w)
    return out


def rsi_inputs(close: Column, w=None) -> dict[str, Column]:
    """Gain and loss of each row; null on an entity's first."""
    move = diff(close, w)
    return {"__gain": clipped(move, low=0.0), "__loss": clipped(-move, low=0.0)}


def rsi(gain: Column, loss: Column, n: int = 14, w=None) -> Column:
    """Relative strength by simple averages: no move 50, no loss 100."""
    up, down = rolling_mean(gain, n, w), rolling_mean(loss, n, w)
    value = 100.0 - 100.0 / (1.0 + F.try_divide(up, F.nullif(down, F.lit(0.0))))
    return F.when((up == 0) & (down == 0), 50.0).when(down == 0, 100.0).otherwise(clipped(value, 0.0, 100.0))


def with_rsi(df: DataFrame, n: int = 14, close: str = "close", w=None) -> DataFrame:
    return df.withColumns(rsi_inputs(F.col(close), w)).withColumn("rsi_14" if n == 14 else f"rsi_{n}", rsi(F.col("__gain"), F.col("__loss"), n, w)).drop("__gain", "__loss")


def bollinger(close: Column, n: int = 20, width: float = 2.0, w=None) -> dict[str, Column]:
    mid, dev = rolling_mean(close, n, w), rolling_std(close, n, w)
    return {"bb_upper": mid + dev * width, "bb_lower": mid - dev * width, "bb_width": ratio(dev * (2 * width), mid)}


def forward_vol(returns: Column, n: int = 5, w=None) -> Column:
    """Volatility of the next n rows; null unless all are there."""
    return rolling(F.stddev_samp, returns, n, w, 1, n) * ANNUAL


def min_lag(df: DataFrame, days: int, skip: Iterable[str], w=None) -> DataFrame:
    """Every column but those of skip, and but the return lags, moved down by `days` rows of its entity."""
    keep = set(skip)
    if days <= 0:
        return df
    return df.withColumns({c: lag(F.col(c), days, w) for c in df.columns if c not in keep and not c.startswith("log_return_lag_")})


def forward_fill(df: DataFrame, columns: Iterable[str], order: str = "date", partition: Iterable[str] = ()) -> DataFrame:
    """The last value seen. Without a partition all rows meet in one task: for small global series only."""
    w = W.partitionBy(*partition).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def keep_last(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Of rows with equal keys the one with the greatest ordinal, found by partial sums rather than a window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(ordinal)).alias("__row")).select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(df.columns)


def outer_merge(frames: list[DataFrame], key: str = "date") -> DataFrame:
    return reduce(lambda a, b: a.join(b, key, "full"), frames)
