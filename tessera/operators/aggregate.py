"""Aggregations: weighted means, profiles, correlations, gaps, histograms."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.scalar import ratio

NEWS_MEANS = ("finbert_sentiment_mean", "finbert_pct_positive", "finbert_pct_negative", "finbert_pct_neutral", "char_count_mean", "word_count_mean", "avg_word_length_mean")


def share(predicate: Column) -> Column:
    return F.avg(F.coalesce(predicate, F.lit(False)).cast("double"))


def daily_sentiment(df: DataFrame) -> DataFrame:
    """One row per entity and day of scored texts."""
    label = F.col("finbert_label")
    return df.groupBy("ticker", "date").agg(
        F.avg("finbert_sentiment_score").alias("finbert_sentiment_mean"),
        *[share(label == k).alias(f"finbert_pct_{k}") for k in ("positive", "negative", "neutral")],
        F.count(F.lit(1)).alias("news_count"),
        *[F.avg(c).alias(f"{c}_mean") for c in ("char_count", "word_count", "avg_word_length")],
    )


def weighted_mean(x: str, weight: Column) -> Column:
    """sum(x w) / sum(w); a missing x still counts in the weight, and no weight gives null."""
    return ratio(F.coalesce(F.sum(F.col(x) * weight), F.lit(0.0)), F.sum(weight))


def weighted_daily(df: DataFrame, date: str = "date", means=NEWS_MEANS, rows: str | None = None) -> DataFrame:
    """Means of each entity and day weighted by news_count, its sum, and how many rows went in (source_rows)."""
    weight = F.coalesce(F.col("news_count").cast("double"), F.lit(0.0))
    went_in = F.count(F.lit(1)) if rows is None else F.sum(rows)
    return df.groupBy("ticker", F.date_trunc("day", date).alias("date")).agg(*[weighted_mean(c, weight).alias(c) for c in means], F.sum(weight).alias("news_count"), went_in.alias("source_rows"))


def null_fractions(df: DataFrame) -> DataFrame:
    """(column, null_fraction) of all columns, in one pass."""
    one = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "column", "null_fraction")


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows repeat an earlier one's keys; nulls are equal."""
    return df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) of all pairs of columns, over the rows that have both, in one pass."""
    pairs = list(combinations_with_replacement(columns, 2))
    one = df.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("corr")) for k, (a, b) in enumerate(pairs)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def date_overlap(left: DataFrame, right: DataFrame, names=("prices", "news"), date: str = "date") -> DataFrame:
    """One row: both ranges and what they share."""
    a, b = names
    ends = lambda df, n: df.agg(F.min(date).alias(f"{n}_min"), F.max(date).alias(f"{n}_max"))
    both = ends(left, a).join(ends(right, b))  # one row each
    both = both.withColumns({"overlap_start": F.greatest(f"{a}_min", f"{b}_min"), "overlap_end": F.least(f"{a}_max", f"{b}_max")})
    return both.withColumn("has_overlap", F.col("overlap_start") <= F.col("overlap_end"))


def missing_days(df: DataFrame, threshold: float = 0.2, entity: str = "ticker", date: str = "date") -> DataFrame:
    """Entities that lack more than `threshold` of all days."""
    days = df.select(entity, date).distinct()
    total = days.select(date).distinct().agg(F.count(F.lit(1)).alias("expected_days"))
    own = days.groupBy(entity).agg(F.count(date).alias("actual_days"))
    out = own.join(F.broadcast(total)).withColumn("missing_days", F.col("expected_days") - F.col("actual_days"))  # total: one row
    out = out.withColumn("missing_pct", F.coalesce(F.try_divide(F.col("missing_days").cast("double"), F.col("expected_days").cast("double")), F.lit(0.0)))
    return out.where(F.col("missing_pct") > threshold).select(entity, "expected_days", "actual_days", "missing_days", "missing_pct")


def pareto(df: DataFrame, entity: str = "ticker", top: int = 100) -> DataFrame:
    """The largest entities by rows with their cumulative share of all rows."""
    sizes = df.groupBy(entity).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n").alias("__total"))
    best = sizes.orderBy(F.desc("n"), entity).limit(top)
    w = W.orderBy(F.desc("n"), entity).rowsBetween(W.unboundedPreceding, 0)
    return best.withColumn("__run", F.sum("n").over(w)).join(F.broadcast(total)).select(entity, "n", (F.col("__run") / F.col("__total")).alias("cumulative_share"))  # total: one row


def histogram(df: DataFrame, column: str, bins: int = 80) -> DataFrame:
    """(bin, n) over equal widths between the least and the greatest value; the last bin is closed."""
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    place = F.when(F.col("lo") == F.col("hi"), F.lit(1)).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)) + 1, F.lit(bins)))
    return x.join(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # ends: one row


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def top_mode(df: DataFrame, column: str):
    """The most frequent value, the smallest on ties; None for no rows."""
    row = value_counts(df.where(F.col(column).isNotNull()), column).orderBy(F.desc("n"), column).first()
    return row[column] if row else None


def top_k(df: DataFrame, by: str, k: int, ties: list[str]) -> DataFrame:
    """The k rows with the greatest `by`, in order; ties by the columns given."""
    return df.orderBy(F.desc(by), *ties).limit(k)


def profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """(column, nulls, distinct, min_text, max_text, mean) of all columns, in one pass; distinct counts are sketches (2 % error) unless exact."""
    numbers = ("integer", "long", "double", "float", "short", "byte", "decimal")
    parts, rows = [], []
    for k, f in enumerate(df.schema):
        c = F.col(f"`{f.name}`")
        mean = F.avg(c.cast("double")) if f.dataType.typeName() in numbers else F.lit(None).cast("double")
        distinct = F.count_distinct(c) if exact else F.approx_count_distinct(c, 0.02)
        own = {"nulls": F.count_if(c.isNull()), "distinct": distinct, "min_text": F.min(c.cast("string")), "max_text": F.max(c.cast("string")), "mean": mean}
        parts += [v.alias(f"{n}{k}") for n, v in own.items()]
        rows.append(F.struct(F.lit(f.name).alias("column"), *[F.col(f"{n}{k}").alias(n) for n in own]))
    return df.agg(*parts).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def sample_rows(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """n rows chosen by a hash of their keys: the same on every run."""
    return df.orderBy(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)), *keys).limit(n)


def out_of_order(df: DataFrame, entity: str, date: str, ordinal: str) -> DataFrame:
    """One row: entities whose dates fall somewhere in the order of `ordinal`."""
    w = W.partitionBy(entity).orderBy(ordinal)
    falls = df.withColumn("__fall", F.lag(date).over(w) > F.col(date)).groupBy(entity).agg(F.max(F.coalesce("__fall", F.lit(False))).alias("bad"))
    return falls.agg(F.count_if("bad").alias("unordered_entities"))
