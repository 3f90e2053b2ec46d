"""Declarative data quality: expectations are counts of failing rows, all in one aggregation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ValidationError(RuntimeError):
    """All failed checks, joined."""


@dataclass(frozen=True)
class Expectation:
    name: str
    failing: Column


def not_null(c: str, where: Column | None = None) -> Expectation:
    return Expectation(f"{c} is not null", F.col(c).isNull() if where is None else F.col(c).isNull() & where)


def above(c: str, low: float) -> Expectation:
    return Expectation(f"{c} > {low:g}", F.col(c) <= low)


def after(a: str, b: str) -> Expectation:
    return Expectation(f"{a} > {b}", F.col(a) <= F.col(b))


def member(c: str, values) -> Expectation:
    return Expectation(f"{c} in set", ~F.coalesce(F.col(c).isin(list(values)), F.lit(False)))


def matches(c: str, predicate: Column) -> Expectation:
    return Expectation(f"{c} has its form", ~F.coalesce(predicate, F.lit(False)))


def evaluate(df: DataFrame, expectations: list[Expectation]) -> DataFrame:
    """(expectation, failing, success), one row each, from one pass over df."""
    one = df.agg(*[F.count_if(e.failing).alias(f"e{k}") for k, e in enumerate(expectations)])
    rows = [F.struct(F.lit(e.name).alias("expectation"), F.col(f"e{k}").alias("failing"), (F.col(f"e{k}") == 0).alias("success")) for k, e in enumerate(expectations)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def failures(df: DataFrame, expectations: list[Expectation]) -> list[str]:
    return [f"{r['expectation']}: {r['failing']} rows fail" for r in evaluate(df, expectations).where(~F.col("success")).collect()]


def is_utc_timestamp(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.TimestampType) and df.sparkSession.conf.get("spark.sql.session.timeZone") == "UTC"


def summary(df: DataFrame, label: str = "dataset_split") -> dict[str, object]:
    """Rows, columns, rows by label, and the null fraction of each column that has nulls; two passes."""
    from tessera.operators.aggregate import null_fractions

    parts = {str(r[label]): r["count"] for r in df.groupBy(label).count().collect()} if label in df.columns else {}
    lost = {r["column"]: round(r["null_fraction"], 6) for r in null_fractions(df).where("null_fraction > 0").collect()}
    return {"rows": sum(parts.values()) if parts else df.count(), "columns": len(df.columns), **{f"rows of {k}": n for k, n in sorted(parts.items())}, **{f"nulls of {k}": x for k, x in sorted(lost.items())}}


def date_range_errors(df: DataFrame, name: str, start, end, label: str, start_days: int = 7, end_days: int = 0) -> list[str]:
    """Coverage from start + start_days at the latest to end - end_days at the least."""
    low, high = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    row = df.agg(
        F.min(name).alias("lo"),
        F.max(name).alias("hi"),
        (F.min(name) > low + F.make_dt_interval(days=F.lit(start_days))).alias("late"),
        (F.max(name) < high - F.make_dt_interval(days=F.lit(end_days))).alias("early"),
    ).first()
    if row["lo"] is None:
        return [f"{label}: no dates"]
    return [f"{label}: starts at {row['lo']}"] * row["late"] + [f"{label}: ends at {row['hi']}"] * row["early"]


def leaking_rows(df: DataFrame, target: str = "target_start_date", date: str = "date") -> DataFrame:
    """One row: how many targets start at or before their features."""
    return df.agg(F.count_if(F.col(target) <= F.col(date)).alias("failing"))


def assert_anti_leakage(df: DataFrame) -> None:
    if bad := leaking_rows(df).first()["failing"]:
        raise ValidationError(f"{bad} targets start at or before their features")


def missingness(frames: dict[str, DataFrame]) -> DataFrame:
    """(dataset, column, missing_pct, likely_mechanism, proposed_treatment) of columns with nulls, most missing first."""
    from tessera.operators.aggregate import null_fractions

    rows = [null_fractions(df).withColumn("dataset", F.lit(name)) for name, df in frames.items()]
    article = (F.col("dataset") == "news") & (F.col("column") == "article")
    returns = (F.col("dataset") == "prices") & (F.col("column") == "log_return")
    return (
        reduce(DataFrame.unionByName, rows)
        .where("null_fraction > 0")
        .select(
            "dataset",
            "column",
            F.col("null_fraction").alias("missing_pct"),
            F.when(article, "MAR").when(returns, "MNAR").otherwise("MCAR").alias("likely_mechanism"),
            F.when(article, "use the title").when(returns, "keep null on an entity's first row").otherwise("keep; impute with the features").alias("proposed_treatment"),
        )
        .orderBy(F.desc("missing_pct"), "dataset", "column")
    )


def data_dictionary(name: str, df: DataFrame, notes: dict[str, str] | None = None) -> DataFrame:
    from tessera.operators.aggregate import null_fractions

    kinds = F.create_map(*[F.lit(x) for f in df.schema for x in (f.name, f.dataType.simpleString())])
    texts = F.create_map(*[F.lit(x) for f in df.schema for x in (f.name, (notes or {}).get(f.name, ""))])
    return null_fractions(df).select(F.lit(name).alias("dataset"), "column", kinds[F.col("column")].alias("dtype"), "null_fraction", texts[F.col("column")].alias("note"))
