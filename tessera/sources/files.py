"""Readers and writers of the raw and derived tables."""

from __future__ import annotations

import html as escaping
import logging
from pathlib import Path
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import merged
from tessera.functions import text as T
from tessera.functions.scalar import in_range, is_zero, number, timestamp
from tessera.operators.panel import keep_last, outer_merge
from tessera.schema import add_missing, lower_names, missing_columns, rename_synonyms, require_columns

log = logging.getLogger(__name__)
BAR = ("date", "open", "high", "low", "close", "volume")


def price_files(raw_dir: str, tickers: list[str] | None = None, suffix: str = ".us.txt") -> list[str]:
    """All files of the folder, or those of the tickers; tickers without a file are warned of."""
    found = {p.name[: -len(suffix)].upper(): str(p) for p in sorted(Path(raw_dir).glob(f"*{suffix}"))}
    if tickers is None:
        return list(found.values())
    if absent := [t for t in tickers if t.upper() not in found]:
        log.warning("no price file for %s", ", ".join(absent))
    return [found[t.upper()] for t in tickers if t.upper() in found]


def read_prices(spark: SparkSession, files: list[str], start, end, suffix: str = ".us.txt") -> DataFrame:
    """Bars from one file per ticker. Files are grouped by header and delimiter, since a scan binds one header.

    Of repeated days the last line stays, then bars without a positive close go. A file without the columns of a bar
    is left out.
    """
    groups: dict[tuple[str, str], list[str]] = {}
    for f in files:
        with open(f, encoding="utf-8", errors="replace") as lines:
            first = lines.readline().rstrip("\n")
        groups.setdefault((first, "," if "," in first else "\t"), []).append(f)
    frames = []
    for (_, delimiter), own in groups.items():
        raw = spark.read.option("header", True).option("sep", delimiter).option("ignoreCorruptFiles", True).csv(own)
        raw = raw.withColumns({"__file": F.col("_metadata.file_name"), "__line": F.monotonically_increasing_id()})
        raw = lower_names(raw)
        if absent := missing_columns(raw, BAR):
            log.warning("left out %d files without %s", len(own), ", ".join(absent))
            continue
        ticker = F.upper(F.regexp_replace("__file", rf"{suffix.replace('.', '[.]')}$", ""))
        bars = raw.select(ticker.alias("ticker"), timestamp(F.col("date")).alias("date"), *[number(F.col(c)).alias(c) for c in BAR[1:]], "__line")
        frames.append(bars.where(F.col("date").isNotNull() & in_range(F.col("date"), start, end)).dropna(subset=list(BAR)))
    if not frames:
        raise FileNotFoundError("no readable price file")
    from tessera.operators.ml import union_all

    last = keep_last(union_all(frames), ["ticker", "date"], "__line").where("close > 0")
    floats = [F.col(c).cast("float").alias(c) for c in BAR[1:5]]
    return last.select("ticker", "date", *floats, "volume", is_zero(F.col("volume")).cast("tinyint").alias("volume_zero_flag"))


def prepare_news(raw: DataFrame, start, end) -> DataFrame:
    """Names, synonyms, absent columns, tickers, dates, range, text source."""
    df = rename_synonyms(lower_names(raw))
    require_columns(df, ("date", "ticker", "title"), "news")
    df = add_missing(df, ("article", "url", "publisher"))
    df = df.select(T.normalize_ticker(F.col("ticker")).alias("ticker"), timestamp(F.col("date")).alias("date"), *[F.col(c).cast("string").alias(c) for c in ("title", "article", "url", "publisher")])
    return df.where(in_range(F.col("date"), start, end) & (F.col("ticker") != "")).withColumn("text_source", T.text_source(F.col("article")))


def read_news(spark: SparkSession, path: str, start, end) -> DataFrame:
    return prepare_news(spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path), start, end)


def prepare_series(raw: DataFrame, name: str) -> DataFrame:
    """(date, name) from a table with some date column and the series, or any other column, as its value."""
    date = next((c for c in ("observation_date", "DATE", "date", "Date") if c in raw.columns), None)
    value = name if name in raw.columns else next((c for c in raw.columns if c != date), None)
    if date is None or value is None:
        raise ValueError(f"{name}: no date or value column")
    return raw.select(timestamp(F.col(date)).alias("date"), number(F.col(value)).alias(name)).where("date is not null")


def read_series(spark: SparkSession, name: str, raw_dir: str | None = None, url: str | None = None) -> DataFrame:
    """A CSV series from a folder, or fetched by the driver from a url with the name filled in."""
    if raw_dir and (path := Path(raw_dir) / f"{name}.csv").exists():
        return prepare_series(spark.read.option("header", True).csv(str(path)), name)
    if not url:
        raise FileNotFoundError(f"no file for series {name}")
    lines = urlopen(url.format(name), timeout=30).read().decode("utf-8").splitlines()  # noqa: S310
    header, *rows = [line.split(",") for line in lines if line]
    return prepare_series(spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in header)), name)


def write_parquet(df: DataFrame, path: str) -> str:
    """Overwrite by writing beside and swapping, so that a table may be read while it is rewritten."""
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    new, old = f"{path.rstrip('/')}__new", f"{path.rstrip('/')}__old"
    df.write.mode("overwrite").parquet(new)
    fs.delete(fs_path(old), True)
    if fs.exists(fs_path(path)):
        fs.rename(fs_path(path), fs_path(old))
    fs.rename(fs_path(new), fs_path(path))
    fs.delete(fs_path(old), True)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_csv(df: DataFrame, path: str) -> None:
    """A report table: small by construction."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    df.toPandas().to_csv(path, index=False)


def write_markdown(title: str, tables: dict[str, DataFrame], path: str, notes: list[str] | None = None) -> None:
    lines = [f"# {title}", "", *(notes or []), *[""] * bool(notes)]
    for name, df in tables.items():
        lines += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        lines += ["| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in df.collect()] + [""]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("\n".join(lines), encoding="utf-8")


def write_html(title: str, sections: dict[str, dict], errors: list[str], path: str) -> None:
    cell = lambda v: escaping.escape(str(v))
    parts = [f"<html><body><h1>{cell(title)}</h1><p>{'FAILED' if errors else 'PASSED'}</p>"]
    parts += [f"<ul>{''.join(f'<li>{cell(e)}</li>' for e in errors)}</ul>"] if errors else []
    for name, rows in sections.items():
        parts.append(f"<h2>{cell(name)}</h2><table>" + "".join(f"<tr><td>{cell(k)}</td><td>{cell(v)}</td></tr>" for k, v in rows.items()) + "</table>")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("".join(parts) + "</body></html>", encoding="utf-8")


def load_prices(spark: SparkSession, config: dict, tickers: list[str] | None = None) -> str:
    c = merged(config)
    files = price_files(c["paths"]["raw_prices_dir"], tickers)
    return write_parquet(read_prices(spark, files, c["dates"]["start"], c["dates"]["end"]), c["paths"]["interim_prices"])


def load_news(spark: SparkSession, config: dict) -> str:
    c = merged(config)
    return write_parquet(read_news(spark, c["paths"]["raw_news"], c["dates"]["start"], c["dates"]["end"]), c["paths"]["interim_news"])


def fetch_macro(spark: SparkSession, config: dict, url: str | None = None) -> str:
    """All series side by side by date; an existing table is kept as it is."""
    c = merged(config)
    path = c["paths"]["macro_indicators"]
    if exists(spark, path):
        return path
    series = [read_series(spark, s, c["paths"].get("raw_macro_dir"), url) for s in c["macro"]["fred_series"].values()]
    return write_parquet(outer_merge(series).where(in_range(F.col("date"), c["dates"]["start"], c["dates"]["end"])), path)
