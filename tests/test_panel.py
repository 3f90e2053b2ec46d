import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.config import merged, resolve_split_boundaries
from tessera.functions import text as T
from tessera.functions.scalar import number, timestamp
from tessera.operators import aggregate as A
from tessera.operators import panel as P
from tessera.operators import split, tfidf
from tessera.operators.asof import asof_backward, asof_forward_by, released

CONFIG = {"dates": {"train_end": "2020-12-31", "validation_end": "2021-12-31", "test_end": "2022-12-31"}}
DAY = datetime(2020, 1, 1)


def series(spark, closes, ticker="A"):
    return spark.createDataFrame([(ticker, DAY + timedelta(days=i), c) for i, c in enumerate(closes)], "ticker string, date timestamp, close double")


def test_split_boundaries_are_utc_and_ordered():
    assert resolve_split_boundaries(CONFIG)["train_end"].utcoffset() == timedelta(0)
    with pytest.raises(ValueError, match="train_end < validation_end < test_end"):
        resolve_split_boundaries({"dates": CONFIG["dates"] | {"train_end": "2021-12-31", "validation_end": "2020-12-31"}})


def test_split_labels_and_frames(spark):
    df = spark.createDataFrame([(datetime(2020, 1, 1), 1), (datetime(2020, 12, 30), 2), (datetime(2021, 6, 1), 3), (datetime(2022, 3, 1), 4)], "date timestamp, value long")
    assert [r["dataset_split"] for r in split.assign_temporal_split(df, CONFIG).orderBy("date").collect()] == ["train", "train", "validation", "test"]
    assert [f.count() for f in split.temporal_train_val_test_split(df, CONFIG)] == [2, 1, 1]
    with pytest.raises(ValueError, match="empty"):
        split.temporal_train_val_test_split(df.where("value < 4"), CONFIG)


def test_rolling_needs_all_values(spark):
    out = [r["m"] for r in series(spark, [1.0, None, 3.0, 4.0, 5.0]).select("date", P.rolling_mean(F.col("close"), 3).alias("m")).orderBy("date").collect()]
    assert out == [None, None, None, None, 4.0]


@pytest.mark.parametrize("closes, want", [([float(i) for i in range(1, 17)], 100.0), ([5.0] * 16, 50.0), ([float(i) for i in range(17, 1, -1)], 0.0)])
def test_rsi_ends(spark, closes, want):
    rows = P.with_rsi(series(spark, closes)).orderBy("date").collect()
    assert rows[-1]["rsi_14"] == want and rows[13]["rsi_14"] is None


def test_month_end_ties_take_the_latest_observation(spark):
    m = spark.createDataFrame([(datetime(2020, 1, d), float(d)) for d in (29, 30, 31)] + [(datetime(2020, 3, 31), None)], "date timestamp, x double")
    assert {(r["macro_effective_date"].day, r["macro_x"]) for r in released(m, ["x"]).collect()} == {(29, 31.0), (30, 31.0)}


@pytest.mark.parametrize("deal, sent", [(1, 0), (5, 0), (1, 1000)])
def test_asof_backward_dealt(spark, monkeypatch, deal, sent):
    monkeypatch.setattr("tessera.operators.asof.SENT", sent)
    left = spark.createDataFrame([(i, DAY + timedelta(days=i * 20)) for i in range(8)], "i int, t timestamp")
    right = spark.createDataFrame([(DAY + timedelta(days=d), d) for d in (3, 40, 41, 139)], "eff timestamp, v int")
    got = {r["i"]: r["v"] for r in asof_backward(left, right, "t", "eff", deal=deal).collect()}
    assert got == {0: None, 1: 3, 2: 40, 3: 41, 4: 41, 5: 41, 6: 41, 7: 139}


def test_asof_forward_exact_later_unmapped(spark):
    cal = spark.createDataFrame([("A", DAY), ("A", DAY + timedelta(days=3))], "ticker string, date timestamp")
    news = spark.createDataFrame([(1, "A", DAY), (2, "A", DAY + timedelta(days=1)), (3, "A", DAY + timedelta(days=9)), (4, "B", DAY)], "k int, ticker string, date timestamp")
    got = {r["k"]: r["td"] for r in asof_forward_by(news, cal, "ticker", "date", "date", "td").collect()}
    assert got == {1: DAY, 2: DAY + timedelta(days=3), 3: None, 4: None}


def test_weighted_mean_counts_missing_values_in_the_weight(spark):
    df = spark.createDataFrame([("A", DAY, 2.0, 1), ("A", DAY, None, 3), ("B", DAY, 1.0, None)], "ticker string, date timestamp, m double, news_count int")
    got = {r["ticker"]: (r["m"], r["news_count"], r["source_rows"]) for r in A.weighted_daily(df, means=("m",)).collect()}
    assert got == {"A": (0.5, 4.0, 2), "B": (None, 0.0, 1)}


def test_keep_last_then_positive(spark):
    df = spark.createDataFrame([("A", 1, 5.0), ("A", 2, -1.0), ("B", 1, 3.0)], "ticker string, o int, close double")
    assert [r["ticker"] for r in P.keep_last(df, ["ticker"], "o").where("close > 0").collect()] == ["B"]


def test_text_rules(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.normalize_ticker(F.lit(" brk.b "))) == "BRK" and one(T.normalize_ticker(F.lit("A.B.C"))) == "A.B" and one(T.normalize_ticker(F.lit(None))) == ""
    assert one(T.clean_text(F.lit("Buy $aapl (NASDAQ: msft) now\t All rights reserved."))) == "Buy AAPL MSFT now"
    assert one(T.average_word_length(F.lit(""))) == 0.0 and one(T.word_count(F.lit("a bc"))) == 2
    assert one(T.lexicon_scores(F.lit("nothing here"))["finbert_label"]) == "positive"
    assert one(T.lexicon_scores(F.lit("Loss, loss!"))["finbert_label"]) == "negative"


def test_lenient_coercion(spark):
    df = spark.createDataFrame([(x,) for x in ("abc", "NaN", " 1.5 ", None)], "x string")
    assert [r[0] for r in df.select(number(F.col("x"))).collect()] == [None, None, 1.5, None]
    assert spark.range(1).select(timestamp(F.lit("nope"))).first()[0] is None


def test_missing_share_is_strict(spark):
    df = spark.createDataFrame([(1, None, None), (2, 1, None), (3, None, None), (4, 1, 1)], "date int, half int, more int")
    assert split.drop_high_missing(df, 0.5)[1] == ["more"]


def test_stages_end_to_end(spark, tmp_path):
    from tessera.cli import stages

    raw = tmp_path / "prices"
    raw.mkdir()
    (tmp_path / "macro").mkdir()
    for k, name in enumerate(("aapl", "msft")):
        days = [datetime(2015, 1, 1) + timedelta(days=i) for i in range(90)]
        rows = [f"{d:%Y-%m-%d},{10 + i % 7 + k},{12 + i % 7},{9 + i % 7},{10 + (i * 3) % 5 + k},{i}" for i, d in enumerate(days)]
        (raw / f"{name}.us.txt").write_text("\n".join(["Date,Open,High,Low,Close,Volume", *rows]))
    (tmp_path / "news.csv").write_text('headline,date,stock\n"Big, gain",2015-01-03,AAPL\nloss,2015-02-03,MSFT\n')
    for s in ("VIXCLS", "DGS10", "UNRATE", "CPIAUCSL"):
        (tmp_path / "macro" / f"{s}.csv").write_text(f"DATE,{s}\n2015-01-01,1.5\n2015-02-01,.\n")
    paths = {k: str(tmp_path / k) for k in ("interim_prices", "interim_news", "macro_indicators", "price_features", "news_features", "feature_matrix", "pipeline_model", "reports")}
    config = merged({
        "paths": paths | {"raw_prices_dir": str(raw), "raw_news": str(tmp_path / "news.csv"), "raw_macro_dir": str(tmp_path / "macro")},
        "dates": {"end": "2015-03-31", "train_end": "2015-02-15", "validation_end": "2015-03-10", "test_end": "2015-03-31"},
        "validation": {"min_rows_prices": 1, "min_rows_news": 1, "min_tickers": 1},
    })
    todo = stages(spark, config)
    for name in ("ingest", "timeseries", "nlp", "integrate", "eda", "validate"):
        todo[name]()
    m = spark.read.parquet(paths["feature_matrix"])
    assert m.count() > 100 and {"macro_VIXCLS", "news_count", "rsi_14"} <= set(m.columns)
    report = (tmp_path / "reports" / "validation_report.html").read_text()
    assert "rows of train" in report
    from tessera.plans import features as X

    read = lambda name: spark.read.parquet(paths[name])
    errors = X.validation_errors(read("interim_prices"), read("interim_news"), m, config, "strict", read("macro_indicators"))
    assert not [e for e in errors if "order" in e or "UTC" in e or "repeat" in e]
    falling = str(tmp_path / "falling")
    m.coalesce(1).sortWithinPartitions(F.desc("date")).write.parquet(falling)
    doubled = read("macro_indicators").unionByName(read("macro_indicators"))
    errors = X.validation_errors(read("interim_prices"), read("interim_news"), spark.read.parquet(falling), config, "strict", doubled)
    assert any("matrix: dates of 2 entities" in e for e in errors) and any("macro" in e and "repeat" in e for e in errors)


def test_asof_forward_of_a_busy_entity_is_one_pass(spark):
    rows = spark.range(200_000).select(F.lit("a").alias("ticker"), (F.lit(DAY).cast("timestamp") + F.make_dt_interval(secs="id")).alias("date"))
    begin = time.time()
    out = asof_forward_by(rows, rows.where("pmod(unix_seconds(date), 100) = 0"), "ticker", "date", "date", "td")
    assert out.where("td < date or td - date >= INTERVAL 100 SECONDS").count() == 0 and time.time() - begin < 60


@pytest.mark.parametrize("sent", [0, 1000])
def test_asof_plans_have_no_nested_loop(spark, monkeypatch, sent):
    monkeypatch.setattr("tessera.operators.asof.SENT", sent)
    left = spark.createDataFrame([(1, DAY), (2, None), (3, DAY - timedelta(days=400)), (4, DAY + timedelta(days=900))], "k int, date timestamp")
    right = spark.createDataFrame([(DAY - timedelta(days=40), 1), (DAY, 2), (None, 9)], "eff timestamp, v int")
    out = asof_backward(left, right, "date", "eff")
    assert "NestedLoop" not in out._jdf.queryExecution().toString()
    assert {r["k"]: r["v"] for r in out.collect()} == {1: 2, 2: None, 3: None, 4: 2}
    assert {r["v"] for r in asof_backward(left, right.limit(0), "date", "eff").collect()} == {None}


@pytest.mark.parametrize("most", [0, 3, 8])
def test_tfidf_leaves_nothing_out(spark, most):
    """The vocabulary against a plain count of all words and pairs; the normalised form against its definition."""
    from collections import Counter

    texts = ["a b c", "a b", "a b d a b", "c a", "d d d b a", "", "e f"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    df = Counter(x for t in texts for x in {*t.split(), *map(" ".join, zip(t.split(), t.split()[1:]))})
    want = sorted(df.items(), key=lambda x: (-x[1], x[0]))[: most or None]
    got = tfidf.fit(docs, "t", most, (1, 2))
    assert [(r["term"], r["df"]) for r in got.orderBy("idx").collect()] == want and {r["idx"] for r in got.collect()} == set(range(len(want)))
    docs = docs.withColumn("t", F.regexp_replace("t", "([a-f])", "$1$1"))
    weights = tfidf.transform(docs, "t", "k", tfidf.fit(docs, "t", most, form="l2"), form="l2").groupBy("k").agg(F.sum(F.col("weight") ** 2)).collect()
    assert weights and all(abs(r[1] - 1) < 1e-9 for r in weights)


def test_split_assertion_and_profile(spark, caplog):
    df = spark.createDataFrame([(datetime(2020, 1, 1),), (datetime(2022, 2, 1),)], "date timestamp")
    split.assert_temporal_split(df, CONFIG)
    assert "validation" in caplog.text
    with pytest.raises(ValueError):
        split.assert_temporal_split(df.limit(0), CONFIG)
    rows = {r["column"]: r for r in A.profile(spark.createDataFrame([(1, "x"), (3, None)], "n int, s string"), exact=True).collect()}
    assert (rows["n"]["mean"], rows["n"]["distinct"], rows["s"]["nulls"], rows["s"]["max_text"]) == (2.0, 2, 1, "x")


def test_failures_of_the_model_in_the_executors_fall_back(spark, monkeypatch):
    from tessera.operators import sentiment

    def broken(model, **options):
        return lambda df, text: df.withColumn("x", F.raise_error(F.lit("no memory")).cast("int"))

    monkeypatch.setattr(sentiment, "transformer_scorer", broken)
    df = spark.createDataFrame([("gain",)], "cleaned_text string")
    assert sentiment.score_texts(df, model="m").first()["finbert_label"] == "positive"


@pytest.mark.parametrize("query, trees", [("baseline_mae", 300), ("gbt_mae", 300)])
def test_registered_baselines_have_no_caps(monkeypatch, query, trees):
    import inspect

    from tessera.operators import ml
    from tessera.plans import catalogue

    signature, seen = inspect.signature(ml.run_baselines), {}

    def spy(*args, **options):
        bound = signature.bind(*args, **options)
        bound.apply_defaults()
        seen.update(bound.arguments)
        return ml.BaselineArtifacts(None, None)

    monkeypatch.setattr(catalogue, "_matrix", lambda spark, d: [None])
    monkeypatch.setattr(ml, "run_baselines", spy)
    catalogue.QUERIES[query](None, "")
    assert seen["max_train_rows"] is None and seen["trees"] == trees


ODD = ["", None, " ", "\n  ", "x\x0by the", "a the of", "Buy (NASDAQ: msft) now", "All Rightſ Reſerved. x", "For more details clicK here. x", "for moreReporting by X. details click here now. y", "a $aapl $9 $ $$x$abcdefghijklmn$é", "İb ΟΣ. the", "...the... (of) \"and\" 'to' the!! ,.x,. a.b a,,b ,,", "\x1cTHE\x1dof\x1f", "  a \r\n\n b  "]


def against_sql(spark, folder, query, tables):
    """Rows of the query and of its SQL."""
    import duckdb

    from tessera.plans import catalogue

    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    want = con.execute(catalogue.ORACLES[query])
    got = [tuple(r) for r in catalogue.QUERIES[query](spark, str(folder)).select([c[0] for c in want.description]).collect()]
    return sorted(got, key=repr), sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("query", ["clean_text", "text_metrics", "lexicon_sentiment", "daily_sentiment", "tfidf_vocab", "tfidf_top_terms"])
def test_text_queries_equal_their_sql_on_odd_texts(spark, tmp_path, query):
    import pandas as pd

    pd.DataFrame({"doc_id": range(len(ODD)), "text": ODD, "source": "web"}).to_parquet(tmp_path / "documents.parquet")
    got, want = against_sql(spark, tmp_path, query, ["documents"])
    assert got == want


def test_feature_matrix_equals_its_sql_on_odd_texts(spark, tmp_path):
    import pandas as pd

    pd.DataFrame({"doc_id": range(100 * len(ODD)), "text": [t for t in ODD for _ in range(100)], "source": "web"}).to_parquet(tmp_path / "documents.parquet")
    for t in ("lineitem", "orders"):  # tables of the driver
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    got, want = against_sql(spark, tmp_path, "feature_matrix", ["documents", "lineitem", "orders"])
    assert got == want


def test_rounding_is_that_of_sql(spark):
    import duckdb

    from tessera.plans.catalogue import _round

    pairs = [(9882, 1600), (4673, 800), (5173, 800), (1, 32), (-1, 32), (1013, 160)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a long, b long").select(_round(F.col("a").cast("double") / F.col("b"), 4)).collect()]
    assert got == [duckdb.execute("select round(?::double / ?, 4)", p).fetchone()[0] for p in pairs]


def test_unit_root_lags_come_from_one_factorisation(monkeypatch):
    import numpy as np

    from tessera.operators import ml

    x, calls, solve = np.cumsum(np.random.default_rng(1).normal(size=400)), [], np.linalg.lstsq
    monkeypatch.setattr(np.linalg, "lstsq", lambda *a, **k: calls.append(1) or solve(*a, **k))
    p = ml.adf_p_value(x)
    assert len(calls) == 1
    monkeypatch.setattr(np.linalg, "qr", lambda a: (np.zeros_like(a), np.zeros((a.shape[1], a.shape[1]))))  # each regression by itself
    assert ml.adf_p_value(x) == p and len(calls) > 15


@pytest.mark.parametrize("kept", [0, 3, 10_000])
def test_exact_medians_are_those_of_spark(spark, monkeypatch, kept):
    from tessera.operators import ml

    monkeypatch.setattr(ml, "KEPT", kept)
    rows = [((i * 7919) % 1001 / 7, float(i % 2), None if i % 3 else float(i), 0.0 if i < 502 else i * 1.5, None, i) for i in range(1003)]
    df = spark.createDataFrame(rows, "a double, tie double, gaps double, half double, none double, n long")
    want = df.agg(*[F.median(F.col(c).cast("double")).alias(c) for c in df.columns]).first().asDict()
    assert ml.exact_medians(df, df.columns) == want
    assert ml.exact_medians(df.limit(1), ["a", "none"]) == {"a": 0.0, "none": None}


@pytest.mark.parametrize("keys", [range(6), [0, 0, 1, 2, 2, 3]])
def test_top_terms_by_document_equal_those_of_the_weights(spark, monkeypatch, keys):
    texts = ["a b c", "a b", "b b d a b", "", "d d x a", "c a b"]
    docs = spark.createDataFrame(list(zip(keys, texts)), "k int, t string")
    vocabulary = tfidf.fit(docs, "t", 5)
    got = tfidf.top_terms(docs, "t", "k", vocabulary)
    assert (tfidf._few_sums(docs, "t", "k", vocabulary) is None) == (len(set(keys)) < 6)
    monkeypatch.setattr(tfidf, "SMALL", 0)
    want = tfidf.top_terms(docs, "t", "k", tfidf.fit(docs, "t", 5))
    assert [(r[0], round(r[1], 12)) for r in got.collect()] == [(r[0], round(r[1], 12)) for r in want.collect()]


def test_words_are_counted_once_for_all_scores(spark):
    from tessera.operators import sentiment

    docs = spark.createDataFrame([("the of",), ("and",)], "cleaned_text string").repartition(1)
    out = A.daily_sentiment(sentiment.score_lexicon(docs, positive="the of", negative="and to").selectExpr("*", "'a' as ticker", "current_date() as date", "1 as char_count", "1 as word_count", "1.0 as avg_word_length"))
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("tanh(") == 1
