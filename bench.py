"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tessera.plans import catalogue

HEADLINE = ("realized_vol", "rolling_moments", "rsi14", "asof_backward_macro", "asof_forward_by_ticker", "price_features_core", "clean_text", "daily_sentiment", "tfidf_vocab", "dedup_keep_last", "corr_matrix", "feature_matrix")


def main() -> None:
    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_suppkey").count().collect()
    took = {}
    for name in HEADLINE:
        begin = time.time()
        catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - begin, 3)
    print(json.dumps({"metric": "headline queries, total seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
