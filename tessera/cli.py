"""python -m tessera.cli --config FILE --stage STAGE [--dev] [--validation-level LEVEL]"""

from __future__ import annotations

import argparse

from tessera.config import DEFAULTS, load_config
from tessera.plans import features as X
from tessera.session import session
from tessera.sources import files


def stages(spark, config: dict, dev: bool = False, level: str | None = None) -> dict:
    def ingest():
        files.load_prices(spark, config, config["tickers"]["dev_subset"] if dev else None)
        files.load_news(spark, config)
        files.fetch_macro(spark, config)

    def nlp():
        X.clean_news(spark, config)
        X.run_sentiment(spark, config)

    return {
        "ingest": ingest,
        "eda": lambda: X.run_diagnostic_eda(spark, config),
        "timeseries": lambda: X.build_price_features(spark, config),
        "nlp": nlp,
        "integrate": lambda: X.save_feature_matrix(X.join_all_sources(spark, config)[0], config),
        "validate": lambda: X.run_all_validations(spark, config, level),
    }


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--config")
    ap.add_argument("--stage", default="all", choices=["all", "ingest", "eda", "timeseries", "nlp", "integrate", "validate"])
    ap.add_argument("--dev", action="store_true")
    ap.add_argument("--validation-level", choices=["basic", "strict"])
    args = ap.parse_args(argv)
    config = load_config(args.config) if args.config else DEFAULTS
    todo = stages(session(), config, args.dev, args.validation_level)
    for name in todo if args.stage == "all" else [args.stage]:
        todo[name]()


if __name__ == "__main__":
    main()
