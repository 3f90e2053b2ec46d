"""Panel engine: operators."""
