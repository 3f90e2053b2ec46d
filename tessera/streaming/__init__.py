"""Panel engine: streaming."""
