"""Panel engine: sources."""
