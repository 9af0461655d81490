"""tidepanel: market-panel analytics expressed as Spark DataFrame jobs."""
