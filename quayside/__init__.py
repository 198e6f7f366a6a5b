"""Supply-chain analytics on Spark."""
