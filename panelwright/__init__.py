"""Factor research and portfolio analytics on long asset panels, on Spark."""
