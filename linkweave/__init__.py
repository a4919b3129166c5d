"""Entity resolution and corpus preparation on Spark."""
