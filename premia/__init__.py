"""premia: pricing-evidence data work as Spark DataFrame, SQL and streaming jobs."""
