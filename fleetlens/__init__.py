"""Fleet hardware-telemetry analytics on Spark DataFrames."""
