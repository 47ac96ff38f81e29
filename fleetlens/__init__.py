"""Fleet telemetry and result validation on Spark DataFrames."""
