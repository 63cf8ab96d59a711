"""Fleet and batch analytics as Spark DataFrames and streams."""
