"""regionlake: region algebra, profile analytics and numeric kernels on Spark DataFrames."""
