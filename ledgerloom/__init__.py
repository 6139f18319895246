"""ledgerloom: engagement analytics on Spark DataFrames."""
