"""Analytics over assessment documents, as Spark DataFrames."""
