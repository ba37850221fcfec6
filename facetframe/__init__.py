"""Analytics over tables that mix text with ordinary columns, as Spark DataFrames."""
