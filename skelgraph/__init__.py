"""Analytics over collections of small typed vector maps, as Spark DataFrames."""
