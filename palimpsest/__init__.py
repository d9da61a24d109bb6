"""Analytics over versioned document corpora, expressed as lazy Spark DataFrames."""
