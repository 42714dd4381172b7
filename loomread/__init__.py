"""Analytics over very large collections of short, keyed sequences, as Spark DataFrame jobs."""
