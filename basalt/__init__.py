"""Analytics over source-code and text corpora, as Spark DataFrame, SQL and Structured Streaming queries."""
