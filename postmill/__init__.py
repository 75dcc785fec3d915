"""Job-market analytics as DataFrame-in / DataFrame-out Spark operators."""
