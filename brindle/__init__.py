"""brindle: an analytics engine of DataFrame, SQL and Structured Streaming plans."""
