"""Analytics over ordered text streams, written for Spark's DataFrame API."""
