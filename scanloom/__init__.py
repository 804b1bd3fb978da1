"""scanloom: PNG analytics on Spark, from chunk framing to pixels."""
