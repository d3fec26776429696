"""Spark-native market-data, factor-research and text-feed analytics."""
