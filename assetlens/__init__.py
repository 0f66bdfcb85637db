"""assetlens: a Spark-native analytics engine for media archives."""
