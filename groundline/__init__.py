"""groundline: a Spark-native point-cloud, raster and vector analytics engine."""
