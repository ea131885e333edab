"""cloudframe: Spark-native operators for 3D point tables and pose time series."""
