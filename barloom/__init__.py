"""A Spark-native engine for bar series: indicators, scripts and streams as DataFrame plans."""
