"""lodestone: a PySpark-native analytics and statistical-learning engine."""
