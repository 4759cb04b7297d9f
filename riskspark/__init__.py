"""PySpark-native analytics for risk scores on large case/control tables."""
