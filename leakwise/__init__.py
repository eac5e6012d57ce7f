"""PySpark-native secret analytics: findings, suppression, scoring and reports as DataFrames."""
