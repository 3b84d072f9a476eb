"""Windowed quantile analytics and training-data preparation on PySpark."""
