"""Time-series forecasting analytics as PySpark DataFrame operators."""
