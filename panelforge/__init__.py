"""A PySpark-native engine for daily-bar panels, quantile forecasts and books."""
