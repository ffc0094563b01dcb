"""panelcast: Spark-native analytics and forecasting for large daily panels."""

__version__ = "0.1.0"
