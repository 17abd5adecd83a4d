"""A PySpark-native engine for reconciling itemised schedules, event logs and documents."""

__version__ = "0.1.0"
