"""Building, auditing and evaluating typed-decision datasets on Spark."""

__version__ = "0.1.0"
