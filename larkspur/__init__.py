"""larkspur: a Spark-first analytics engine for controlled evaluation data."""

__version__ = "0.1.0"
