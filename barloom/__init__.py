"""barloom: ordered, keyed time series and event streams as lazy PySpark plans."""

__version__ = "0.1.0"
