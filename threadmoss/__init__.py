"""threadmoss: time-lapse network growth analytics as Spark jobs."""

__version__ = "0.1.0"
