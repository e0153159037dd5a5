"""titlelab: job-title classification jobs as Spark DataFrame code."""

__version__ = "0.1.0"
