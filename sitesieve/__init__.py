"""sitesieve: audits of stored web captures as Spark jobs."""

__version__ = "0.1.0"
