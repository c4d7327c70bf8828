"""Record-density analytics on Spark: a batch engine built from DataFrame plans."""

__version__ = "0.1.0"
