"""ocrlake: search, reconciliation, queueing and cleaning of text extracted from image files, on Spark."""

__version__ = "0.1.0"
