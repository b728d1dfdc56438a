"""labelbench: labelled-text preparation, vector pooling, classifier metrics and
experiment-run analysis as Spark DataFrame jobs."""

__version__ = "0.1.0"
