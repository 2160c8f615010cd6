"""spectrail: analytics for peptide search results on Spark DataFrames."""

__version__ = "0.1.0"
