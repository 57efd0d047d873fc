"""claimflow: document analytics for healthcare billing paperwork on Spark DataFrames."""

__version__ = "0.1.0"
