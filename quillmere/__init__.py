"""quillmere: a search and text-analytics engine built on PySpark DataFrames."""

__version__ = "0.1.0"
