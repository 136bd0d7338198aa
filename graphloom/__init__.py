"""graphloom: text tables to scored knowledge graphs, and graph analysis, on Spark DataFrames."""

__version__ = "0.1.0"
