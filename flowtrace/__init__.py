"""flowtrace: network-flow traces and detector evaluation on Spark DataFrames."""

__version__ = "0.1.0"
