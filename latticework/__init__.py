"""Nonlinear least squares on bipartite observation graphs, on PySpark DataFrames."""
