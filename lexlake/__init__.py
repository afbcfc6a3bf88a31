"""Statute-change, relation-graph and filing-matrix jobs as Spark DataFrames."""
