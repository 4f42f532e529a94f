"""Dataflow steps as functions from DataFrames to DataFrames."""
