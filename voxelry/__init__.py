"""Volumes, point clouds and surfaces as DataFrames, for Spark."""
