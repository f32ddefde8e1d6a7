"""Spark-native analytics: graphs, vectors, sequences, grids, trees and particles on DataFrames."""
