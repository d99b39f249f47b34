"""Genomic operators over DataFrames."""
