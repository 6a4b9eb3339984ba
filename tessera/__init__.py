"""Tessera: document, conversation and corpus analytics on Spark DataFrames."""
