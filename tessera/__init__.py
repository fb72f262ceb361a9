"""Tessera: bag analytics (tiles, bags, retrieval, evaluation) on PySpark DataFrames."""
