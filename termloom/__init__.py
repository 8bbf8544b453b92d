"""Latent-semantic text analytics on Spark DataFrames.

Every operator is a function from DataFrame to DataFrame. `sources` reads and
writes, `functions` holds column expressions, `operators` the relational and
linear-algebra steps, `plans` the whole jobs built from them.
"""
