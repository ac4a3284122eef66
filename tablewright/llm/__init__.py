"""Operators for training data: tokens, containers, pieces, quantile summaries, vector neighbours and clusters."""
