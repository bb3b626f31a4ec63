"""Scalar functions of the model, as Columns."""
