"""Relational, statistical and modelling operators over DataFrames."""
