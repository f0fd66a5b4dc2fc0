"""Formulas to plans: parsing, model derivation, compilation to DataFrames, runs, lineage, version differences."""
