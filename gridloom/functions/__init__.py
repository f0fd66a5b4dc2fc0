"""Typed cell values, criteria and scalar functions as Column builders."""
