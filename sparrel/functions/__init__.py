"""Scalar types and comparison semantics."""
