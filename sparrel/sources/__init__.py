"""Inputs and outputs: delimited text, slotted block files, row text, catalogs."""
