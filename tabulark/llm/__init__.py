"""Training-data operators: language ID, dedup, mixing, packing, formatting and
filtering of text corpora. Nothing else in the library imports this package."""
