"""Corpus curation, mixing, packing and scoring as Catalyst-planned DataFrame operators."""
