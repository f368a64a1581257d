"""Threshold clustering of fingerprints by a tree of bit features."""
