"""Operators that prepare text corpora for training, each by one stated method."""
