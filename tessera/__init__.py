"""Tessera: robust graph clustering, annotation and label analysis as Spark dataflow."""
