"""Spark-first analytics for mass-spectrometry proteomics."""
