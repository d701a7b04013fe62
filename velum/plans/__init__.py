"""Whole flows over tables, composed of operators."""
