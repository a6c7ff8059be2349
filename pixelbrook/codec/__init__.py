"""Bitstream kernels on numpy arrays, and the Arrow functions that run them over tables."""
