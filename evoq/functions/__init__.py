"""Column functions: text, numbers, signal arrays, Arrow kernels."""
