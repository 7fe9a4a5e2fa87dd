"""Sequential kernels on one system: NumPy and plain Python, run as grouped maps by matrix."""
