"""Sequential kernels that run on one graph in one task."""
