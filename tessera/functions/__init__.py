"""Column functions: distance kernels, quantization, metadata filters."""
