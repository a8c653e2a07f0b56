"""Column expressions for labels, images, kernels and geometry, and the same draws for rows on the driver."""
