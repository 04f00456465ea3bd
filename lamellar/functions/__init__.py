"""Column functions: scalars and the filter compiler."""
