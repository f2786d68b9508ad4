"""Column functions: values, geometry and text."""
