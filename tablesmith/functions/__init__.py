"""Column-level helpers: typing, statistics expressions, display formatting."""
