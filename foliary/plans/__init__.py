"""Guards and helpers around SQL plans."""
