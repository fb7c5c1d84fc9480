"""Column functions: clock stamps, checksums, Bloom positions."""
