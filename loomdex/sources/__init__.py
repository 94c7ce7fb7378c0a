"""Part of the loomdex package: sources."""
