"""Part of the loomdex package: plans."""
