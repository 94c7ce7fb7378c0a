"""Part of the loomdex package: operators."""
