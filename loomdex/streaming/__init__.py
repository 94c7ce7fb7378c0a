"""Part of the loomdex package: streaming."""
