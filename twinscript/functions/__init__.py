"""Part of twinscript; see README.md."""
