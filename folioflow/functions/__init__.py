"""Part of folioflow; see the package docstring."""
