"""Report and gate queries over summary tables."""
