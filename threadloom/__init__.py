"""Session-transcript analytics on Spark: sources, operators, plans and streaming over one canonical model."""
