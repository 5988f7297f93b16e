"""Query trees: parsing, rewriting, and compilation of whole batches into one DataFrame plan."""
