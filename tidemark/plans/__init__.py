"""Query catalogue and helpers that shape physical plans."""
