"""Part of the geovelo library."""
