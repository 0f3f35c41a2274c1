"""Input frames: canonical tables, and the mapping of the retail test tables onto them."""
