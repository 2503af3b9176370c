"""Where data comes from and goes to: path listings, cells and blocks, catalog tables."""
