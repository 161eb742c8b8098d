"""Column functions, and numpy helpers on one raster."""
