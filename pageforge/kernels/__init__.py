"""Pixel arithmetic of one page in numpy, for the page stages; rasters are uint8 arrays [height, width, (b, g, r)]."""
