"""Raster frame sequences as DataFrames: storage, transforms, statistics and lossless coding."""
