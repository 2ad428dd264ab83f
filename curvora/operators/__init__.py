"""Operators: SQL steps over curves, profiles, rasters and plot tables, and grouped kernels where SQL cannot reach."""
