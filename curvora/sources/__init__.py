"""Sources: images, profile folders, and the adapters that read the standard tables as curves, profiles and rasters."""
