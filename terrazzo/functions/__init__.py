"""Part of terrazzo; see the README for the map of the package."""
