"""Operators on voxel and cell tables."""
