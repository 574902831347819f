"""Operators over relations: rasters, graphs, topology, routing, analytics."""
