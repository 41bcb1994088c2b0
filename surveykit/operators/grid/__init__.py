"""Occupancy grids as cell tables ``(map_id, col, row, ...)``; row 0 is at the bottom."""
