"""Cells of a stored dataset: squares of a quadtree, named q and their digits (0 NW, 1 NE, 2 SW, 3 SE)."""

from __future__ import annotations


def cells_meeting(cells: tuple[str, ...], box: tuple[float, float, float, float]) -> list[str]:
    """Of a manifest's cells those whose square meets a box (south, west, north, east)."""
    south, west, north, east = box
    out = []
    for cell in cells:
        n, w, height, width = 90.0, -180.0, 180.0, 360.0
        for digit in cell[1:]:
            height, width = height / 2, width / 2
            n -= height * (digit in "23")
            w += width * (digit in "13")
        if n >= south - 1e-6 and n - height <= north + 1e-6 and w <= east + 1e-6 and w + width >= west - 1e-6:
            out.append(cell)
    return out
