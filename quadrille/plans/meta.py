"""Geometry of a grid and its levels: a few numbers on the driver, never data."""

from __future__ import annotations

from dataclasses import dataclass

AXES = ("z", "x", "y")


@dataclass(frozen=True)
class GridMeta:
    """Extents of the finest grid.  Level l_max is the pixel grid; each coarser level halves every axis, rounding up."""

    ny: int
    nx: int = 1
    nz: int = 1

    def __post_init__(self):
        if min(self.ny, self.nx, self.nz) < 1:
            raise ValueError("a grid has at least one cell on every axis")

    @property
    def size(self) -> dict[str, int]:
        return {"z": self.nz, "x": self.nx, "y": self.ny}

    @property
    def l_max(self) -> int:
        return max(1, (max(self.ny, self.nx, self.nz) - 1).bit_length())

    @property
    def l_min(self) -> int:
        return 1

    @property
    def dimensions(self) -> int:
        return sum(n > 1 for n in self.size.values())

    @property
    def pixels(self) -> int:
        return self.ny * self.nx * self.nz

    def n(self, level: int, axis: str) -> int:
        step = self.level_size(level)
        return -(-self.size[axis] // step)

    def at(self, level: int) -> GridMeta:
        """The grid of a level as a grid of its own."""
        return GridMeta(self.n(level, "y"), self.n(level, "x"), self.n(level, "z"))

    def half(self) -> GridMeta:
        return GridMeta(-(-self.ny // 2), -(-self.nx // 2), -(-self.nz // 2))

    def level_size(self, level: int) -> int:
        return 1 << max(0, self.l_max - level)

    @property
    def active(self) -> list[str]:
        return [a for a in AXES if self.size[a] > 1]
