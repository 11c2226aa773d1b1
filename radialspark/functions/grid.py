"""Grid ids of compressed particles and the decoding of their positions.

An id (from 1) names a tile and a place in it, both as base-n digits with x slowest; a position is the grid point times the
cell interval plus the quantised displacement.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import f32, float32


@dataclass(frozen=True)
class Grid:
    """tiles and points: per tile, along one axis."""

    tiles: int
    points: int

    @property
    def per_tile(self) -> int:
        return self.points**3


def _digits(value: Column, base: int) -> list[Column]:
    b = F.lit(base).cast("long")
    div = lambda x, y: F.floor(x / y).cast("long")  # noqa: E731  exact below 2**53
    return [div(value, F.lit(base * base).cast("long")), F.pmod(div(value, b), b), F.pmod(value, b)]


def split_id(grid: Grid, ident: Column) -> tuple[Column, Column]:
    """The tile of an id and its place in the tile, both from 0."""
    zero = ident.cast("long") - 1
    return F.floor(zero / F.lit(grid.per_tile).cast("long")).cast("long"), F.pmod(zero, F.lit(grid.per_tile).cast("long"))


def join_id(grid: Grid, tile: Column, place: Column) -> Column:
    return tile * F.lit(grid.per_tile).cast("long") + place + 1


def id2pos(grid: Grid, ident: Column) -> list[Column]:
    """The three grid coordinates of an id."""
    tile, place = split_id(grid, ident)
    return [(t * grid.points + p).cast("long") for t, p in zip(_digits(tile, grid.tiles), _digits(place, grid.points), strict=True)]


def pos2id(grid: Grid, pos: list[Column]) -> Column:
    """The id of grid coordinates; the inverse of id2pos."""
    n = F.lit(grid.points).cast("long")
    tile, place = F.lit(0).cast("long"), F.lit(0).cast("long")
    for p in pos:
        tile = tile * grid.tiles + F.floor(p / n).cast("long")
        place = place * grid.points + F.pmod(p.cast("long"), n)
    return join_id(grid, tile, place)


@dataclass(frozen=True)
class Decoding:
    """What a header says about positions."""

    grid: Grid
    interval: float
    low: float
    unit: float
    first_id: int

    @classmethod
    def of(cls, header: dict, tiles: int = 1) -> Decoding:
        total = (header["npartTotal"][1] & 0xFFFFFFFF) + ((header["npartTotal"][2] & 0xFFFFFFFF) << 32)
        side = int((total + 0.5) ** (1.0 / 3.0))
        unit = (float(header["disp_max"]) - float(header["disp_min"])) / 2 ** header["pos_bits"]
        return cls(Grid(tiles, side // tiles), float32(header["BoxSize"] / side), float32(header["disp_min"]), unit, header["id_start"])


    def positions(self, pid: np.ndarray, codes: np.ndarray, wrap: bool = False, box: float = 1000.0) -> list[np.ndarray]:
        """x, y, z (float32) of the particles pid with the displacement codes (n, 3): ``decode`` for arrays."""
        zero = pid + self.first_id - 1
        tile, place = zero // self.grid.per_tile, zero % self.grid.per_tile
        out = []
        for k in range(3):
            power = 2 - k
            grid = tile // self.grid.tiles**power % self.grid.tiles * self.grid.points + place // self.grid.points**power % self.grid.points
            base = np.float32(self.interval) * grid.astype(np.float32) + np.float32(self.low)
            x = (base.astype(np.float64) + self.unit * codes[:, k]).astype(np.float32)
            out.append(np.mod(x, np.float32(box)) if wrap else x)
        return out


def decode(rows: DataFrame, how: Decoding, wrap: bool = False, box: float = 1000.0) -> DataFrame:
    """rows(pid, ux, uy, uz) -> pid, x, y, z; not wrapped into the box unless asked for."""
    grid = id2pos(how.grid, F.col("pid") + how.first_id)
    out = []
    for axis, g in zip("xyz", grid, strict=True):
        base = f32(f32(f32(how.interval) * g.cast("float")) + f32(how.low))
        x = (base.cast("double") + F.lit(how.unit) * F.col(f"u{axis}")).cast("float")
        out.append((f32(F.pmod(x, f32(box))) if wrap else x).alias(axis))
    return rows.select("pid", *out)
