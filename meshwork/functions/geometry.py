"""Bounds, cameras, rays and projection as expressions over rows."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounds(nodes: DataFrame, *by: str) -> DataFrame:
    """Low and high corner over x, y, z widened by radius, of all nodes (nulls when there is none) or of each group."""
    return nodes.groupBy(*by).agg(
        *(F.min(F.col(a) - F.col("radius")).alias(f"min_{a}") for a in "xyz"),
        *(F.max(F.col(a) + F.col("radius")).alias(f"max_{a}") for a in "xyz"),
    )


@dataclass(frozen=True)
class Lens:
    """What all rows share: opening angle and size of the viewport, near and far plane."""

    fov_y: float = math.pi / 4
    width: float = 1600.0
    height: float = 900.0
    near: float = 0.1
    far: float = 100_000.0

    @property
    def tall(self) -> float:
        return math.tan(self.fov_y / 2)

    @property
    def aspect(self) -> float:
        return self.width / self.height


@dataclass(frozen=True)
class Pose:
    """A camera of each row: it looks at ``target`` from ``distance`` away, turned by yaw and pitch."""

    yaw: Column
    pitch: Column
    distance: Column
    target: tuple[Column, Column, Column]

    @staticmethod
    def default() -> Pose:
        zero = F.lit(0.0)
        return Pose(zero, F.lit(0.2), F.lit(100.0), (zero, zero, zero))

    # Steps and limits of the camera's movements below.

    def turned(self, dx: Column, dy: Column) -> Pose:
        limit = math.pi / 2 - 0.01
        return replace(self, yaw=self.yaw + dx * 0.005, pitch=F.least(F.greatest(self.pitch - dy * 0.005, F.lit(-limit)), F.lit(limit)))

    def zoomed(self, delta: Column) -> Pose:
        return replace(self, distance=F.least(F.greatest(self.distance * F.exp(delta * -0.12), F.lit(0.05)), F.lit(100_000.0)))

    def shifted(self, dx: Column, dy: Column, lens: Lens) -> Pose:
        """The target moves with the pointer, by as much as a pixel shows at its distance."""
        right, up, _ = self.axes()
        pixel = self.distance * (2.0 * lens.tall / lens.height)
        return replace(self, target=tuple(t + (u * dy - r * dx) * pixel for t, r, u in zip(self.target, right, up)))

    def axes(self) -> tuple[list[Column], list[Column], list[Column]]:
        """Right, up and forward unit vectors of the sphere around the target."""
        sin_y, cos_y, sin_p, cos_p = F.sin(self.yaw), F.cos(self.yaw), F.sin(self.pitch), F.cos(self.pitch)
        return [cos_y, F.lit(0.0), -sin_y], [-sin_p * sin_y, cos_p, -sin_p * cos_y], [-cos_p * sin_y, -sin_p, -cos_p * cos_y]

    def eye(self) -> list[Column]:
        return [t - f * self.distance for t, f in zip(self.target, self.axes()[2])]

    def ray(self, x: Column, y: Column, lens: Lens) -> tuple[list[Column], list[Column]]:
        """Origin and unit direction of the ray through a pixel."""
        right, up, forward = self.axes()
        across, upward = (x * (2.0 / lens.width) - 1.0) * (lens.tall * lens.aspect), (y * (-2.0 / lens.height) + 1.0) * lens.tall
        through = [f + r * across + u * upward for f, r, u in zip(forward, right, up)]
        size = F.sqrt(across * across + upward * upward + 1.0)
        return self.eye(), [c / size for c in through]

    def seen(self, point: list[Column], lens: Lens) -> list[Column]:
        """Where a point shows: across and up from -1 to 1 within the viewport, and depth from 0 (near) to 1 (far)."""
        offset = [p - e for p, e in zip(point, self.eye())]
        across, up, ahead = (a[0] * offset[0] + a[1] * offset[1] + a[2] * offset[2] for a in self.axes())
        return [across / (ahead * (lens.tall * lens.aspect)), up / (ahead * lens.tall), (F.lit(1.0) - lens.near / ahead) * (lens.far / (lens.far - lens.near))]


def fitted_pose(box: str = "box", lens: Lens = Lens()) -> Pose:
    """The pose that shows a whole box of ``bounds``; the default pose where there is none."""
    corners = [(F.col(f"{box}.min_{a}"), F.col(f"{box}.max_{a}")) for a in "xyz"]
    spans = [high - low for low, high in corners]
    radius = F.greatest(F.sqrt(spans[0] * spans[0] + spans[1] * spans[1] + spans[2] * spans[2]) / 2, F.lit(1.0))
    there = F.col(f"{box}.min_x").isNotNull()
    pose = Pose.default()
    distance = F.when(there, fit_distance(radius, lens.fov_y, lens.aspect)).otherwise(pose.distance)
    return replace(pose, distance=distance, target=tuple(F.when(there, (low + high) / 2).otherwise(0.0) for low, high in corners))


def fit_distance(radius: Column, fov_y: float, aspect: float) -> Column:
    half = min(fov_y / 2, math.atan(math.tan(fov_y / 2) * aspect))
    return F.least(F.greatest(radius / F.lit(math.sin(half)) * 1.1, F.lit(0.05)), F.lit(100_000.0))


def along_ray(origin: tuple[float, ...], direction: tuple[float, ...]) -> tuple[Column, Column]:
    """Depth along a ray and squared distance from it, of columns x, y, z."""
    offsets = [F.col(a) - F.lit(float(o)) for a, o in zip("xyz", origin)]
    depth = sum((o * F.lit(float(d)) for o, d in zip(offsets[1:], direction[1:])), offsets[0] * F.lit(float(direction[0])))
    square = offsets[0] * offsets[0] + offsets[1] * offsets[1] + offsets[2] * offsets[2]
    return depth, square - depth * depth


def pick_nearest(nodes: DataFrame, origin: tuple[float, ...], direction: tuple[float, ...], visible: Column | None = None) -> DataFrame:
    """The visible node nearest along a ray whose disc the ray meets: a top-1 by (depth, id), no sort."""
    depth, away = along_ray(origin, direction)
    hit = nodes.where(visible if visible is not None else F.lit(True)).select("id", depth.alias("depth"), away.alias("away"), "radius")
    hit = hit.where((F.col("depth") > 0) & (F.col("away") <= F.col("radius") * F.col("radius")))
    return hit.agg(F.min_by("id", F.struct("depth", "id")).alias("id"), F.min("depth").alias("depth"), F.count("*").alias("hits"))


def to_physical(logical: Column, scale: float) -> Column:
    return logical * F.greatest(F.lit(scale), F.lit(0.01))


def ribbon(x0: Column, y0: Column, x1: Column, y1: Column, width: Column) -> tuple[Column, Column]:
    """Offsets in pixels from an edge's line to its rim: half the width, at least half a pixel, along the normal."""
    dx, dy = x1 - x0, y1 - y0
    length = F.sqrt(dx * dx + dy * dy)
    half = F.greatest(width * 0.5, F.lit(0.5))
    thin = length <= 0.001
    return F.when(thin, F.lit(0.0)).otherwise(-dy / length * half), F.when(thin, half).otherwise(dx / length * half)
