"""Poses: +Y is up, -Z forward, +X right; yaw counts counter-clockwise about +Y, in [-180, 180)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENSOR_HEIGHT = 1.5


def normalize_yaw(yaw: Column) -> Column:
    return F.pmod(yaw + 180, F.lit(360.0)) - 180


def forward(yaw: Column) -> tuple[Column, Column]:
    """x and z of the direction in which an agent of this yaw looks."""
    return -F.sin(F.radians(yaw)), -F.cos(F.radians(yaw))


def right(yaw: Column) -> tuple[Column, Column]:
    return F.cos(F.radians(yaw)), -F.sin(F.radians(yaw))


def to_agent(x: Column, z: Column, yaw: Column) -> tuple[Column, Column]:
    """A world direction as (right, back) of an agent of this yaw."""
    s, c = F.sin(F.radians(yaw)), F.cos(F.radians(yaw))
    return x * c - z * s, x * s + z * c


def azimuth(x: Column, z: Column, yaw: Column) -> Column:
    """Degrees from the agent's front to the world direction (x, z): right is positive."""
    rightward, backward = to_agent(x, z, yaw)
    return normalize_yaw(F.degrees(F.atan2(rightward, -backward)))


def bearing(right: Column, back: Column) -> Column:
    """Degrees from the front, in [-180, 180] with the signs of zeros that Spark's atan2 drops: straight behind is 180 or, where ``right`` is -0.0, -180."""
    side = F.when(right.cast("string").startswith("-"), -1.0).otherwise(1.0)
    straight = F.when((back > 0) | (back.cast("string") == "0.0"), 180.0).otherwise(0.0)
    return F.when(right == 0, side * straight).otherwise(F.degrees(F.atan2(right, -back)))


def sensor(y: Column) -> Column:
    return y + SENSOR_HEIGHT


def into_frame(x: Column, y: Column, heading: Column) -> tuple[Column, Column]:
    """An offset in the plane as seen by one who looks along ``heading``, in radians: ahead, and to the left."""
    s, c = F.sin(heading), F.cos(heading)
    return x * c + y * s, y * c - x * s


def out_of_frame(x: Column, y: Column, heading: Column) -> tuple[Column, Column]:
    """The inverse of ``into_frame``."""
    s, c = F.sin(heading), F.cos(heading)
    return x * c - y * s, x * s + y * c
