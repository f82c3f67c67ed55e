"""Column expressions on positions, attitudes and levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres between two points in degrees."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(chord), F.sqrt(1 - chord))


def quaternion_to_euler(w: Column, x: Column, y: Column, z: Column) -> dict[str, Column]:
    """Roll, pitch and yaw in degrees; the pitch sine is clamped to [-1, 1]."""
    sine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (w * y - z * x) * 2))
    return {
        "roll_deg": F.degrees(F.atan2((w * x + y * z) * 2, F.lit(1.0) - (x * x + y * y) * 2)),
        "pitch_deg": F.degrees(F.asin(sine)),
        "yaw_deg": F.degrees(F.atan2((w * z + x * y) * 2, F.lit(1.0) - (y * y + z * z) * 2)),
    }


def vibration_level(rms: Column) -> Column:
    """GOOD below 5 m/s2, ACCEPTABLE below 15, WARNING below 30, else CRITICAL."""
    return (
        F.when(rms < 5.0, "GOOD").when(rms < 15.0, "ACCEPTABLE").when(rms < 30.0, "WARNING").otherwise("CRITICAL")
    )


def magnitude(*parts: Column) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))
