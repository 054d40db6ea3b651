"""Which numbers an element type holds exactly, and conversions between types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of integer types; bits of the mantissa of float types.
INTEGER_BITS = {"uint8": 8, "uint16": 16, "uint32": 32, "uint64": 64, "int8": 7, "int16": 15, "int32": 31, "int64": 63}
MANTISSA_BITS = {"float32": 23, "float64": 52}


def max_exact(dtype: str) -> int:
    """The largest integer that the type holds exactly."""
    if dtype in INTEGER_BITS:
        return 2 ** INTEGER_BITS[dtype] - 1
    if dtype in MANTISSA_BITS:
        return 2 ** MANTISSA_BITS[dtype]
    raise TypeError(f"{dtype} is not a numeric element type")


def min_exact(dtype: str) -> int:
    if dtype in MANTISSA_BITS:
        return -max_exact(dtype)
    return 0 if dtype.startswith("u") and max_exact(dtype) else -max_exact(dtype) - 1


def filtering_dtype(dtype: str) -> str:
    """float32 or float64, whichever holds the type's integers exactly."""
    most = max_exact(dtype)
    for out in ("float32", "float64"):
        if most <= 2 ** MANTISSA_BITS[out]:
            return out
    raise TypeError(f"{dtype} does not fit a float type exactly")


def convert(v: Column, source: str, target: str) -> Column:
    """As double: unchanged where the target float type holds the source, else scaled into it."""
    if target not in MANTISSA_BITS:
        raise ValueError(f"{target} is not a float type")
    v = v.cast("double")
    if max_exact(source) <= max_exact(target):
        return v
    return v / max(max_exact(source), -min_exact(source)) * max_exact(target)


def clip(v: Column, most: float) -> Column:
    return F.greatest(F.lit(0).cast("double"), F.least(v.cast("double"), F.lit(float(most))))


def detection_code(marked: Column, dtype: str = "uint64") -> Column:
    """A mark as the largest integer of the output type; all else is 0."""
    return F.when(marked, F.lit(str(max_exact(dtype))).cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))
