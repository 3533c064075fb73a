"""Column functions on colours in [0, 1]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veldra.functions.vectors import clamp

# sRGB to XYZ (D65), the white point, and the CIE constants
TO_XYZ = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
WHITE = (0.95047, 1.0, 1.08883)
CUT, SLOPE = 216 / 24389, 24389 / 27

# The six orders in which three components are shown
ORDERS = ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))


def lab(r: Column, g: Column, b: Column) -> list[Column]:
    """L*, a*, b* of an sRGB colour, clamped to [0, 1] first."""

    def linear(c: Column) -> Column:
        c = clamp(c)
        return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    rgb = [linear(c) for c in (r, g, b)]
    xyz = [sum((w * c for w, c in zip(row, rgb)), F.lit(0.0)) / white for row, white in zip(TO_XYZ, WHITE)]
    f = [F.when(t > CUT, F.cbrt(t)).otherwise((SLOPE * t + 16) / 116) for t in xyz]
    return [116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])]


def delta_e(a: list[Column], b: list[Column]) -> Column:
    """CIE76 difference of two colours in Lab."""
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b)), F.lit(0.0)))


def swizzled(rgb: list[Column], order: int, invert: tuple[bool, bool, bool]) -> list[Column]:
    """Channels in another order, each inverted or not."""
    return [1 - rgb[i] if inv else rgb[i] for i, inv in zip(ORDERS[order], invert)]


def baked(x: Column, mask: Column) -> Column:
    """A channel times its mask as a byte, rounded half to even."""
    return F.rint(255 * clamp(x * mask)).cast("bigint")
