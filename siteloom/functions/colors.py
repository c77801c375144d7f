"""CSS colours as Column expressions: parsing, CIE Lab, distance, hexadecimal form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The least difference that is seen, the sRGB to XYZ matrix and the D65 white point.
NOTICEABLE = 2.3
XYZ = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
WHITE = (95.047, 100.0, 108.883)
RGB = r"rgba?\(\s*([0-9.]+)[,\s]+([0-9.]+)[,\s]+([0-9.]+)(?:[,\s/]+([0-9.]+))?\s*\)"


def parse_css_color(value: Column) -> Column:
    """struct(r, g, b) of ``rgb()`` or ``rgba()``; null for others and for a transparent one."""
    part = lambda i: F.regexp_extract(value, RGB, i)
    whole = lambda i: F.bround(F.nullif(part(i), F.lit("")).cast("double")).cast("int")
    alpha = F.nullif(part(4), F.lit("")).cast("double")
    rgb = F.struct(whole(1).alias("r"), whole(2).alias("g"), whole(3).alias("b"))
    return F.when(value.rlike(RGB) & (F.coalesce(alpha, F.lit(1.0)) != 0), rgb)


def to_lab(r: Column, g: Column, b: Column) -> Column:
    linear = []
    for c in (r, g, b):
        x = c / 255
        linear.append(100 * F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4))))
    f = []
    for row, white in zip(XYZ, WHITE, strict=True):
        t = sum((k * v for k, v in zip(row, linear, strict=True)), F.lit(0.0)) / white
        f.append(F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116))
    return F.struct((116 * f[1] - 16).alias("l"), (500 * (f[0] - f[1])).alias("a"), (200 * (f[1] - f[2])).alias("b"))


def distance(a: Column, b: Column) -> Column:
    """CIE76."""
    return F.sqrt(sum(((a[x] - b[x]) * (a[x] - b[x]) for x in ("l", "a", "b")), F.lit(0.0)))


def to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r, g, b)
