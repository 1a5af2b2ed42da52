"""Element-wise functions of voxel values and labels, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize(v: Column, mean: float | Column, std: float | Column) -> Column:
    return ((v - mean) / std).cast("float")


def offset_scale(patches: DataFrame, scales: DataFrame, offset: float, scale: float) -> DataFrame:
    """(v - offset) / scale with the volume's own values, else the defaults."""
    own = patches.join(scales, "volume", "left")
    return own.withColumn("normalized", (F.col("value") - F.coalesce("offset", F.lit(offset))) / F.coalesce("scale", F.lit(scale)))


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def expit(v: Column) -> Column:
    return 1 / (1 + F.exp(-v))


def quantize(p: Column) -> Column:
    """0 for unvisited (NaN or null), else 1 to 255 in 254 equal steps."""
    return F.when(F.isnan(p) | p.isNull(), 0).otherwise(F.least(F.greatest(F.floor(p * 254) + 1, F.lit(1)), F.lit(255))).cast("short")


def dequantize(q: Column) -> Column:
    return F.when(q == 0, F.lit(float("nan"))).otherwise((q - 0.5) / 255).cast("float")


def soften(m: Column, softness: float = 0.05) -> Column:
    return F.when(m, 1 - softness).otherwise(softness).cast("double")


def clip(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def loss_weight(in_bounds: Column, loss_mask: Column, invert: bool = False) -> Column:
    off = ~loss_mask if invert else loss_mask
    return in_bounds.cast("double") * (1 - off.cast("double"))


def id_width(most: Column) -> Column:
    """Name of the narrowest unsigned type that holds an id."""
    return F.when(most <= 255, "uint8").when(most <= 65535, "uint16").when(most <= 4294967295, "uint32").otherwise("uint64")


def unravel(i: Column, shape: tuple[int, int, int]) -> tuple[Column, Column, Column]:
    _, ny, nx = shape
    return F.floor(i / (ny * nx)).cast("int"), F.pmod(F.floor(i / nx), F.lit(ny)).cast("int"), F.pmod(i, F.lit(nx)).cast("int")


def ravel(z: Column, y: Column, x: Column, shape: tuple[int, int, int]) -> Column:
    _, ny, nx = shape
    return (z.cast("long") * ny + y) * nx + x


def lattice(pos: Column, start: Column | int, delta: int) -> Column:
    """Cell of the move lattice; floors, also below the start."""
    return F.floor((pos - start + delta // 2) / max(delta, 1)).cast("int")


def int_vector(text: Column) -> Column:
    """(x, y, z) of three comma-separated whole numbers; anything else is an error."""
    parts = F.split(text, ",")
    whole = (F.size(parts) == 3) & F.forall(parts, lambda p: F.trim(p).rlike(r"^[+-]?[0-9]+(\.0*)?$"))
    bad = F.raise_error(F.concat(F.lit("not three whole numbers: "), text))
    at = lambda k: F.when(whole, F.trim(parts[k]).cast("double").cast("long")).otherwise(bad.cast("long"))
    return F.when(text.isNotNull(), F.struct(*[at(k).alias(a) for k, a in enumerate("xyz")]))


def unvisited_to_zero(v: Column) -> Column:
    """Logits for a reader that knows no NaN."""
    return F.when(F.isnan(v) | v.isNull(), 0.0).otherwise(v)


def pack_pair(a: Column, b: Column) -> Column:
    return a.bitwiseOR(F.shiftleft(b, 32))


def unpack_pair(p: Column) -> tuple[Column, Column]:
    return p.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(p, 32)


def voxel_radius(dz: Column, dy: Column, dx: Column) -> Column:
    return F.floor(F.sqrt((dz * dz + dy * dy + dx * dx).cast("double"))).cast("int")


def point_pair_of_name(name: Column) -> list[Column]:
    """id_a, id_b, x, y, z of names like 12-34_at_5_6_7."""
    pat = r"(\d+)-(\d+)_at_(\d+)_(\d+)_(\d+)"
    return [F.regexp_extract(name, pat, k + 1).cast("long").alias(n) for k, n in enumerate(("id_a", "id_b", "x", "y", "z"))]


def sharded_target(id_a: Column, id_b: Column, x: Column, y: Column, z: Column, digits: int) -> Column:
    """Output path of a decision point, below the first digits of a hash of its ids where there are several."""
    name = F.format_string("%d-%d_at_%d_%d_%d", id_a, id_b, x, y, z)
    if digits <= 1:
        return name
    return F.concat(F.substring(F.md5(F.concat(id_a.cast("string"), id_b.cast("string"))), 1, digits), F.lit("/"), name)


def display(v: Column, act: str, low: float, high: float) -> Column:
    """0..1 for display, after tanh or sig if asked for; null for NaN."""
    out = {"tanh": F.tanh(v), "sig": expit(v)}.get(act, v)
    return F.when(F.isnan(v), None).otherwise((out - low) / (high - low))


def palette(v: Column) -> list[Column]:
    return [(F.sqrt(v) * 250).cast("int").alias("r"), (F.pow(v, 3) * 250).cast("int").alias("g"), (F.sin(v * 6.283185307179586).cast("double") * 250).cast("int").alias("b")]


def any_of(masks: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, masks, F.lit(False))
