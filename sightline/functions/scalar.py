"""Scalar expressions: labels, numbers, hashes and arrays. All are built-in functions but where a note says so."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words for the same class.
ALIASES = {
    "椅子": "chair", "桌子": "table", "沙发": "sofa", "床": "bed", "柜子": "cabinet", "灯": "lamp", "门": "door", "窗户": "window",
    "书": "book", "显示器": "monitor", "瓶子": "bottle", "杯子": "cup", "箱子": "box", "盒子": "box", "纸箱": "box", "窗帘": "curtain",
    "墙": "wall", "墙壁": "wall", "地板": "floor", "地面": "floor", "三脚架": "tripod", "相机": "camera", "容器": "container",
    "冰箱": "refrigerator", "fridge": "refrigerator", "refridgerator": "refrigerator",
}


def alias(text: str) -> str:
    low = text.strip().lower()
    return ALIASES.get(low, low)


def label_key(label: Column) -> Column:
    """A label trimmed, in lower case and by its alias."""
    low = F.lower(F.trim(label))
    table = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(table[low], low)


def short_label(answer: Column) -> Column:
    """A model's answer as a label of one to six words, or null: quotes and a final period go, lower case."""
    low = F.lower(F.regexp_replace(F.trim(answer), r"^[\"'\s]+|[\"'.\s]+$", ""))
    return F.when(low.rlike(r"^[a-z][a-z0-9'\-]*(?: [a-z0-9][a-z0-9'\-]*){0,5}$"), low)


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark lacks; apply it to distinct values."""
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def coloured(ident: Column, factor: int) -> Column:
    """The deterministic colour channel of a label."""
    return F.when(ident > 0, 50 + (ident * factor) % 206).otherwise(F.lit(90)).cast("int")


def half_even(x: Column) -> Column:
    return F.rint(x)


def box_gap(a: tuple[list[Column], list[Column]], b: tuple[list[Column], list[Column]]) -> Column:
    """The distance of two axis-parallel boxes, each (lows, highs)."""
    gaps = [F.greatest(F.lit(0.0), la - hb, lb - ha) for la, ha, lb, hb in zip(*a, *b, strict=True)]
    return F.sqrt(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]))


def norm(parts: list[Column]) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def angle_degrees(dot: Column) -> Column:
    """The angle of two unit vectors from their inner product."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))


def rotation_angle(m: Column) -> Column:
    """Degrees of the rotation in a row-major 4x4 matrix."""
    return angle_degrees((m[0] + m[5] + m[10] - 1) / 2)


def matrix_product(a: Column, b: Column) -> Column:
    """Of two row-major 4x4 matrices."""
    return F.array(*[sum((a[4 * i + k] * b[4 * k + j] for k in range(1, 4)), a[4 * i] * b[j]) for i in range(4) for j in range(4)])


def rigid_inverse(m: Column) -> Column:
    """Of a row-major rigid 4x4 matrix: the transposed rotation and its image of the translation, negated."""
    rows = []
    for i in range(3):
        rows += [m[i], m[4 + i], m[8 + i], -(m[i] * m[3] + m[4 + i] * m[7] + m[8 + i] * m[11])]
    return F.array(*rows, *[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])


def is_rigid(m: Column, tolerance: float = 2e-4) -> Column:
    """Sixteen finite numbers, orthonormal rotation, determinant 1, last row 0 0 0 1."""
    fine = (F.size(m) == 16) & F.forall(m, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e300))
    e = [F.get(m, F.lit(i)) for i in range(16)]  # null beyond the end, where an index would raise
    for i in range(3):
        for j in range(i, 3):
            dot = e[i] * e[j] + e[4 + i] * e[4 + j] + e[8 + i] * e[8 + j]
            fine = fine & (F.abs(dot - (1.0 if i == j else 0.0)) <= tolerance)
    det = e[0] * (e[5] * e[10] - e[6] * e[9]) - e[1] * (e[4] * e[10] - e[6] * e[8]) + e[2] * (e[4] * e[9] - e[5] * e[8])
    last = (F.abs(e[12]) <= 1e-8) & (F.abs(e[13]) <= 1e-8) & (F.abs(e[14]) <= 1e-8) & (F.abs(e[15] - 1) <= 1e-8)
    return F.coalesce(fine & (F.abs(det - 1) <= tolerance) & last, F.lit(False))


def scaled_intrinsics(k: Column, sx: float, sy: float) -> Column:
    return F.struct((k["fx"] * sx).alias("fx"), (k["fy"] * sy).alias("fy"), (k["cx"] * sx).alias("cx"), (k["cy"] * sy).alias("cy"))


def turned_intrinsics(k: Column, width: Column) -> Column:
    """After a counter-clockwise quarter turn of an image of that width."""
    return F.struct(k["fy"].alias("fx"), k["fx"].alias("fy"), k["cy"].alias("cx"), (width - 1 - k["cx"]).alias("cy"))


def forbidden_path(path: Column, parts: list[str]) -> Column:
    """Whether a path has a part that inference may not read."""
    return F.arrays_overlap(F.split(F.lower(path), r"[/\\]"), F.array(*[F.lit(x) for x in parts]))


def histogram(values: Column) -> Column:
    """A map of distinct array entries to their counts."""
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(values)), lambda v: F.struct(v.alias("key"), F.size(F.filter(values, lambda w: w == v)).alias("value"))))


def safe_name(text: str) -> bool:
    """A session id's shape."""
    return bool(re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]{0,127}", text)) and ".." not in text
