"""Column functions on boxes, structs (x0, y0, x1, y1)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def box(x0, y0, x1, y1) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    both = overlap(a, b)
    whole = area(a) + area(b) - both
    return F.when(whole > 0, both / whole).otherwise(0.0)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Over the smaller area."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, overlap(a, b) / least).otherwise(0.0)


def holds_centre(outer: Column, inner: Column) -> Column:
    x, y = (inner["x0"] + inner["x1"]) / 2, (inner["y0"] + inner["y1"]) / 2
    return x.between(outer["x0"], outer["x1"]) & y.between(outer["y0"], outer["y1"])


def union(*boxes: Column) -> Column:
    low = lambda k: F.least(*(b[k] for b in boxes)) if len(boxes) > 1 else boxes[0][k]
    high = lambda k: F.greatest(*(b[k] for b in boxes)) if len(boxes) > 1 else boxes[0][k]
    return box(low("x0"), low("y0"), high("x1"), high("y1"))


def union_agg(b: Column) -> Column:
    return box(F.min(b["x0"]), F.min(b["y0"]), F.max(b["x1"]), F.max(b["y1"]))


def inflate(b: Column, by: Column) -> Column:
    return box(b["x0"] - by, b["y0"] - by, b["x1"] + by, b["y1"] + by)


def percent(b: Column, width: Column, height: Column) -> Column:
    return box(b["x0"] / width * 100, b["y0"] / height * 100, b["x1"] / width * 100, b["y1"] / height * 100)


def upper_median(values: Column) -> Column:
    """The element at half the size of the sorted values, the upper one of two."""
    own = F.array_sort(values)
    return F.when(F.size(own) > 0, F.try_element_at(own, (F.floor(F.size(own) / 2) + 1).cast("int")))


def apply_matrix(m: Column, x: Column, y: Column) -> Column:
    """A point under an affine matrix, an array (a, b, c, d, e, f)."""
    return F.struct((m[0] * x + m[2] * y + m[4]).alias("x"), (m[1] * x + m[3] * y + m[5]).alias("y"))


#: Numbers that a command of a path takes; lines and curves are read, other commands are counted as unread.
PATH_NUMBERS = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7}


def path_points(d: str) -> tuple[list[tuple[float, float]], int]:
    """Points and control points of a path with absolute commands, and how many commands were not read."""
    out: list[tuple[float, float]] = []
    unread, command, numbers, x, y = 0, "", [], 0.0, 0.0
    for letter, value in re.findall(r"([MLHVCSQTAZmlhvcsqtaz])|([+-]?(?:\d*\.\d+|\d+\.?\d*)(?:[eE][+-]?\d+)?)", d or ""):
        if letter:
            command, numbers = letter.upper(), []
            continue
        numbers.append(float(value))
        if len(numbers) < PATH_NUMBERS.get(command, 1 << 30):
            continue
        if command in "MLCQ":
            out += zip(numbers[::2], numbers[1::2])
            x, y = numbers[-2:]
        elif command in "HV":
            x, y = (numbers[0], y) if command == "H" else (x, numbers[0])
            out.append((x, y))
        else:
            unread += 1
        command, numbers = "L" if command == "M" else command, []
    return out, unread


@F.pandas_udf(T.StructType([*(T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")), T.StructField("unread", T.IntegerType())]))
def path_box(d: pd.Series) -> pd.DataFrame:
    """The box of a path's points; null numbers for a path without any."""
    rows = []
    for points, unread in map(path_points, d):
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        rows.append((min(xs), min(ys), max(xs), max(ys), unread) if points else (None, None, None, None, unread))
    return pd.DataFrame(rows, columns=["x0", "y0", "x1", "y1", "unread"])
