"""Filters and projections on an event's place and polarity: all narrow, all inside one projection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: For each action, x' and y' from (x, y, width, height), and whether the sides change places.
TRANSPOSES = {
    "flip_left_right": (lambda x, y, w, h: (w - 1 - x, y), False),
    "flip_bottom_top": (lambda x, y, w, h: (x, h - 1 - y), False),
    "rotate_90_counterclockwise": (lambda x, y, w, h: (h - 1 - y, x), True),
    "rotate_180": (lambda x, y, w, h: (w - 1 - x, h - 1 - y), False),
    "rotate_270_counterclockwise": (lambda x, y, w, h: (y, w - 1 - x), True),
    "flip_up_diagonal": (lambda x, y, w, h: (y, x), True),
    "flip_down_diagonal": (lambda x, y, w, h: (h - 1 - y, w - 1 - x), True),
}
#: Masks up to so many cells become a literal; larger ones a table to join with.
LITERAL_CELLS = 1 << 14


def remove_on(df: DataFrame) -> DataFrame:
    return df.where(~F.col("on"))


def remove_off(df: DataFrame) -> DataFrame:
    return df.where("on")


def crop(df: DataFrame, left: int, right: int, top: int, bottom: int) -> DataFrame:
    inside = (F.col("x") >= left) & (F.col("x") < right) & (F.col("y") >= top) & (F.col("y") < bottom)
    return df.where(inside).withColumns({"x": F.col("x") - left, "y": F.col("y") - top})


def mask(df: DataFrame, array: np.ndarray) -> DataFrame:
    """Events where ``array[y, x]`` is true."""
    if array.size <= LITERAL_CELLS:
        bits = "".join("1" if v else "0" for v in array.astype(bool).ravel())
        place = F.col("y") * array.shape[1] + F.col("x") + 1
        return df.where(F.substring(F.lit(bits), place, F.lit(1)) == "1")
    y, x = np.nonzero(array)
    cells = df.sparkSession.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x int, y int")
    # One row for each pixel of a sensor: a bound that the events don't move.
    return df.join(F.broadcast(cells), ["x", "y"], "left_semi").select(*df.columns)


def transpose(df: DataFrame, action: str, width: int, height: int) -> tuple[DataFrame, int, int]:
    place, turned = TRANSPOSES[action]
    x, y = place(F.col("x"), F.col("y"), F.lit(width), F.lit(height))
    return df.withColumns({"x": x, "y": y}), *((height, width) if turned else (width, height))
