"""Image stacks as a Spark data source: one row per frame of baseline TIFF files, one task per stretch of pages.

    spark.dataSource.register(TiffStack)
    spark.read.format("tiff_stack").option("calibration", 0.09).option("interval", 600).load("stack.tif")

The path may carry the options itself, ``stack.tif?calibration=0.09;interval=600``.  Uncompressed grey images of 8 or 16
bits or 32-bit floats are read; pages of other kinds raise ValueError.  Proprietary microscope formats have no public
decoder here and are not read.
"""

from __future__ import annotations

import glob
import os
import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "filename string, pos int, t int, timepoint double, calibration double, height int, width int, dtype string, pixels array<double>"
PAGES_PER_TASK = 16
#: fixed values: sizes of the TIFF field types in bytes, and the sample formats that are read
_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 12: 8}
_DTYPE = {(8, 1): "u1", (16, 1): "u2", (16, 2): "i2", (32, 3): "f4"}


def path_and_options(path: str) -> tuple[str, dict[str, str]]:
    """A path and the ``name=value`` options after its question mark."""
    bare, _, tail = path.partition("?")
    return bare, dict(p.split("=", 1) for p in tail.replace("&", ";").split(";") if "=" in p)


def page_offsets(f) -> tuple[str, list[int]]:
    """Byte order and the offset of every page's directory."""
    f.seek(0)
    head = f.read(8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or struct.unpack(order + "H", head[2:4])[0] != 42:
        raise ValueError("not a baseline TIFF file")
    offsets, seen, at = [], set(), struct.unpack(order + "I", head[4:])[0]
    while at and at not in seen:
        offsets.append(at)
        seen.add(at)
        f.seek(at)
        n = struct.unpack(order + "H", f.read(2))[0]
        f.seek(at + 2 + 12 * n)
        at = struct.unpack(order + "I", f.read(4))[0]
    return order, offsets


def read_page(f, order: str, at: int) -> np.ndarray:
    f.seek(at)
    tags: dict[int, tuple] = {}
    n = struct.unpack(order + "H", f.read(2))[0]
    for k in range(n):
        f.seek(at + 2 + 12 * k)
        tag, kind, count = struct.unpack(order + "HHI", f.read(8))
        size = _SIZE.get(kind, 0) * count
        if not size:
            continue
        raw = f.read(4)
        if size > 4:
            f.seek(struct.unpack(order + "I", raw)[0])
            raw = f.read(size)
        code = {1: "B", 3: "H", 4: "I"}.get(kind)
        if code:
            tags[tag] = struct.unpack(order + code * count, raw[:size])
    width, height = tags[256][0], tags[257][0]
    key = (tags.get(258, (1,))[0], tags.get(339, (1,))[0])
    if tags.get(259, (1,))[0] != 1 or tags.get(277, (1,))[0] != 1 or key not in _DTYPE:
        raise ValueError("only uncompressed grey TIFF pages are read")
    parts = []
    for off, size in zip(tags[273], tags.get(279, (width * height * key[0] // 8,))):
        f.seek(off)
        parts.append(f.read(size))
    return np.frombuffer(b"".join(parts), order + _DTYPE[key])[: width * height].reshape(height, width)


@dataclass
class _Pages(InputPartition):
    path: str
    pos: int
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        path, own = path_and_options(options["path"])
        self.options = {**options, **own}
        self.paths = sorted(glob.glob(path)) or [path]

    def partitions(self):
        out = []
        for pos, path in enumerate(self.paths):
            with open(path, "rb") as f:
                n = len(page_offsets(f)[1])
            out += [_Pages(path, pos, a, min(a + PAGES_PER_TASK, n)) for a in range(0, n, PAGES_PER_TASK)]
        return out

    def read(self, partition):
        calibration, interval = float(self.options.get("calibration", 1.0)), float(self.options.get("interval", 1.0))
        with open(partition.path, "rb") as f:
            order, offsets = page_offsets(f)
            for t in range(partition.first, partition.last):
                page = read_page(f, order, offsets[t])
                yield os.path.basename(partition.path), partition.pos, t, t * interval, calibration, page.shape[0], page.shape[1], page.dtype.newbyteorder("=").name, page.astype(float).ravel().tolist()


class TiffStack(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiff_stack"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
