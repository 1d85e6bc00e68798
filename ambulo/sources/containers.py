"""Recordings in level-5 containers of a numerical environment, as a Spark data source.

    spark.dataSource.register(RecordingSource)
    spark.read.format("recordings").load("/folder")

Every file is a partition of its own, opened by the executor that reads it. A file of the first device has a struct
`values` (acc, sampFreq, header); one of the second a matrix `New_Data` at 50 Hz and a companion file `<name>_info`, in
the same folder or in `../info`, with the start. A file that cannot be read is one row with its error and no sample.
"""

from __future__ import annotations

import datetime
import os
import re
import struct
import zlib
from glob import glob

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format: element types, classes of arrays.
KINDS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
MATRIX, COMPRESSED = 14, 15
CELL, STRUCT, CHAR = 1, 2, 4
#: Sampling rate of the second device's files, which do not state it.
SECOND_HZ = 50.0
#: Samples in one batch of rows.
BATCH = 1 << 16
SCHEMA = "path string, device string, hz double, start_sec double, i long, x double, y double, z double, error string"


def _element(data: bytes, at: int, order: str) -> tuple[int, bytes, int]:
    """Type and bytes of the element at a position, and where the next one begins."""
    kind, size = struct.unpack_from(order + "II", data, at)
    if kind >> 16:  # short: type and size share a word, the data follows in the next
        return kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)], at + 8
    end = at + 8 + size
    return kind, data[at + 8 : end], end if kind == COMPRESSED else end + (-size % 8)


def _numbers(kind: int, raw: bytes, order: str) -> np.ndarray:
    return np.frombuffer(raw, np.dtype(KINDS[kind]).newbyteorder(order))


def _array(data: bytes, order: str):
    """Name and value of a matrix element: arrays, text, structs as dicts (one struct) and cells as lists."""
    _, raw, at = _element(data, 0, order)
    shape_class = struct.unpack_from(order + "I", raw)[0] & 0xFF
    _, raw, at = _element(data, at, order)
    dims = np.frombuffer(raw, np.dtype("i4").newbyteorder(order)).tolist()
    _, raw, at = _element(data, at, order)
    name = raw.decode("ascii", "replace")
    count = int(np.prod(dims))
    if shape_class == STRUCT:
        _, raw, at = _element(data, at, order)
        width = struct.unpack_from(order + "i", raw)[0]
        _, raw, at = _element(data, at, order)
        fields = [raw[k : k + width].split(b"\0")[0].decode("ascii", "replace") for k in range(0, len(raw), width)]
        rows = []
        for _ in range(count):
            row = {}
            for f in fields:
                _, raw, at = _element(data, at, order)
                row[f] = _array(raw, order)[1] if raw else np.empty((0, 0))
            rows.append(row)
        return name, rows[0] if count == 1 else rows
    if shape_class == CELL:
        cells = []
        for _ in range(count):
            _, raw, at = _element(data, at, order)
            cells.append(_array(raw, order)[1] if raw else None)
        return name, cells
    kind, raw, at = _element(data, at, order)
    values = _numbers(kind, raw, order)
    if shape_class == CHAR:
        grid = values.reshape(dims, order="F")
        lines = ["".join(map(chr, row)).rstrip() for row in grid.reshape(grid.shape[0], -1)] if values.size else [""]
        return name, lines[0] if len(lines) == 1 else lines
    return name, values.reshape(dims, order="F")


def read_container(data: bytes) -> dict:
    """The variables of a level-5 container."""
    if data[:8] == b"\x89HDF\r\n\x1a\n" or b"MATLAB 7.3" in data[:128]:
        raise ValueError("a version 7.3 container, which is an HDF5 file: no reader for it is installed")
    if len(data) < 128 or data[126:128] not in (b"IM", b"MI"):
        raise ValueError("no level-5 container")
    order, at, out = "<" if data[126:128] == b"IM" else ">", 128, {}
    while at + 8 <= len(data):
        kind, raw, at = _element(data, at, order)
        if kind == COMPRESSED:
            kind, raw, _ = _element(zlib.decompress(raw), 0, order)
        if kind == MATRIX and raw:
            name, value = _array(raw, order)
            out[name] = value
    return out


def _text(value) -> str:
    return "".join(map(_text, value)) if isinstance(value, list) else str(value)


def _seconds(text: str) -> float:
    found = re.search(r"(\d{4}-\d{2}-\d{2}) (\d{2}:\d{2}:\d{2})", text)
    if not found:
        raise ValueError("no start time")
    return datetime.datetime.fromisoformat(f"{found[1]}T{found[2]}+00:00").timestamp()


def extract(path: str) -> tuple[str, float, float, np.ndarray]:
    """Device, sampling rate, start in seconds since 1970 and the samples (n, 3) of a recording."""
    with open(path, "rb") as f:
        held = read_container(f.read())
    if "values" in held:
        v = held["values"]
        header = re.search(r"Start Time:\s*(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", _text(v["header"]))
        if not header:
            raise ValueError("no start time in the header")
        return "first", float(np.ravel(v["sampFreq"])[0]), _seconds(header[1]), np.asarray(v["acc"], float)
    if "New_Data" not in held:
        raise ValueError("neither device's variables")
    stem, end = os.path.splitext(os.path.basename(path))
    folder = os.path.dirname(path)
    for place in (folder, os.path.join(os.path.dirname(folder), "info")):
        info = os.path.join(place, f"{stem}_info{end}")
        if os.path.exists(info):
            with open(info, "rb") as f:
                start = read_container(f.read())["fileinfo"]["start"]["str"]
            return "second", SECOND_HZ, _seconds(_text(start)), np.asarray(held["New_Data"], float)
    raise ValueError("no companion file")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, folder: str, pattern: str):
        self.folder, self.pattern = folder.removeprefix("file://"), pattern

    def partitions(self):
        """A partition for each recording; companion files are read with theirs. Files are listed, not opened."""
        files = sorted(glob(os.path.join(self.folder, "**", self.pattern), recursive=True))
        kept = [f for f in files if not os.path.splitext(f)[0].endswith("_info")]
        return [_File(f) for f in kept]

    def read(self, partition):
        if partition is None:  # there are no files
            return
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
        try:
            device, hz, start, samples = extract(partition.path)
            if samples.ndim != 2 or samples.shape[1] != 3:
                raise ValueError(f"samples of shape {samples.shape}")
        except Exception as e:  # noqa: BLE001
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([partition.path, *[None] * 7, str(e)[:500]], types, strict=True)], names)
            return
        for at in range(0, len(samples), BATCH):
            part = samples[at : at + BATCH]
            n = len(part)
            same = [pa.array([v] * n, t) for v, t in ((partition.path, pa.string()), (device, pa.string()), (hz, pa.float64()), (start, pa.float64()))]
            yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(at, at + n)), *(pa.array(np.ascontiguousarray(part[:, k])) for k in range(3)), pa.nulls(n, pa.string())], names)


class RecordingSource(DataSource):
    """Format `recordings`: path (a folder that all executors see), and `pathGlobFilter`, *.mat unless given."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("pathGlobFilter", "*.mat"))
