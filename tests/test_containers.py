"""Containers written byte by byte, read through the data source."""

import struct
import zlib

import numpy as np
import pytest

from ambulo.sources import containers


def element(kind, raw, order="<"):
    return struct.pack(order + "II", kind, len(raw)) + raw + b"\0" * (-len(raw) % 8)


def short(kind, raw, order="<"):
    return struct.pack(order + "I", len(raw) << 16 | kind) + raw.ljust(4, b"\0")


def head(array_class, dims, name, order):
    own = element(1, name.encode(), order) if len(name) > 4 or not name else short(1, name.encode(), order)
    return element(6, struct.pack(order + "II", array_class, 0), order) + element(5, struct.pack(order + f"{len(dims)}i", *dims), order) + own


def matrix(name, values, order="<", kind=9):
    a = np.asarray(values, np.dtype(containers.KINDS[kind]).newbyteorder(order))
    return element(14, head(6, a.shape, name, order) + element(kind, a.tobytes(order="F"), order), order)


def text(name, value, order="<"):
    return element(14, head(4, (1, len(value)), name, order) + element(17, np.frombuffer(value.encode("utf-16-le"), "<u2").astype(np.dtype("u2").newbyteorder(order)).tobytes(), order), order)


def record(name, order="<", **fields):
    names = b"".join(k.encode().ljust(32, b"\0") for k in fields)
    return element(14, head(2, (1, 1), name, order) + short(5, struct.pack(order + "i", 32), order) + element(1, names, order) + b"".join(fields.values()), order)


def container(*parts, order="<", packed=False):
    mark = b"IM" if order == "<" else b"MI"
    body = b"".join(struct.pack(order + "II", 15, len(z)) + z for z in map(zlib.compress, parts)) if packed else b"".join(parts)
    return b"MATLAB 5.0 MAT-file".ljust(124, b" ") + struct.pack(order + "H", 0x0100) + mark + body


ACC = np.round(np.random.default_rng(1).normal(size=(1000, 3)), 3)


def test_files_of_both_devices_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(containers, "BATCH", 300)
    (tmp_path / "a").mkdir()
    (tmp_path / "info").mkdir()
    for order, name, packed in (("<", "one.mat", False), (">", "two.mat", True)):
        v = record("values", order, acc=matrix("", ACC, order), sampFreq=matrix("", [[31.25]], order), header=text("", "Serial 5 Start Time:2020-03-01 10:00:30:500 end", order))
        (tmp_path / "a" / name).write_bytes(container(v, order=order, packed=packed))
    (tmp_path / "a" / "three.mat").write_bytes(container(matrix("New_Data", ACC[:5].astype("f4"), kind=7), matrix("n", [[1, 2]], kind=4)))
    start = record("start", str=text("", "2021-01-02 03:04:05"))
    (tmp_path / "info" / "three_info.mat").write_bytes(container(record("fileinfo", start=start)))
    (tmp_path / "a" / "four.mat").write_bytes(container(matrix("New_Data", ACC[:5])))
    (tmp_path / "a" / "five.mat").write_bytes(b"\x89HDF\r\n\x1a\n" + b"\0" * 200)
    (tmp_path / "a" / "six.mat").write_bytes(container(matrix("other", ACC)))
    (tmp_path / "a" / "seven.mat").write_bytes(b"short")
    spark.dataSource.register(containers.RecordingSource)
    df = spark.read.format("recordings").load(str(tmp_path))
    rows = {}
    for r in df.collect():
        rows.setdefault(r["path"].rsplit("/", 1)[-1], []).append(r)
    for name in ("one.mat", "two.mat"):
        own = sorted(rows[name], key=lambda r: r["i"])
        assert np.array_equal([[r["x"], r["y"], r["z"]] for r in own], ACC) and [r["i"] for r in own] == list(range(1000))
        assert {(r["device"], r["hz"], r["start_sec"], r["error"]) for r in own} == {("first", 31.25, 1583056830.0, None)}
    assert {(r["device"], r["hz"], r["start_sec"]) for r in rows["three.mat"]} == {("second", 50.0, 1609556645.0)} and len(rows["three.mat"]) == 5
    errors = {n: r[0]["error"] for n, r in rows.items() if r[0]["error"]}
    assert set(errors) == {"four.mat", "five.mat", "six.mat", "seven.mat"} and "companion" in errors["four.mat"] and "7.3" in errors["five.mat"] and "neither" in errors["six.mat"]
    assert df.rdd.getNumPartitions() == 7 and "three_info.mat" not in rows


def test_empty_folder(spark, tmp_path):
    spark.dataSource.register(containers.RecordingSource)
    assert spark.read.format("recordings").load(str(tmp_path)).count() == 0


@pytest.mark.parametrize("value", [b"", b"x" * 200])
def test_other_files_are_refused(value):
    with pytest.raises(ValueError):
        containers.read_container(value)
