"""Frame stacks read by ranges of bytes, against numpy."""

from __future__ import annotations

import numpy as np
import pytest

from wavefield.sources import frames as frame_source
from wavefield.sources import stacks


def _values(df):
    rows = df.collect()
    got = {(r["row"], r["col"], r["frame"]): r["value"] for r in rows}
    assert len(got) == len(rows)
    return got


def _expected(stack, rows=slice(None), cols=slice(None), frames=slice(None)):
    inside = np.zeros(stack.shape, bool)
    inside[rows, cols, frames] = True
    return {tuple(int(x) for x in i): float(stack[tuple(i)]) for i in np.argwhere(inside)}


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("dtype", ["uint8", ">f4", "int64"])
@pytest.mark.parametrize("kind", ["npy", "stored", "compressed"])
def test_all_values(spark, tmp_path, order, dtype, kind):
    stack = np.asarray(np.arange(7 * 5 * 11).reshape(7, 5, 11) % 251, dtype=dtype, order=order)
    if kind == "npy":
        np.save(tmp_path / "site.npy", stack)
    else:
        (np.savez if kind == "stored" else np.savez_compressed)(tmp_path / "site.npz", other=np.ones(3), ImgSequence=stack)
    for rows in (1, 30, 100_000):
        assert _values(frame_source.read_frames(spark, str(tmp_path), "npz", rows=rows)) == _expected(stack)
    keep = {"row": (2, 6), "col": (1, 4), "frame": (3, 9)}
    for rows in (1, 30, 100_000):
        got = _values(frame_source.read_frames(spark, f"file:{tmp_path}/si*", "npz", rows=rows, keep=keep))
        assert got == _expected(stack, slice(2, 6), slice(1, 4), slice(3, 9))


@pytest.mark.parametrize("values", [1, 11, 60, 55, 110, 10_000])
@pytest.mark.parametrize("order", ["C", "F"])
def test_slabs_cover_once(tmp_path, values, order):
    stack = np.asarray(np.arange(7 * 5 * 11).reshape(7, 5, 11), order=order)
    np.save(tmp_path / "site.npy", stack)
    array = stacks.find_array(str(tmp_path / "site.npy"), "")
    parts = stacks.slabs("v", array, {"col": (1, 9)}, values)
    seen = {}
    for part in parts:
        before = len(seen)
        for rows in stacks.slab_rows(part, 20):
            for r in rows.to_pylist():
                assert seen.setdefault((r["row"], r["col"], r["frame"]), r["value"]) == r["value"]
        assert len(seen) - before <= max(values, array.shape[2])
    assert seen == _expected(stack, cols=slice(1, 5))


def test_large_stack_in_many_tasks(spark, tmp_path):
    """Four gigabytes, nearly all of them a hole in the file: parts are bounded, and a crop reads its own range."""
    shape = (1000, 1000, 4096)
    with open(tmp_path / "big.npy", "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": "|u1", "fortran_order": False, "shape": shape})
        start = f.tell()
        f.seek(start + (900 * 1000 + 500) * 4096 + 7)
        f.write(b"\x05")
        f.truncate(start + int(np.prod(shape)))
    array = stacks.find_array(str(tmp_path / "big.npy"), "")
    assert len(stacks.slabs("big", array, {}, stacks.TASK_VALUES)) == 2000  # 976 lines a part at most
    cut = frame_source.read_frames(spark, str(tmp_path / "big.npy"), "npy", keep={"row": (900, 901), "col": (490, 510)})
    rows = cut.collect()
    assert len(rows) == 20 * 4096 and [(r["row"], r["col"], r["frame"]) for r in rows if r["value"]] == [(900, 500, 7)]


def test_geometry_and_odd_files(spark, tmp_path):
    x, y = np.meshgrid(np.arange(4) * 2.0 + 100, np.arange(3) * 2.0 - 50)
    np.savez(tmp_path / "a.npz", ImgSequence=np.asfortranarray(np.ones((3, 4, 6))), dx=np.array([[2.0]]), dt=0.5, X=x, Y=y)
    np.savez_compressed(tmp_path / "b.npz", ImgSequence=np.ones((1, 2, 0)))
    (tmp_path / "_notes.npz").write_text("not an archive")
    got = {r["video_id"]: tuple(r)[1:] for r in frame_source.read_meta(spark, str(tmp_path)).collect()}
    assert got == {"a": (3, 4, 6, 2.0, 0.5, 100.0, -50.0), "b": (1, 2, 0, None, None, None, None)}
    assert frame_source.read_frames(spark, str(tmp_path), "npz").count() == 72
    assert frame_source.read_frames(spark, str(tmp_path / "b.npz"), "npz").count() == 0
    assert frame_source.read_frames(spark, str(tmp_path / "nothing*.npz"), "npz").count() == 0
    for array, wrong in (("dx", "three axes"), ("missing", "no array")):
        with pytest.raises(Exception, match=wrong):
            frame_source.read_frames(spark, str(tmp_path / "a.npz"), "npz", array=array).count()
    with pytest.raises(Exception, match="gone"):
        frame_source.read_frames(spark, str(tmp_path / "gone.npz"), "npz").count()
    with pytest.raises(ValueError, match="unknown format"):
        frame_source.read_frames(spark, str(tmp_path), "mat")
