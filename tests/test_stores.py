"""Folders of files that tasks list and read, against Spark's own scans."""

import gzip
import io

import pytest

from plumbline.sources import readers, stores

COLUMNS = ["file_name", "file_path", "well_id", "depth_m", "sec_us_cm", "time", "time_frac", "depth_gl_m"]


def folder(root):
    files = {
        "a/AB1D_YSI_A_20220201.csv": b"Depth (m),SpCond (uS/cm),Time (HH:mm:ss)\r\n5.0,310,09:00:00\r\n\r\n4.0,bad,\"09:00, or \\\"so\\\"\"\r\n \t\n3.0\n2,1,x,y,z",
        "b b/AB2D_YSI_A_20220201.csv": b"\xef\xbb\xbfVertical Position m,Conductivity,Depth from GL (m) \n3.0,320,4.5\n,,\n",
        "b b/x=1/_y=2/AB3D_YSI_A_20220201.csv": b"\n  \nsec_us_cm,note,depth_m,depth_m\r1,\"x, y\",2.5,9\r2,\xff\xfe,3.5,9",
        "c/AB4D_YSI_A_20220201.csv": b"Battery,Depth (m)\n12,1.0\n", "c/AB5D_YSI_A_20220201.csv": b"", "c/AB6D_YSI_A_20220201.csv": b"\n \n",
        "c/AB7D_YSI_A_20220201.csv": b"\x00\x01\xff\xfe\n\x00", "c/AB8D_YSI_A_20220201.csv": b"Depth (m),Conductivity\n",
        "b b/100%, für [x]#?.csv": b"Depth (m),Conductivity\n7,8\n",
        "c/_AB9D_YSI_A_20220201.csv": b"Depth (m),Conductivity\n1,2\n", "c/.AB9D_YSI_A_20220201.csv": b"Depth (m),Conductivity\n1,2\n",
        "_d/AB9D_YSI_A_20220201.csv": b"Depth (m),Conductivity\n1,2\n",
        "e/AB9D_YSI_A_20220201.csv.gz": gzip.compress(b"Depth (m),Conductivity\n1,2\n3,4\n"),
        "e/AB9D_YSI_B_20220201.csv": b"Depth (m),Conductivity\n" + b"".join(b"%d,%d\n" % (i, i % 7) for i in range(3000)),
    }
    for name, data in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    return str(root)


def read(spark, place):
    casts, odd = readers.read_cast_folder(spark, place)
    rows = casts.orderBy("file_path", "block_start", "row_no").select(*COLUMNS).collect()
    return [tuple(r) for r in rows], sorted((r.file_path, r.reason) for r in odd.collect())


@pytest.mark.parametrize("piece", [stores.PIECE, 100])
def test_rows_are_those_of_the_scans(spark, tmp_path, monkeypatch, piece):
    place = folder(tmp_path / "in")
    monkeypatch.setattr(stores, "PIECE", piece)
    mine = read(spark, place)
    monkeypatch.setattr(stores, "listed", lambda *a: None)
    scanned = read(spark, place)
    assert mine == scanned
    assert len(mine[0]) > 3000 and len(mine[1]) == 4


def test_tasks_hold_the_names(spark, tmp_path):
    """Neither rows nor odd files come from a scan whose files the driver lists."""
    casts, odd = readers.read_cast_folder(spark, folder(tmp_path / "in"))
    for df in (casts, odd):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert " csv" not in plan and " text" not in plan
    assert casts.count() > 3000
    # the places of each header are sent to all tasks, the files are not
    assert casts._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == 1


@pytest.mark.parametrize("data", [b"", b"\n", b"a", b"a\n", b"a\r\nb\rc\n\nd\r\n\r\ne", b"\r\n\r\r\n\n", b"long line of words\nx\r\n" * 9, b"\na\r"])
def test_every_line_goes_to_one_piece(monkeypatch, data):
    for chunk in (1, 2, 5, 1000):
        monkeypatch.setattr(stores, "CHUNK", chunk)
        for piece in (1, 2, 3, 7, 1000):
            got = [x for a in range(0, max(1, len(data)), piece) for some in stores._lines(io.BytesIO(data), a, a + piece) for x in some]
            assert got == data.splitlines(), (chunk, piece)


def test_patterns_files_and_missing_folders(spark, tmp_path):
    place = folder(tmp_path / "in")
    assert {r.file_path.rsplit("/", 1)[1] for r in stores.listed(spark, f"{place}/[ab]*").df.selectExpr("path file_path").collect()} == {
        *[f"AB{k}D_YSI_A_20220201.csv" for k in (1, 2, 3)], "100%, für [x]#?.csv"}
    assert stores.listed(spark, f"{place}/c/AB5D_YSI_A_20220201.csv").df.count() == 1
    assert stores.listed(spark, f"{place}/none") is None
    assert stores.listed(spark, "nostore://host/in") is None
    (tmp_path / "empty").mkdir()
    casts, odd = readers.read_cast_folder(spark, str(tmp_path / "empty"))
    assert casts.count() == 0 and odd.count() == 0
