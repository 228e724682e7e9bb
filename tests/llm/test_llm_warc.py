import gzip
import hashlib
import io
from collections import Counter

import pytest

from plumbline.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, n long, keeper long"
LONG, ALSO = "x" * 999 + "é", "y" * 1500


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, None) for r in rows], SCHEMA).repartition(3)


ROWS = [(1, "http://a", LONG), (2, "http://b", LONG), (5, "http://c\r\nX: y", LONG), (3, None, None), (4, "", ""), (6, "u", ALSO),
        (6, "u", ALSO), (7, "u", "z" * 999), (8, "u", "z" * 999), (None, "n", LONG), (None, "n", "w" * 1200), (9, "big", "q\r\n\r\n" * 90000)]


def expected(rows):
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        known = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        keeper = max(known) if known and len(body) >= 1000 else None
        again = keeper is not None and keeper != page
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", keeper if again else None))
    return out


def test_round_trip(spark):
    assert Counter(map(tuple, warc.warc_round_trip(pages(spark, ROWS)).collect())) == Counter(expected(ROWS))


def test_many_archives_and_payloads(spark, tmp_path):
    manifest = warc.write_warc(pages(spark, ROWS), str(tmp_path), archive_bytes=300)
    assert manifest.count() > 3
    got = warc.read_warc(manifest, with_payload=True).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(expected(ROWS))
    assert all(hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] for r in got if r["record_type"] == "response")


def test_one_member_per_record(spark, tmp_path):
    path = warc.write_warc(pages(spark, ROWS).coalesce(1), str(tmp_path)).first()["path"]
    data = open(path, "rb").read()
    found = list(warc.members(io.BytesIO(data), 7))
    assert b"".join(found) == gzip.decompress(data)
    assert [m[:10] for m in found] == [b"WARC/1.1\r\n"] * len(found)
    assert [m[-4:] for m in found] == [b"\r\n\r\n"] * len(found)


def test_damage_is_found():
    digest = hashlib.sha1(b"abc").hexdigest()
    good = warc.page_record(1, "u", b"abc", digest, 3, None, "2000-01-01T00:00:00Z")
    fields, block = warc.parse(next(warc.members(io.BytesIO(good))))
    assert warc.page_of(fields, block)[:5] == (1, 3, digest, "response", None)
    with pytest.raises(ValueError):
        warc.page_of(fields, block.replace(b"abc", b"abd"))
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(good[:-9])))
    with pytest.raises(ValueError):
        warc.parse(gzip.decompress(good)[:-3])


def test_empty_table(spark):
    assert warc.warc_round_trip(pages(spark, [])).count() == 0


def test_an_archive_cut_anywhere_is_found(spark, tmp_path):
    first = warc.write_warc(pages(spark, ROWS[:4]).coalesce(1), str(tmp_path)).first()
    data = open(first["path"].removeprefix("file:"), "rb").read()
    whole = len(list(warc.members(io.BytesIO(data))))
    for n in range(1, len(data)):
        try:
            assert len(list(warc.members(io.BytesIO(data[:n]), 64))) < whole  # cut between two records: fewer, and counted below
        except ValueError:
            pass
    borders = sum(1 for n in range(1, len(data)) if _reads(data[:n]))
    assert borders == whole - 1
    short = data[:next(n for n in range(len(data) - 1, 0, -1) if _reads(data[:n]))]
    path = tmp_path / "short.warc.gz"
    path.write_bytes(short)
    listed = spark.createDataFrame([(f"file:{path}", first["records"])], "path string, records long")
    with pytest.raises(Exception, match="page records and not"):
        warc.read_warc(listed).collect()
    assert warc.read_warc(listed.withColumn("records", listed["records"] - 1)).count() == first["records"] - 1


def _reads(data):
    try:
        list(warc.members(io.BytesIO(data)))
        return True
    except ValueError:
        return False
