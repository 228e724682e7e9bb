"""WARC archives: one gzip member per record, read sequentially with bounded memory."""

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from plumbline.llm.common import new_path, settle, slices
from plumbline.llm.files import create, open_path, spread, task_file

#: Payloads below this length are always stored.
LEAST_REVISITED = 1000
#: A new archive is begun beyond so many compressed bytes.
ARCHIVE_BYTES = 1 << 25
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = 1 << 18


def _record(kind, name, block, fields, date):
    head = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date), *fields, ("Content-Length", len(block))]
    text = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    data = b"WARC/1.1\r\n" + text.encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _header_text(value):
    """A value without characters that would end its line."""
    return None if value is None else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def page_record(page, url, payload, digest, n_bytes, refers_to, date):
    """One response, or a revisit whose block has the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    fields = [("WARC-Target-URI", _header_text(url)),
              ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
              ("Content-Type", "application/http; msgtype=response")]
    name = f"<urn:page:{'none' if page is None else page}>"
    if refers_to is None:
        return _record("response", name, http + payload, fields, date)
    return _record("revisit", name, http, [*fields, ("WARC-Profile", _PROFILE),
                                           ("WARC-Refers-To", f"<urn:page:{refers_to}>")], date)


def members(stream, size=_READ):
    """Decompressed gzip members of a stream, one after the other, from reads of `size` bytes."""
    unpacker, parts, rest, begun = zlib.decompressobj(31), [], b"", False
    while True:
        data = rest or stream.read(size)
        if not data:
            break
        begun = True  # even one byte of a member that does not end is a record lost
        parts.append(unpacker.decompress(data))
        rest = unpacker.unused_data
        if unpacker.eof:
            yield b"".join(parts)
            unpacker, parts, begun = zlib.decompressobj(31), [], False
    if begun:
        raise ValueError("the last record is cut off")


def parse(record):
    """A record -> (fields with lower-case names, block); its length framing is checked."""
    head, mark, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's content length is wrong")
    return fields, rest[:n]


def _number(name):
    tail = name.removeprefix("<urn:page:").removesuffix(">")
    return None if tail == "none" else int(tail)


def page_of(fields, block):
    """A response or revisit record -> (page, bytes, digest, kind, refers_to, payload); the digest is verified."""
    http, _, payload = block.partition(b"\r\n\r\n")
    said = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}
    digest, n = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex(), int(said["content-length"])
    if fields["warc-type"] == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    refers = fields.get("warc-refers-to")
    return _number(fields["warc-record-id"]), n, digest, fields["warc-type"], refers and _number(refers), payload


def write_warc(pages, folder, id_column="page_id", url_column="url", html_column="html", least=LEAST_REVISITED,
               archive_bytes=ARCHIVE_BYTES, date="2000-01-01T00:00:00Z"):
    """Write a record per row; returns the settled manifest of archives (path, records).

    Null html is an empty payload, a null url has no target line.  Of equal payloads of at least `least` bytes the
    largest id is the response and the others refer to it; rows that repeat that id are responses as well, rows
    without an id refer to it.  If no id is known, all are responses.
    """
    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).cast("string").alias("url"),
                        F.coalesce(F.col(html_column).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload").cast("long")})
    rows = rows.withColumn("mark", F.when(F.col("n") >= least, F.xxhash64("payload")))
    same = (rows.where("mark IS NOT NULL").groupBy("digest", "n", "mark")
            .agg(F.max("id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1").drop("copies"))
    marked = rows.join(same, ["digest", "n", "mark"], "left")
    revisits = F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))
    marked = marked.select("id", "url", F.when(~revisits, F.col("payload")).alias("payload"), "digest", "n",
                           F.when(revisits, F.col("keeper")).alias("refers_to"))

    def run(batches):
        stream, done, place, records, size = None, [], None, 0, 0
        for part in slices(batches):
            for row in zip(*(c.to_pylist() for c in part.columns)):
                if stream is None:
                    place, records = task_file(folder, len(done), "warc.gz"), 0
                    stream = create(place)
                    head = _record("warcinfo", "<urn:archive>", b"format: WARC File Format 1.1\r\n",
                                   [("Content-Type", "application/warc-fields")], date)
                    stream.write(head)
                    size = len(head)
                data = page_record(*row, date)
                stream.write(data)
                size, records = size + len(data), records + 1
                if size >= archive_bytes:
                    stream.close()
                    done.append((place, records))
                    stream = None
        if stream is not None:
            stream.close()
            done.append((place, records))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "records"])

    return settle(marked.mapInArrow(run, "path string, records long"), "archives")


_ROW = pa.schema([("id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                  ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_warc(manifest, with_payload=False):
    """(id, payload_bytes, payload_digest, record_type, refers_to[, payload]) of every page record of the archives.

    `manifest` lists path and records, as `write_warc` returns them.  A damaged archive fails the job: a member that is cut
    off or does not unpack, a wrong length or digest, or a number of page records that is not the listed one (null: any).
    """
    fields = _ROW if with_payload else pa.schema(list(_ROW)[:5])

    def run(batches):
        for batch in batches:
            for path, listed in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("path", "records"))):
                system, place = open_path(path)
                rows, found = [], 0
                with system.open_input_stream(place, compression=None) as stream:
                    for record in members(stream):
                        head, block = parse(record)
                        if head["warc-type"] in ("response", "revisit"):
                            rows.append(dict(zip(_ROW.names, page_of(head, block))))
                            found += 1
                        if len(rows) >= 256:
                            yield pa.RecordBatch.from_pylist(rows, fields)
                            rows = []
                if listed is not None and found != listed:
                    raise ValueError(f"{path} holds {found} page records and not {listed}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, fields)

    kinds = "id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return spread(manifest).mapInArrow(run, kinds + (", payload binary" if with_payload else ""))


def warc_round_trip(pages, folder=None, **options):
    """Write all pages and read the archives back."""
    return read_warc(write_warc(pages, folder or new_path(pages.sparkSession, "warc"), **options))
