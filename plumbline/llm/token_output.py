"""Token ids in files of bit-plane shuffled blocks.

A file holds whole documents in ascending id order.  Their ids form one stream, cut into blocks of fixed size.  Each
block is transposed into byte planes (or bit planes): first all lowest bytes, then all second bytes, and so on.  Planes
of high bytes are nearly constant, and each plane is compressed on its own with zstandard.

    magic | planes of block 0 | planes of block 1 | ... | document index | block index | footer

The block index stores for every block its place, its number of ids, the compressed size of each plane and the crc32
of its ids, so a reader can seek to any id.  The document index stores ids and lengths.
"""

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plumbline.llm.common import new_path, settle, slices
from plumbline.llm.files import create, open_path, running_start, spread, task_file
from plumbline.llm.tokens import encoder, vocabulary

MAGIC = b"PLBPLN01"
END_ID = 0
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 23
_FOOTER = struct.Struct("<QQQQ8s")


def to_planes(ids, kind="byte"):
    """Unsigned 32-bit ids -> list of planes, lowest first."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [octets[:, i].tobytes() for i in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]


def from_planes(planes, n):
    """Inverse of to_planes for n ids; the number of planes tells their kind."""
    octets = np.empty((n, 4), np.uint8)
    if len(planes) == 4:
        for i, plane in enumerate(planes):
            octets[:, i] = np.frombuffer(plane, np.uint8)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        octets[:] = np.packbits(bits, axis=1, bitorder="little")
    return octets.reshape(-1).view("<u4")


class Writer:
    """One file; takes documents in order and holds at most one block of ids."""

    def __init__(self, path, block_ids=BLOCK_IDS, kind="byte"):
        import zstandard

        self.stream, self.path, self.block_ids, self.kind = create(path), path, block_ids, kind
        self.pack = zstandard.ZstdCompressor(level=3).compress
        self.stream.write(MAGIC)
        self.at, self.held, self.blocks = len(MAGIC), bytearray(), []
        self.names, self.lengths, self.ids = [], [], 0

    def add(self, name, ids):
        """name: a document's id or None; ids: little-endian unsigned 32-bit bytes."""
        self.names.append(name)
        self.lengths.append(len(ids) // 4)
        self.ids += len(ids) // 4
        step = 4 * self.block_ids
        for begin in range(0, len(ids), step):
            self.held += ids[begin:begin + step]
            while len(self.held) >= step:
                self._block(bytes(self.held[:step]))
                del self.held[:step]

    def _put(self, data):
        self.stream.write(data)
        self.at += len(data)

    def _block(self, raw):
        planes = [self.pack(p) for p in to_planes(np.frombuffer(raw, "<u4"), self.kind)]
        self.blocks.append([self.at, len(raw) // 4, [len(p) for p in planes], zlib.crc32(raw)])
        self._put(b"".join(planes))

    def close(self):
        if self.held:
            self._block(bytes(self.held))
        documents, where = self.at, []
        valid = np.array([n is not None for n in self.names], np.uint8)
        names = np.array([n if n is not None else 0 for n in self.names], "<i8")
        for array in (valid, names, np.array(self.lengths, "<i8")):
            data = self.pack(array.tobytes())
            where.append(len(data))
            self._put(data)
        index = self.at
        self._put(self.pack(json.dumps({"blocks": self.blocks, "documents": where}).encode()))
        self.stream.write(_FOOTER.pack(documents, index, self.at - index, self.ids, MAGIC))
        self.stream.close()
        return self.path, len(self.names), self.ids


class Reader:
    """One file: documents() streams all of it, slice() seeks by the block index."""

    def __init__(self, path):
        import zstandard

        system, place = open_path(path)
        self.file = system.open_input_file(place)
        self.unpack = lambda data: zstandard.ZstdDecompressor().decompress(data)
        self.file.seek(self.file.size() - _FOOTER.size)
        documents, index, size, self.ids, magic = _FOOTER.unpack(self.file.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {path}")
        self.file.seek(index)
        head = json.loads(self.unpack(self.file.read(size)))
        self.blocks = head["blocks"]
        self.file.seek(documents)
        valid, names, lengths = (self.unpack(self.file.read(n)) for n in head["documents"])
        self.valid = np.frombuffer(valid, np.uint8).astype(bool)
        self.names, self.lengths = np.frombuffer(names, "<i8"), np.frombuffer(lengths, "<i8")

    def block(self, i):
        at, n, sizes, crc = self.blocks[i]
        self.file.seek(at)
        raw = from_planes([self.unpack(self.file.read(s)) for s in sizes], n).tobytes()
        if zlib.crc32(raw) != crc:
            raise ValueError("a block's ids differ from their checksum")
        return raw

    def slice(self, start, stop):
        """Ids start..stop of the file as bytes, from the blocks that hold them."""
        ends = np.cumsum([b[1] for b in self.blocks])
        first = int(np.searchsorted(ends, start, "right"))
        last = int(np.searchsorted(ends, stop, "left"))
        raw = b"".join(self.block(i) for i in range(first, min(last, len(self.blocks) - 1) + 1))
        begin = start - (int(ends[first - 1]) if first else 0)
        return raw[4 * begin:4 * (begin + stop - start)]

    def documents(self):
        """(id or None, first id's place in the file, ids as bytes) of every document."""
        held, block, start = b"", 0, 0
        for name, ok, n in zip(self.names.tolist(), self.valid.tolist(), self.lengths.tolist()):
            parts, missing = [held[: 4 * n]], 4 * n - len(held)
            held = held[4 * n:]
            while missing > 0:
                raw = self.block(block)
                block += 1
                parts.append(raw[:missing])
                held = raw[missing:]
                missing -= len(raw)
            yield (name if ok else None), start, b"".join(parts)
            start += n


def write_tokens(docs, folder, id_column="doc_id", text_column="text", path=None, end_id=END_ID,
                 block_ids=BLOCK_IDS, file_ids=FILE_IDS, kind="byte"):
    """Encode every text and write token files; returns the settled manifest (path, part, sequence, documents, ids).

    Documents are range partitioned by id, so files follow one another in ascending id order; equal ids follow in
    the order of their texts, null ids come first.  A null text is an empty one: its end id only.  A file takes documents
    until it holds `file_ids` ids, so one file is longer than that only by one document.
    """
    path = path or vocabulary()
    end = struct.pack("<I", end_id)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    ordered = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", "text")

    def run(batches):
        from pyspark import TaskContext

        part, done, writer = TaskContext.get().partitionId(), [], None
        for piece in slices(batches):
            names, texts = piece.column(0).to_pylist(), piece.column(1).to_pylist()
            for name, ids in zip(names, encoder(path).ids([t or "" for t in texts])):
                writer = writer or Writer(task_file(folder, len(done), "tok"), block_ids, kind)
                writer.add(name, ids + end)
                if writer.ids >= file_ids:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        for i, (name, documents, ids) in enumerate(done):
            yield pa.RecordBatch.from_pydict({"path": [name], "part": [part], "sequence": [i],
                                              "documents": [documents], "ids": [ids]})

    return settle(ordered.mapInArrow(run, "path string, part long, sequence long, documents long, ids long"), "manifest")


def read_tokens(manifest, with_ids=False):
    """(id, start, n_tokens, ids_crc32[, ids]) of every document of the listed files; start counts over all files."""
    kinds = "id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for key, start, raw in Reader(name).documents():
                    row = {"id": key, "start": base + start, "n_tokens": len(raw) // 4, "ids_crc32": zlib.crc32(raw)}
                    rows.append(row | ({"ids": np.frombuffer(raw, "<u4").tolist()} if with_ids else {}))
                    if len(rows) >= (100 if with_ids else 5000):
                        yield pa.RecordBatch.from_pylist(rows, SCHEMAS[with_ids])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, SCHEMAS[with_ids])

    placed = running_start(manifest, "ids").select("path", "start")
    return spread(placed).mapInArrow(run, kinds)


_ROW = [("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
SCHEMAS = {False: pa.schema(_ROW), True: pa.schema([*_ROW, ("ids", pa.list_(pa.int64()))])}


def token_round_trip(docs, folder=None, **options):
    """Write all texts and read the files back."""
    return read_tokens(write_tokens(docs, folder or new_path(docs.sparkSession, "tokens"), **options))
