"""Words of UTF-8 texts as 64-bit hashes, computed over byte arrays.

A word's hash is a polynomial of its bytes: differences of one running sum, so all words of a text take a few array
operations.  Texts are worked on in segments cut between words, so memory does not follow a text's length.
"""

import numpy as np

SEGMENT = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_ORDER = np.uint64(0xD6E8FEB86659FD93)
_TABLES = {}


def separators(*ranges):
    """A byte table that lower-cases A-Z and turns the given byte ranges into spaces."""
    table = bytearray(range(256))
    for c in range(0x41, 0x5B):
        table[c] = c + 32
    for first, last in ranges:
        for c in range(first, last + 1):
            if not 0x41 <= c <= 0x5A:
                table[c] = 0x20
    return bytes(table)


#: Words between ASCII white space.
WHITE = separators((0x09, 0x0D), (0x20, 0x20))
#: Words of letters, digits and everything beyond ASCII.
PLAIN = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def _powers(n):
    if "up" not in _TABLES or len(_TABLES["up"]) < n:
        size = max(n, SEGMENT + 1)
        _TABLES["up"] = np.cumprod(np.full(size, _BASE))
        _TABLES["down"] = np.cumprod(np.full(size, _INVERSE))
    return _TABLES["up"][:n], _TABLES["down"]


def mix(h):
    h = (h ^ (h >> np.uint64(32))) * _ORDER
    h = (h ^ (h >> np.uint64(29))) * _BASE
    return h ^ (h >> np.uint64(32))


def encode(text):
    return (text or "").encode("utf-8", "surrogatepass")


def segments(data, size=SEGMENT):
    """Pieces of bytes (separators are spaces already), cut at spaces."""
    start = 0
    while len(data) - start > size:
        cut = data.rfind(b" ", start + 1, start + size)
        if cut < 0:
            cut = data.find(b" ", start + size)
            if cut < 0:
                break
        yield start, data[start:cut]
        start = cut
    yield start, data[start:]


def word_hashes(data, table=WHITE):
    """bytes -> (hashes, starts, ends, bytes with separators as spaces)."""
    data = data.translate(table)
    out = [[], [], []]
    for base, piece in segments(data):
        octets = np.frombuffer(piece, np.uint8)
        edges = np.diff(np.concatenate(([0], (octets != 0x20).view(np.int8), [0])))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        up, down = _powers(len(octets))
        sums = np.zeros(len(octets) + 1, np.uint64)
        np.cumsum((octets + np.uint64(1)) * up, out=sums[1:])
        out[0].append(mix((sums[ends] - sums[starts]) * down[starts]) if len(starts) else np.empty(0, np.uint64))
        out[1].append(starts + base)
        out[2].append(ends + base)
    return (*(np.concatenate(x) for x in out), data)


def shingles(hashes, width):
    """Hashes of all runs of `width` words, in order."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, np.uint64(width), np.uint64)
    for j in range(width):
        h = (h ^ hashes[j:j + n]) * _ORDER
        h ^= h >> np.uint64(31)
    return h


def run_hashes(hashes):
    """Word hashes -> a function of (first words, ends): the hashes of those runs of words."""
    up, down = _powers(len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up, out=sums[1:])
    return lambda first, end: mix((sums[end] - sums[first]) * down[first])
