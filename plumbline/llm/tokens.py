"""Token ids of whole texts with a public byte-level BPE file of the tokenizers library.

Encoding is the costly part of the token operators.  A byte-level BPE never merges across the pieces of its
pre-tokeniser, and a piece always starts at a plain space before a visible character and at a lone newline
between visible characters.  So a text may be cut there, and the ids of the parts follow one another.  Parts
recur, so each Python worker remembers their ids; parts it has not met are encoded together in one call.
Texts with neighbouring white space, or with white space at their start, are encoded as one piece.
"""

import codecs
import json
import re

import numpy as np

#: Parts remembered per worker; the store is emptied when it is full.
REMEMBERED = 700_000
#: Longer parts are not remembered.
LONGEST_PART = 64
_NEIGHBOURS = re.compile(r"\s\s")
#: A newline or nothing, letters, one sign: the pre-tokeniser makes a piece of each, a space goes with the letters.
_LETTERS = re.compile("\\n?[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?")
#: Names of the bytes in a byte-level vocabulary: printable ones are their own, the others follow from U+0100.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_NAMES = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_BYTE_NAMES = "\0" + "".join(_NAMES.get(b, chr(b)) for b in range(1, 256))  # 0 stands between pieces
_ENCODERS = {}


def vocabulary(name="byte_bpe_50k.json"):
    """Path of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids(texts) -> one little-endian unsigned 32-bit byte string per text."""

    def __init__(self, path):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.widths = np.zeros(size, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.widths[i] = len(token)  # one character of a token's name stands for one byte
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known, self.letters = {}, None
        kind = json.loads(self.tokenizer.to_str())
        split = kind["pre_tokenizer"] or {}
        if split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not kind["normalizer"]:
            self.letters = Tokenizer(self.tokenizer.model)
            self.letters.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\0")

    def whole(self, text):
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, parts):
        """Encode new parts as one text and cut the ids at the parts' byte ends."""
        if self.letters:
            plain = list(filter(_LETTERS.fullmatch, parts))
            if plain and len(plain) < len(parts):
                return self._cut(plain, self._pieces) | self._cut([p for p in parts if not _LETTERS.fullmatch(p)], self._text)
            return self._cut(parts, self._pieces if plain else self._text)
        return self._cut(parts, self._text)

    def _text(self, joined):
        return self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids

    def _pieces(self, joined):
        """Ids of parts of letters: their pieces are known, so the pre-tokeniser's pattern need not look for them."""
        marked = joined.replace("\n", "\0\n\0").replace(" ", "\0 ").replace(".", "\0.").replace(",", "\0,")
        named = codecs.charmap_decode(marked.encode(), "strict", _BYTE_NAMES)[0]
        return self.letters.encode_batch_fast([named], add_special_tokens=False)[0].ids

    def _cut(self, parts, encode):
        joined = (" " + " ".join(parts)).replace(" \n", "\n")
        ids = np.array(encode(joined), "<u4")
        octets = np.frombuffer(joined.encode(), np.uint8)
        ends = np.append(np.flatnonzero((octets == 0x20) | (octets == 0x0A))[1:], len(octets))  # a part starts at each of them
        cuts = np.searchsorted(np.cumsum(self.widths[ids]), ends, "left") + 1
        found, raw, start = {}, ids.tobytes(), 0
        for part, cut in zip(parts, (4 * cuts).tolist(), strict=True):
            found[part] = raw[start:cut]
            start = cut
        if start != len(raw):
            raise ValueError("parts do not add up to their text")
        return found

    def ids(self, texts):
        out, waiting, new = [None] * len(texts), [], {}
        if len(self.known) > REMEMBERED:
            self.known = {}
        get = self.known.get
        for i, text in enumerate(texts):
            if not text:
                out[i] = b""
            elif text[0].isspace() or text[-1].isspace() or _NEIGHBOURS.search(text) or any(a in text for a in self.added):
                out[i] = self.whole(text)
            else:
                words = ("\n" + text).replace("\n", " \n")[1:].split(" ")
                parts = list(map(get, words))
                if None in parts:
                    holes = [at for at, part in enumerate(parts) if part is None]
                    missed = [words[at] for at in holes]
                    new.update(dict.fromkeys(missed))
                    waiting.append((i, holes, missed, parts))
                else:
                    out[i] = b"".join(parts)[4:]  # without the newline put before the text
        if new:
            new = self._learn(list(new))
            for i, holes, missed, parts in waiting:
                for at, word in zip(holes, missed):
                    parts[at] = new[word]
                out[i] = b"".join(parts)[4:]
            self.known.update((w, p) for w, p in new.items() if len(w) <= LONGEST_PART)
        return out


def encoder(path):
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
