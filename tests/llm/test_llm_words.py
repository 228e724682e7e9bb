import re
import subprocess
import sys

import numpy as np
import pytest

from plumbline.llm import words


@pytest.mark.parametrize("table,pattern", [(words.WHITE, rb"[^\x20\x09-\x0D]+"), (words.PLAIN, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
@pytest.mark.parametrize("text", ["", " ", "One two\tTWO\n\x0bé日本 a-b_c", "x" * 300 + " y" * 9, "\x00\x7f"])
def test_words_are_those_of_the_pattern(table, pattern, text):
    hashes, starts, ends, data = words.word_hashes(words.encode(text), table)
    want = re.findall(pattern, words.encode(text).lower())
    assert [data[a:b] for a, b in zip(starts, ends)] == want
    same = {}
    for h, w in zip(hashes.tolist(), want):
        assert same.setdefault(w, h) == h
    assert len(set(same.values())) == len(same)


def test_segments_do_not_change_hashes(monkeypatch):
    data = words.encode(" ".join(f"w{i} é" for i in range(500)) + " " + "z" * 200)
    whole = words.word_hashes(data)[0]
    monkeypatch.setattr(words.segments, "__defaults__", (37,))
    assert (words.word_hashes(data)[0] == whole).all()


def test_first_text_of_a_worker_may_be_empty():
    code = "from plumbline.llm import words; assert not len(words.word_hashes(b'')[0])"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=60)


def test_shingles():
    h = np.array([1, 2, 3, 1, 2, 3], np.uint64)
    s = words.shingles(h, 3)
    assert len(s) == 4 and s[0] == s[3] and len(set(s.tolist())) == 3
    assert len(words.shingles(h, 7)) == 0
