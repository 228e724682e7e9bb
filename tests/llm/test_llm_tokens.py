import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import awkward, frame, row

from plumbline.llm import packing, token_output
from plumbline.llm.tokens import Encoder, encoder, vocabulary

SF = "/root/testdata/sf0.001"


def whole(text):
    return np.array(encoder(vocabulary()).tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4")


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab 'sZ9\n\t\r.,é日😀  <|endoftext|>"), max_size=40))
def test_parts_give_the_ids_of_whole_texts(text):
    assert encoder(vocabulary()).ids([text])[0] == whole(text).tobytes()


def test_special_token_and_long_text():
    for text in ["a<|endoftext|> b", "x " * 5000 + "end", "y" * 3000]:
        assert encoder(vocabulary()).ids([text, text]) == [whole(text).tobytes()] * 2


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZtsé×ÿßñ'.,9ı\t<|"), min_size=1, max_size=9), max_size=12), st.sampled_from([" ", "\n"]))
def test_new_words_give_the_ids_of_whole_texts(words, between):
    made, text = Encoder(vocabulary()) if len(words) == 12 else encoder(vocabulary()), between.join(words)
    assert made.ids([text, "x " + text]) == [whole(text).tobytes(), whole("x " + text).tobytes()]


def test_new_words_of_letters_are_encoded_without_the_pattern():
    class Closed:
        def encode_batch_fast(self, *args, **options):
            raise AssertionError("the pattern was searched")

    texts = ["Élan vital, und Grüße.\nNiño, fin.", "Élan vital nuevo."]
    made = Encoder(vocabulary())
    made.tokenizer = Closed()
    assert made.ids(texts) == [whole(t).tobytes() for t in texts]


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 100])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, np.uint32)
    planes = token_output.to_planes(ids, kind)
    assert len(planes) == (4 if kind == "byte" else 32)
    assert (token_output.from_planes(planes, n) == ids).all()


def expected_tokens(rows):
    out, start = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.append(whole(r[1]), 0).astype("<u4")
        out.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("kind,block,limit", [("byte", 1 << 16, 1 << 23), ("bit", 64, 500)])
def test_files_hold_all_documents_in_order(spark, tmp_path, kind, block, limit):
    rows = awkward()
    manifest = token_output.write_tokens(frame(spark, rows), str(tmp_path), kind=kind, block_ids=block, file_ids=limit)
    got = [tuple(r) for r in token_output.read_tokens(manifest).collect()]
    want = expected_tokens(rows)
    assert sorted(got, key=lambda r: r[1]) == want
    assert manifest.agg({"documents": "sum"}).first()[0] == len(rows)


def test_reader_seeks_by_the_block_index(spark, tmp_path):
    rows = [r for r in awkward() if r[0] is not None]
    manifest = token_output.write_tokens(frame(spark, rows).coalesce(1), str(tmp_path), block_ids=50)
    reader = token_output.Reader(manifest.first()["path"])
    everything = b"".join(ids for _, _, ids in reader.documents())
    for start, stop in [(0, 1), (49, 51), (10, 260), (reader.ids - 3, reader.ids)]:
        assert reader.slice(start, stop) == everything[4 * start:4 * stop]


def test_ids_come_back(spark):
    got = token_output.read_tokens(token_output.write_tokens(
        frame(spark, [row(1, "a b")]), token_output.new_path(spark, "t")), with_ids=True).first()
    assert got["ids"] == [*whole("a b").tolist(), 0]


def test_empty_table(spark):
    empty = frame(spark, [])
    assert token_output.token_round_trip(empty).count() == 0
    assert packing.pack(empty).count() == 0


def plain_best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fitting = [g for g in gaps if g >= n]
        if fitting:
            gaps.remove(min(fitting))
            gaps.append(min(fitting) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(12))
def test_runs_are_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 37, 64])
    lengths = [min(capacity, 1 + int(rng.expovariate(1 / rng.choice([3, 9, 20])))) for _ in range(rng.randrange(1, 300))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    placed, opened = packing.best_fit(counts, capacity)
    assert opened == plain_best_fit(lengths, capacity)
    fill = {}
    for length, _, n, first, sequences, offset in placed:
        for k in range(n):
            fill.setdefault(first + k % sequences, []).append((offset + length * (k // sequences), length))
    for taken in fill.values():
        at = 0
        for offset, length in sorted(taken):
            assert offset == at
            at += length
        assert at <= capacity
    assert sum(len(x) for x in fill.values()) == len(lengths)


def check_packing(rows, got, capacity):
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for taken in by_sequence.values():
        at = 0
        for offset, length in sorted(taken):
            assert offset == at
            at += length
        assert at <= capacity
    want = []
    for r in rows:
        ids, start = np.append(whole(r[1]), 2).astype("<u4"), 0
        for k, n in enumerate(packing.cut_lengths(len(ids), capacity)):
            want.append((r[0], k, start, n, zlib.crc32(ids[start:start + n].tobytes())))
            start += n
        assert start == len(ids)
    order = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted((tuple(r)[:5] for r in got), key=order) == sorted(want, key=order)
    assert len(by_sequence) == plain_best_fit([w[3] for w in want], capacity)


@pytest.mark.parametrize("capacity", [64, 1024])
def test_packing_of_awkward_rows(spark, capacity):
    rows = awkward()
    check_packing(rows, packing.pack(frame(spark, rows), capacity=capacity).collect(), capacity)


def test_packing_with_one_length_for_most_rows(spark):
    rows = [row(i, "same words here") for i in range(700)] + [row(1000 + i, "x y z " * i) for i in range(60)]
    check_packing(rows, packing.pack(frame(spark, rows), capacity=100).collect(), 100)


def test_packing_of_the_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_packing(rows, packing.pack(spark.read.parquet(f"{SF}/documents.parquet")).collect(), 1024)


def test_no_piece_but_the_first_is_short():
    assert packing.cut_lengths(5, 4) == [1, 4]
    assert packing.cut_lengths(8, 4) == [4, 4]
    assert packing.cut_lengths(4, 4) == [4]
