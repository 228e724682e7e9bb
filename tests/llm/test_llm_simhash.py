import random
from collections import Counter

import pytest
import xxhash
from llm_data import awkward, frame, prose, row

from plumbline.llm import simhash
from plumbline.llm.components import components


def plain_fingerprint(text, width=4):
    found = [w for w in __import__("re").findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())]
    runs = [b" ".join(found[i:i + width]) for i in range(len(found) - width + 1)] or ([b" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_groups(rows, radius=4):
    prints = [plain_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius or (rows[i][0] is not None and rows[i][0] == rows[j][0]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], f"{p:016x}", least.get(find(i))) for i, (r, p) in enumerate(zip(rows, prints))]


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(want)


def test_hash_is_the_one_of_spark(spark):
    for text in ["", "a", "abc def ghi jkl", "é" * 40]:
        got = spark.createDataFrame([(text,)], "t string").selectExpr("xxhash64(t) h").first()["h"] % (1 << 64)
        assert got == xxhash.xxh64_intdigest(text.encode(), 42)


@pytest.mark.parametrize("text", ["", "One", "a b C d", "a b c d e f a b c d e f", " x\x0by z ", prose(3, 40)])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [1, 2, 4, 6])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks = [m % (1 << 64) for m in simhash.covering_masks(radius)]
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = random.Random(radius)
    for _ in range(3000):
        flips = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
        assert any(m & flips == 0 for m in masks)


def test_awkward_rows(spark):
    rows = awkward()
    same(simhash.simhash_groups(frame(spark, rows)).drop("text_hash").collect(), plain_groups(rows))


def test_near_prints_link_through_chains_and_small_blocks(spark):
    rng = random.Random(5)
    prints = set()
    for _ in range(40):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            prints.add(p)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                p ^= 1 << b
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)], "fp long, rep long")
    got = dict(map(tuple, components(simhash.near_links(df, block=3)).collect()))
    root = list(range(len(prints)))
    for _ in prints:
        before = list(root)
        for i, p in enumerate(prints):
            root[i] = min(root[j] for j, q in enumerate(prints) if (p ^ q).bit_count() <= 4)
        if root == before:
            break
    assert {i: got.get(i, i) for i in range(len(prints))} == dict(enumerate(root))


def test_documents_of_one_word_pattern(spark):
    rows = [row(i, prose(1).replace("kar", f"kar{i % 7}")) for i in range(300)] + [row(900, "")]
    same(simhash.simhash_groups(frame(spark, rows)).drop("text_hash").collect(), plain_groups(rows))


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    same(simhash.simhash_groups(docs).drop("text_hash").collect(), plain_groups([tuple(r) for r in docs.select("doc_id", "text").collect()]))


def test_empty_table(spark):
    assert simhash.simhash_groups(frame(spark, [])).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(7, 7), (None, 3), (5000, 4999)] * 2
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 80)} | {5000: 4999}
    assert {k: v for k, v in got.items() if k != v} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
