import random

import pytest
from llm_data import awkward, frame, prose, row

from plumbline.llm import paragraphs
from plumbline.llm.words import WHITE, encode, word_hashes


def runs(split, marks, least, apart=20):
    """(first, last) line of every paragraph, straight from the definition."""
    counts = [len(x) for x in split]
    short = lambda i: 0 < counts[i] < least
    rank = lambda i: (counts[i] < apart, marks[i] if counts[i] < apart else 0, i)
    gap = lambda a, b: sum(counts[min(a, b):max(a, b)])
    for i in range(len(split)):
        if counts[i] >= least:
            yield i, i
        elif counts[i] and (counts[i] >= apart or all(rank(i) < rank(k) for k in range(len(split)) if k != i and short(k) and gap(i, k) < apart)):
            ends = [j for j in range(i, len(split)) if sum(counts[i:j + 1]) >= least]
            if ends and all(c < least for c in counts[i:ends[0] + 1]):
                yield i, ends[0]


def plain(rows, least=50, similar=0.8):
    found = []
    for r in rows:
        lines, at, starts = (r[1] or "").split("\n"), 0, []
        for line in lines:
            starts.append(at)
            at += len(line) + 1
        split = [[x.decode() for x in line.encode().lower().split()] for line in lines]
        marks = [int(sum(int(h) for h in word_hashes(encode(line), WHITE)[0]) % (1 << 64) % (1 << 63)) for line in lines]
        for k, j in runs(split, marks, least):
            w = [x for line in split[k:j + 1] for x in line]
            if len(w) >= 5:
                found.append((r[0], k, starts[k], starts[j] + len(lines[j]), len(w), {tuple(w[i:i + 5]) for i in range(len(w) - 4)}))
    root = list(range(len(found)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(found):
        for j, b in enumerate(found[:i]):
            if len(a[5] & b[5]) >= similar * len(a[5] | b[5]):
                root[find(i)] = find(j)
    groups, out = {}, []
    for i, a in enumerate(found):
        groups.setdefault(find(i), []).append(a)
    for members in groups.values():
        if len(members) > 1:
            kept = min((a[0] is None, a[0] or 0, a[1]) for a in members)
            name = None if kept[0] else kept[1]
            out += [(*a[:5], name, kept[2], (a[0], a[1]) != (name, kept[2])) for a in members]
    return sorted(out, key=str)


def got(spark, rows, **options):
    return sorted(map(tuple, paragraphs.repeated_paragraphs(frame(spark, rows), **options).collect()), key=str)


def test_awkward_rows(spark):
    for words in (4, 12, 50):
        assert got(spark, awkward(), words=words) == plain(awkward(), words)


def near(seed, changes):
    rng = random.Random(seed)
    w = prose(900, 1, 80).split(" ")
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"new{rng.random()}"
    return " ".join(w)


@pytest.mark.parametrize("block", [5, 256])
def test_chains_of_near_copies(spark, block):
    rows = [row(i, f"{prose(i, 2)}\n{near(i, i % 6)}\n{prose(2000 + i % 9, 1, 60)}") for i in range(60)]
    want = plain(rows)
    assert len(want) > 60
    assert got(spark, rows, block=block) == want


def test_bands_find_pairs_at_the_threshold():
    rng = random.Random(1)
    missed = 0
    for _ in range(200):
        a = {rng.getrandbits(63) for _ in range(180)}
        b = set(list(a)[:160]) | {rng.getrandbits(63) for _ in range(20)}
        assert len(a & b) / len(a | b) == 0.8
        x, y = (paragraphs.bands_of(__import__("numpy").array(sorted(s), "u8")) for s in (a, b))
        missed += not (x == y).any()
    assert missed <= 1


def test_passage_shared_by_most_documents(spark):
    rows = [row(i, f"{prose(i, 1)}\n{prose(77, 1, 60)}") for i in range(300)]
    removed = [r for r in got(spark, rows) if r[7]]
    assert len(removed) == 299 and {r[5] for r in removed} == {0}


def test_clean_documents_do_not_appear(spark):
    assert got(spark, [row(i, prose(i, 3, 70)) for i in range(50)]) == []
    assert got(spark, []) == []


def passage(seed, lines):
    return "\n".join(prose(seed * 50 + k, 1, n) for k, n in enumerate(lines))


def test_passages_over_short_lines(spark):
    """Passages of over 50 words, whole lines of any length, among lines of other texts; other documents stay clean."""
    shapes = [(31, 31, 31), (12, 9, 25, 14), (2, 10, 33, 9, 18), (20, 20, 15), (8, 8, 8, 8, 8, 8, 8, 8, 8), (5,) * 14, (49, 30), (60,)]
    rows, holders = [], set()
    for k, shape in enumerate(shapes):
        for c in range(2):
            i = 10 * k + c
            text = "\n".join([passage(3000 + i, (7, 30, 11, 22)), passage(900 + k, shape), passage(5000 + i, (15, 70, 6, 40))])
            rows.append(row(i, text))
            holders.add(i)
    rows += [row(500 + i, passage(7000 + i, (4, 9, 30, 12, 45, 3, 3, 3, 20, 60, 7))) for i in range(40)]
    found = got(spark, rows)
    assert found == plain(rows)
    seen = {r[0] for r in found}
    assert seen <= holders and len(seen) >= 0.9 * len(holders)


def test_neighbouring_runs_of_one_text_are_not_alike():
    rng = random.Random(5)
    for _ in range(300):
        counts = [rng.choice([1, 2, 3, 8, 12, 19, 20, 35, 49, 50, 80, 0]) for _ in range(rng.randint(1, 40))]
        spans = paragraphs.spans_of(counts, [rng.randrange(9) for _ in counts])
        for (a, b), (c, d) in zip(spans, spans[1:]):
            size, ahead = sum(counts[a:b + 1]) - 4, sum(counts[a:c])
            assert c > b or ahead >= 20 and (size - ahead) < 0.8 * size


@pytest.mark.parametrize("block", [4, 16])
def test_large_buckets_meet_their_lowest_first(spark, block):
    rows = [row(i, f"{near(i, i % 7)}\n{prose(i, 1)}") for i in range(90)]
    assert got(spark, rows, block=block) == plain(rows)


def test_texts_are_moved_once_whatever_the_buckets(spark, monkeypatch):
    """Large buckets take a round of their own; it must not move the texts again."""
    moved, sets = [], paragraphs._sets
    monkeypatch.setattr(paragraphs, "_sets", lambda *a: moved.append(1) or sets(*a))
    rows = [row(i, f"{near(i, i % 7)}\n{prose(i, 1)}") for i in range(60)]
    assert got(spark, rows, block=4) == plain(rows)
    assert len(moved) == 1
