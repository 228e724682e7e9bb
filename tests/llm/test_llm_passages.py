import random
from collections import defaultdict

import pytest
from llm_data import awkward, frame, prose, row, table_folder
from pyspark.sql import functions as F

from plumbline.llm import paragraphs, passages, queries


def plain(rows, hashes, words):
    """Passages straight from the definition."""
    texts, places = {}, defaultdict(list)
    for name, text in {r[:2] for r in rows if r[1] is not None}:
        found, at = [], 0
        for part in text.encode().lower().decode().replace("\t", " ").replace("\n", " ").split(" "):
            if part:
                found.append((part, at, at + len(part)))
            at += len(part) + 1
        key = (name is None, name or 0, hashes[text])
        texts[key] = found
        for i in range(len(found) - words + 1):
            places[tuple(w for w, _, _ in found[i:i + words])].append((*key, i))
    out = []
    for key, found in texts.items():
        runs = []
        for i in range(len(found) - words + 1):
            like = sorted(places[tuple(w for w, _, _ in found[i:i + words])])
            first, last = like[0], like[-1]
            if first[:3] == last[:3] and last[3] - first[3] < words:
                continue
            own = first[:3] == key and i - first[3] < words
            kept = (key, 0, False) if own else (first[:3], first[3] - i, True)
            if runs and runs[-1][1] == i - 1 and runs[-1][2] == kept:
                runs[-1][1] = i
            else:
                runs.append([i, i, kept])
        for i, j, (kept, shift, removed) in runs:
            out.append((None if key[0] else key[1], i, found[i][1], found[j + words - 1][2], j - i + words,
                        None if kept[0] else kept[1], i + shift, removed))
    return sorted(out, key=str)


def checked(spark, rows, words):
    docs = frame(spark, rows)
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    got = sorted(map(tuple, passages.repeated_passages(docs, words=words).collect()), key=str)
    assert got == plain(rows, hashes, words)
    return got


@pytest.mark.parametrize("words", [1, 4, 12, 50])
def test_awkward_rows(spark, words):
    assert checked(spark, awkward(), words)
    assert checked(spark, [], words) == []


@pytest.mark.parametrize("seed", range(3))
def test_few_different_words(spark, seed):
    """Short windows over two to four words: classes, overlaps and shifts of every kind."""
    rng = random.Random(seed)
    rows = [row(i // 2, " ".join(rng.choice("ABcé"[:2 + seed]) for _ in range(rng.randint(0, 60)))) for i in range(24)]
    assert checked(spark, rows, 8 - 2 * seed)


def planted(n, size, seed=7):
    """Texts of their own with one passage set in at any word, broken over lines anew."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = prose(100 + i, 8, 30).split()
        at = rng.randint(0, len(words))
        words[at:at] = prose(9, 1, size).rstrip(".").split()
        cuts = sorted(rng.sample(range(len(words)), 6))
        rows.append(row(i, "\n".join(" ".join(words[a:b]) for a, b in zip([0, *cuts], [*cuts, len(words)]))))
    return rows


def test_passages_set_in_at_any_word(spark):
    for size in (50, 51, 59):
        rows = planted(40, size)
        got = checked(spark, rows, 50)
        assert {r[0] for r in got} == set(range(40)) and sum(not r[7] for r in got if r[0] == 0) >= 1
    assert checked(spark, planted(40, 45), 50) == []


def test_query_finds_paragraphs_and_passages(spark, tmp_path):
    """Near copies of paragraphs as before, and passages that no line begins with."""
    rows = planted(20, 55) + [row(100 + i, prose(500, 1, 60) + "\n" + prose(600 + i)) for i in range(2)]
    folder = table_folder(spark, tmp_path, documents=frame(spark, rows))
    got = queries.QUERIES["op1_paragraph_minhash"](spark, folder)
    assert {r.doc_id for r in got.collect()} == {*range(20), 100, 101}
    old = paragraphs.repeated_paragraphs(frame(spark, rows)).withColumnsRenamed({"id": "doc_id", "kept_id": "kept_doc_id"})
    assert sorted(got.where("paragraph IS NOT NULL").select(old.columns).collect()) == sorted(old.collect())
