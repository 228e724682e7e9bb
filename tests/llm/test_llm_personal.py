import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from llm_data import awkward, frame, prose, row

from plumbline.llm import personal

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(digits[::-1])]
    return sum(sum(map(int, str(x))) for x in doubled) % 10 == 0


def plain_spans(text):
    def holds(kind, found):
        digits = re.sub("[^0-9]", "", found)
        return (kind == 0 or kind == 1 and all(int(p) <= 255 for p in found.split("."))
                or kind == 2 and 12 <= len(digits) <= 19 and plain_luhn(digits) or kind == 3 and 9 <= len(digits) <= 15)

    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if holds(k, m.group()))


PIECES = ["a@b.c", "x.y%z+1@mail-2.example.com", "@", ".", "é", "1.2.3.4", "300.1.1.1", "0007.08.9.255", "4111111111111111", "4111 1111-1111 1111",
          "+1 (423) 555-7379", "+", "-", " ", "(", ")", "12", "\n", "word", "_", "++49 30 1234567", "a@b@c.d.e", "4111-1111--1111 1111"]


def test_patterns_equal_plain_searches():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 12)))
        assert personal.base_spans(text) == plain_spans(text), text


def test_long_runs_take_linear_time():
    for run in ("a", "1", "1.", "1 ", "a@", "+1", "(", "1.1.1@"):
        personal.base_spans(run * 300_000)


@pytest.fixture(scope="module")
def field():
    return personal.train(personal.examples([]))


def test_gradients():
    labelled = personal.examples([])[::29]
    pieces = personal.Pieces([t for t, _ in labelled])
    features, field = pieces.features(), personal.Field()
    rng = np.random.default_rng(0)
    for part in field.parts:
        part += rng.normal(0, 0.3, part.shape)
    gold = {i: personal._gold(pieces, i, spans) for i, (_, spans) in enumerate(labelled)}
    rows = np.array([i for i, g in gold.items() if g is not None])
    _, grads = field.gradient(pieces, features, gold, rows)
    for j, place in ((0, (0, features[3, 5])), (0, (3, features[9, 1])), (1, (1,)), (2, (0, 1)), (2, (1, 0)), (2, (0, 0))):
        sides = []
        for step in (1e-5, -2e-5):
            field.parts[j][place] += step
            sides.append(field.gradient(pieces, features, gold, rows)[0])
        field.parts[j][place] += 1e-5
        assert grads[j][place] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=1e-4, abs=1e-5)


def test_best_segmentation_is_the_best_of_all(field):
    """Every segmentation of short islands, scored one by one."""
    texts = ["212-555-0199", "a(at)b.org", "1.2.3.4 x", "+1 23 45", "12 @ ab.c", "4111.1111.1111"]
    pieces = personal.Pieces(texts)
    features = pieces.features()
    rng = np.random.default_rng(3)
    noisy = personal.Field()
    for part, trained in zip(noisy.parts, field.parts):
        part += trained * 0.2 + rng.normal(0, 1, part.shape)
    segment, outside, follow = noisy.parts
    for i, text in enumerate(texts):
        a, b = pieces.first[i], pieces.first[i + 1]
        held = {(int(x - a), int(y - a)): segment[:, f].sum(axis=1) for x, y, f in zip(pieces.a, pieces.e, features) if a <= x < b}

        def ways(t, last):
            if t == b - a:
                yield 0.0, []
                return
            for score, rest in ways(t + 1, 0):
                yield score + follow[last, 0] + outside[pieces.cls[a + t]], rest
            for (x, y), scores in held.items():
                if x == t:
                    for kind in range(4):
                        for score, rest in ways(y, kind + 1):
                            yield score + follow[last, kind + 1] + scores[kind], [(x, y - x, kind), *rest]

        want = max(ways(0, 0), key=lambda w: w[0])[1]
        scores, tokens, _, lengths, _, _ = noisy.grids(pieces, features, np.array([i]))
        assert noisy.best(scores, tokens, lengths)[0] == want


def test_forms_that_the_patterns_miss(field):
    """Held out: fresh numbers and names, forms with contexts of their own; and numbers that are no one's stay."""
    rng = random.Random(99)
    right = total = wrong = clean = 0
    for _ in range(60):
        n = lambda k: "".join(rng.choice("123456789") for _ in range(k))
        name = "".join(rng.choice("mnoprst") + rng.choice("aeiou") for _ in range(3))
        for kind, text in ((3, f"({n(3)}) {n(3)}-{n(4)}"), (3, f"{n(3)}-{n(3)}-{n(4)}"), (0, f"{name}.{n(2)} (at) {name}.example.com"),
                           (0, f"{name} [at] site{n(1)} [dot] org"), (1, f"{n(2)}[dot]{n(2)}[dot]{n(2)}[dot]1{n(1)}")):
            for island in (text, text + ",", "(" + text + ")"):
                total += 1
                found = personal.added_spans(field, [island], [[]])[0]
                right += found == [(island.index(text), kind, island.index(text) + len(text))]
        for text in (f"19{n(2)}-1{rng.randint(0, 2)}-{n(2)}", next(x for x in iter(lambda: n(16), "") if not personal.luhn(x)), n(7), f"{n(2)}:{n(2)}:{n(2)}", f"{n(3)}.{n(3)}.3{n(2)}0.{n(3)}"):
            if not personal.base_spans(text):
                clean += 1
                wrong += personal.added_spans(field, [text], [[]])[0] != []
    assert right / total > 0.95 and wrong / clean < 0.05, (right, total, wrong, clean)


def test_documents(spark):
    inserted = ["mail kat@example.com or kat (at) example.com.", "+1 (843) 555-7672 170.106.47.218", "4111 1111 1111 1111", "no 9777946427004852",
                "call (212) 555-0199 now", "@" * 50, "1 2 3 4 5 6 7 8 " * 40, "+1 23456789 a@b.c"]
    rows = awkward() + [row(100 + i, prose(i) + " " + text + "\n" + prose(i + 1)) for i, text in enumerate(inserted)]
    found = personal.digests(personal.find(frame(spark, rows))).collect()
    assert len(found) == len(rows)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(r[1] or "")
    for got in found:
        bases = [plain_spans(t) for t in texts[got["id"]]]
        joined = [",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in s) for s in bases]
        shas = [hashlib.sha256(j.encode()).hexdigest() for j in joined]
        assert got["base_sha256"] in shas
        base = bases[shas.index(got["base_sha256"])]
        assert [got[f"n_{k}"] for k in personal.KINDS] == [sum(x[1] == i for x in base) for i in range(4)]
        spans = [(int(a), personal.KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in got["spans"].split(",") if s)]
        assert set(base) <= set(spans) and spans == sorted(spans)
        for (a, _, b), (c, _, d) in itertools.product(set(spans) - set(base), base):
            assert b <= c or d <= a
    by_id = {r["id"]: r["spans"] for r in found}
    text = rows[-8][1]
    start = text.index("kat (at)")
    assert f"email:{start}:{start + 20}" not in by_id[100] or text[start:start + 20] == "kat (at) example.com"
    assert by_id[100].count("email") == 2 and by_id[101].count("phone") == 1 and by_id[104].count("phone") == 1
    assert by_id[103] == ""


def test_empty_table(spark):
    assert personal.digests(personal.find(frame(spark, awkward()).limit(0))).count() == 0
