import numpy as np
import pytest

from plumbline.llm import embeddings

SCHEMA = "vec_id long, embedding array<double>, label int, rep string, cell string"


def plain(rows, threshold=0.98):
    ok = np.array([bool(r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1])
                        and any(r[1])) for r in rows])
    unit = [embeddings.unit([r[1]])[0] if k else None for r, k in zip(rows, ok)]
    linked = np.eye(len(rows), dtype=bool)
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if ok[i] and ok[j] and a[2] == b[2] and len(a[1]) == len(b[1]) and unit[i] @ unit[j] >= threshold:
                linked[i, j] = linked[j, i] = True
    reach = linked
    while not (reach == (wider := (reach.astype(np.float32) @ reach.astype(np.float32)) > 0)).all():
        reach = wider
    least = [min((rows[j][0] for j in np.flatnonzero(r) if rows[j][0] is not None), default=None) for r in reach]
    return sorted(((r[0], int(linked[i].sum()) - 1, least[i], least[i] == r[0]) for i, r in enumerate(rows)), key=str)


def got(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, embeddings.near_vectors(df, **options).collect()), key=str)


def test_awkward_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.1], 1), (5, None, 1), (6, [0.0, 0.0], 1),
            (7, [None, 1.0], 1), (8, [float("nan"), 1.0], 1), (9, [float("inf"), 1.0], 1), (10, [1.0, 0.0], None),
            (11, [], 1), (12, [1.0, 0.0, 0.0], 1), (13, [1e300, 1e299], 1), (14, [1e-300, 0.0], 1), (15, [1.0, 0.0], 1),
            (16, [-1.0, 0.0], 1), (17, [0.0, 1.0], 1), (None, [1.0, 0.0], 1), (15, [1.0, 0.0], 1)]
    assert got(spark, rows) == plain(rows)


def cloud(seed, n=260, dim=12):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    near = base[rng.integers(0, n, n)] + rng.normal(size=(n, dim)) * 0.08
    return [(int(i), v.tolist(), int(i % 2)) for i, v in enumerate(np.concatenate([base, near, np.repeat(base[:1], 40, axis=0)]))]


@pytest.mark.parametrize("block", [7, 1024])
def test_exact_with_the_full_reach(spark, block):
    rows = cloud(block)
    assert got(spark, rows, cell=40, block=block, reach=0.2001) == plain(rows)


def test_recall_with_the_default_reach(spark):
    rows = cloud(3)
    found, true = (sum(r[1] for r in x) for x in (got(spark, rows, cell=40), plain(rows)))
    assert found >= 0.99 * true


def test_recall_against_brute_force_in_64_dimensions(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(2500, 64)).astype(np.float32)
    near = (base[:1500] + rng.normal(size=(1500, 64)) * 0.16).astype(np.float32)
    x = np.concatenate([base, near])
    u = embeddings.unit(x)
    true = int((u @ u.T >= 0.98).sum()) - len(x)
    assert true > 2000
    df = spark.createDataFrame([(i, v.tolist(), 1, "x", "y") for i, v in enumerate(x)], SCHEMA)
    assert embeddings.near_vectors(df, cell=100).agg({"n_links": "sum"}).first()[0] >= 0.99 * true


def test_default_reach_loses_no_link_straight_across_a_border(spark):
    rng = np.random.default_rng(5)
    angle = np.sort(rng.uniform(0, 2 * np.pi, 400))  # in a plane every difference points across a border
    rows = [(i, [float(np.cos(a)), float(np.sin(a))], 1) for i, a in enumerate(angle)]
    assert got(spark, rows, cell=10) == plain(rows)


def test_empty_table(spark):
    assert got(spark, []) == []
