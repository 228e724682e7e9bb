import numpy as np
import pytest
from llm_data import awkward, frame, prose, row

from plumbline.llm import pseudo_likelihood as lm


def network(side=4, seed=0):
    rng = np.random.default_rng(seed)
    net = lm.new_network(rng.integers(1, 50, side * side).astype(float), width=5)
    return {k: rng.normal(0, 0.5, v.shape).astype(np.float32) for k, v in net.items()}


def test_probabilities_of_all_tokens_sum_to_one():
    net, ids = network(), np.array([3, 9, 1, 14, 2])
    for place in range(len(ids)):
        total = 0
        for token in range(16):
            other = ids.copy()
            other[place] = token
            total += np.exp(lm.log_probabilities(net, other)[place])
        assert total == pytest.approx(1, abs=1e-5)


def test_both_sides_matter_and_the_token_itself_does_not_predict_itself():
    around = lm.contexts(np.array([5, 6, 7]))
    assert around.tolist() == [[1, 1, 6, 7], [1, 5, 7, 1], [5, 6, 1, 1]]


def test_targets_get_their_own_neighbours_only():
    ids = np.random.default_rng(3).integers(2, 16, 41)
    for spots in (np.arange(1, 41, 2), np.array([0, 40]), np.arange(0)):
        assert (lm.contexts(ids, spots) == lm.contexts(ids)[spots]).all()


def test_scores_lie_in_columns():
    net, ids = network(), np.array([3, 9, 1, 14])
    _, h = lm._hidden(net, lm.contexts(ids))
    _, z = lm._scores(net, h, ids // 4)
    assert z[:4] == pytest.approx((h @ net["A"] + net["a"]).T, rel=1e-5) and z[4:] == pytest.approx((h @ net["U"] + net["B"][ids // 4]).T, rel=1e-5)
    assert lm._log_share(z[:4].copy(), ids // 4) == pytest.approx(lm._log_softmax(z[:4].T)[np.arange(4), ids // 4], rel=1e-4, abs=1e-5)


def test_plain_loop_gives_the_same_score():
    net, ids = network(), np.array([3, 9, 1, 14, 2, 2])
    wide = [1, 1, *ids.tolist(), 1, 1]
    total = 0.0
    for i, t in enumerate(ids):
        h = np.tanh(net["c"] + sum(net["s"][k] * net["E"][wide[i + 2 + j]] for k, j in enumerate(lm.OFFSETS)))
        a, b = h @ net["A"] + net["a"], h @ net["U"] + net["B"][t // 4]
        total += a[t // 4] - np.log(np.exp(a).sum()) + b[t % 4] - np.log(np.exp(b).sum())
    assert lm.log_probabilities(net, ids).sum() == pytest.approx(total, rel=1e-4)


def test_gradients_follow_the_loss():
    net = {k: v.astype(np.float64) for k, v in network().items()}
    around, target = np.array([[1, 2, 3, 4], [5, 2, 2, 1]]), np.array([7, 9])

    def loss(n):
        _, h = lm._hidden(n, around)
        rows = np.arange(2)
        return -(lm._log_softmax(h @ n["A"] + n["a"])[rows, target // 4]
                 + lm._log_softmax(h @ n["U"] + n["B"][target // 4])[rows, target % 4]).mean()

    moved = {k: v.copy() for k, v in net.items()}
    moments = {k: np.zeros(v.shape) for k, v in net.items()}
    lm.step(moved, moments, around, target, 0.0)
    for k, v in net.items():  # squared gradients are what one step gathers
        for at in [tuple(i // 2 for i in v.shape), (0,) * v.ndim, tuple(min(2, i - 1) for i in v.shape)]:
            high, low = ({n: x.copy() for n, x in net.items()} for _ in range(2))
            high[k][at] += 1e-5
            low[k][at] -= 1e-5
            assert moments[k][at] == pytest.approx(((loss(high) - loss(low)) / 2e-5) ** 2, rel=1e-2, abs=1e-7)


def test_training_tells_prose_from_noise(spark):
    cycle = [f"w{i}" for i in range(30)]
    rows = [row(i, " ".join(cycle[(i + j) % 30] for j in range(200))) for i in range(120)]
    rng = np.random.default_rng(4)
    rows += [row(1000 + i, " ".join(rng.choice(cycle, 200))) for i in range(4)]
    got = {r["id"]: r["mean_log_prob"] for r in lm.log_likelihood(frame(spark, rows), size=64, masked=2, rounds=3).collect()}
    known, noise = np.mean([got[i] for i in range(120)]), np.mean([got[1000 + i] for i in range(4)])
    assert known > -2.6 and known > noise + 0.7  # a unigram model gives -3.4 to both


def test_awkward_rows(spark):
    rows = awkward()
    got = lm.log_likelihood(frame(spark, rows), size=256).collect()
    assert sorted(str(r["id"]) for r in got) == sorted(str(r[0]) for r in rows)
    assert sorted(r["n_tokens"] for r in got) == sorted(len((r[1] or "").encode().split()) for r in rows)
    for r in got:
        assert (r["log_prob"] < 0) == (r["n_tokens"] > 0) and (r["mean_log_prob"] is None) == (r["n_tokens"] == 0)
    twice = [(r["n_tokens"], r["log_prob"]) for r in got if r["id"] == 3]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_counts_cover_all_words(spark):
    texts = [prose(i) for i in range(20)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    total = lm.word_counts(df).agg({"n": "sum"}).first()[0]
    assert total == sum(len((t or "").split()) for t in texts)


@pytest.mark.parametrize("rows", [[], [row(1, None), row(2, "")]])
def test_nothing_to_learn_from(spark, rows):
    got = lm.log_likelihood(frame(spark, rows), size=16).collect()
    assert len(got) == len(rows) and all(r["n_tokens"] == 0 for r in got)


def test_words_outside_the_network_are_told_apart(spark):
    common = [row(i, "ka lo mi ser " * 20) for i in range(20)]
    rare = [row(100, "ka lo often mi ser"), row(101, "ka lo once mi ser"), row(102, "often " * 9), row(103, "often once2")]
    df = frame(spark, common + rare)
    got = {r["id"]: r["log_prob"] for r in lm.log_likelihood(df, size=4, rounds=2, masked=2).collect()}
    assert got[100] - got[101] == pytest.approx(np.log(11), abs=1e-6)  # 11 against 1 in the corpus, both OTHER


def test_shares_of_all_words_outside_the_network_sum_to_one(spark):
    words = [w for i, w in enumerate("abcdefgh") for _ in range(i + 1)]
    df = spark.createDataFrame([(w,) for w in words], "t string").repartition(3)
    hashes, ids, counts, known = lm.vocabulary(df, 4)
    made = [lm.token_ids(w, (hashes, ids)) for w in sorted(set(words))]
    rows = [(i, bytearray(o.tobytes())) for i, (_, o) in enumerate(made)]
    found = lm.other_log_shares(spark.createDataFrame(rows, "row long, others binary"), known, counts[lm.OTHER]).collect()
    assert len(found) == 6 and sum(np.exp(r["share"] / lm._FRACTION) for r in found) == pytest.approx(1)


@pytest.mark.parametrize("length", [1, 2, 5, 1000])
def test_default_rounds_train_on_every_position(length):
    spots = [lm._masked(np.zeros(length), turn, lm.MASKED) for turn in range(lm.ROUNDS)]
    assert sorted(np.concatenate(spots).tolist()) == sorted(list(range(length)) * (lm.ROUNDS // lm.MASKED))


def test_rounds_that_leave_positions_out_are_refused(spark):
    with pytest.raises(ValueError):
        lm.log_likelihood(frame(spark, awkward()), size=16, rounds=2, masked=3)


def test_log_prob_equals_a_plain_loop(spark, monkeypatch):
    """Whole scores, rare words and their shares included, word by word from the counts; the network is held fixed."""
    rng = np.random.default_rng(8)
    held = {}

    def fixed(encoded, net, rounds, masked):
        held.update({k: (v if k in "aB" else rng.normal(0, 0.4, v.shape)).astype(np.float32) for k, v in net.items()})
        return held

    monkeypatch.setattr(lm, "train", fixed)
    rows = awkward() + [row(200 + i, prose(i, 1, 3 + 40 * (i % 3))) for i in range(30)]
    got = {(r["id"], r["n_tokens"]): r["log_prob"] for r in lm.log_likelihood(frame(spark, rows), size=16).collect()}
    words = {r[0]: (r[1] or "").lower().split() for r in rows}
    counts = {}
    for r in rows:
        for w in (r[1] or "").lower().split():
            counts[w] = counts.get(w, 0) + 1
    mark = {w: int(lm.word_hashes(lm.encode(w), lm.WHITE)[0][0]) for w in counts}
    ranked = sorted(counts, key=lambda w: (-counts[w], np.uint64(mark[w]).view(np.int64)))[:14]
    token = {w: i + 2 for i, w in enumerate(ranked)}
    rest = sum(n for w, n in counts.items() if w not in token)
    for (name, n), score in got.items():
        text = next((r[1] or "").lower().split() for r in rows if r[0] == name and len((r[1] or "").split()) == n)
        ids = [token.get(w, lm.OTHER) for w in text]
        wide, total = [lm.EDGE, lm.EDGE, *ids, lm.EDGE, lm.EDGE], 0.0
        for i, (w, t) in enumerate(zip(text, ids)):
            h = np.tanh(held["c"] + sum(held["s"][k] * held["E"][wide[i + 2 + j]] for k, j in enumerate(lm.OFFSETS)))
            a, b = h @ held["A"] + held["a"], h @ held["U"] + held["B"][t // 4]
            total += a[t // 4] - np.log(np.exp(a).sum()) + b[t % 4] - np.log(np.exp(b).sum())
            total += np.log(counts[w] / rest) if t == lm.OTHER else 0.0
        assert score == pytest.approx(total, rel=2e-4, abs=1e-4)
    assert words and len(got) > 40


def test_short_texts_share_a_call():
    net, rng = network(), np.random.default_rng(2)
    texts = [rng.integers(0, 16, n) for n in (0, 1, 7, 0, 300, 9000, 2, 0)]
    want = [float(lm.log_probabilities(net, t).sum()) for t in texts]
    assert lm.text_scores(net, texts) == pytest.approx(want, rel=1e-5)
    assert lm.text_scores(net, []) == []
