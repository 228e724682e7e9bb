"""Masked pseudo-likelihood scores of a bidirectional window network, trained in numpy.

Every token is predicted from the tokens on both sides:

    h = tanh(c + sum_j s_j * E[token at offset j]),   offsets -2, -1, 1, 2
    P(token | both sides) = P(class | h) P(member | h, class)

The network's tokens are the most frequent words of the corpus; a token is (class, member) by rank, so the two softmaxes
cost twice the square root of their number.  Every other counted word is told apart inside the token OTHER:

    P(word | both sides) = P(OTHER | both sides) count(word) / count(OTHER)

so the probabilities of all counted words sum to one, however many there are.  Those counts never reach the driver: they
lie on the cluster in shards by hash, and the words of the texts are looked up there.  A document's score is the sum of
its words' conditional log-probabilities.

Training covers all documents: counts over every word give the vocabulary and the first biases, and every position of
every document is masked and predicted once in `masked` rounds (a round takes every `masked`-th position).  Each partition trains from the same network;
their parameters are averaged with the numbers of targets as weights, in two steps so that no task sees
all of them, and the next round starts from the average.
"""

import pickle
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plumbline.llm.common import settle, slices
from plumbline.llm.words import WHITE, encode, mix, word_hashes

SIDE = 64
VOCABULARY = SIDE * SIDE
OFFSETS = (-2, -1, 1, 2)
WIDTH = 24
#: One position in so many is masked in a round; as many rounds mask every position once.
MASKED = 2
ROUNDS = 2
OTHER, EDGE = 0, 1
#: Where the neighbours stand behind two edges.
_PLACES = np.array(OFFSETS) + 2
#: Distinct words a task counts before it hands them on.
GATHERED = 1 << 20
#: Words outside the network's tokens that a shard looks up, about.
SHARD = 1 << 20
#: Log-counts are added as whole numbers of this fraction, so a sum does not depend on its order.
_FRACTION = 1 << 30
_CHUNK = 1 << 13


def word_counts(texts):
    """(h, n): how often each word occurs in all texts; summed in the task first."""

    def run(batches):
        held, size = [], 0
        for part in slices(batches):
            hashes = [word_hashes(encode(t), WHITE)[0] for t in part.column(0).to_pylist()]
            found, counts = np.unique(np.concatenate(hashes), return_counts=True) if hashes else ([], [])
            held.append((found, counts))
            size += len(found)
            if size > GATHERED:
                yield merged(held)
                held, size = [], 0
        if held:
            yield merged(held)

    def merged(held):
        found, inverse = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([c for _, c in held]), minlength=len(found)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found.astype(np.uint64).view(np.int64)), pa.array(counts)], ["h", "n"])

    return texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def vocabulary(texts, size=VOCABULARY):
    """(sorted word hashes, their token ids, count of each token, (h, n) of all words); ids follow the frequency, ties the hash."""
    counts = word_counts(texts)
    if size <= 2:
        raise ValueError("a vocabulary needs words")
    counts = settle(counts, "counts")
    top = counts.orderBy(F.desc("n"), "h").limit(size - 2).toArrow()  # as many rows as the network has tokens
    total = counts.agg(F.sum("n")).first()[0] or 0
    hashes = top.column("h").to_numpy().view(np.uint64)
    n = np.zeros(size)
    n[2:2 + len(hashes)] = top.column("n").to_numpy()
    n[OTHER] = max(0, total - n.sum())
    order = np.argsort(hashes)
    return hashes[order], (order + 2).astype(np.int64), n, counts


def token_ids(text, known):
    """(token ids of all words of a text, hashes of those that are OTHER)."""
    hashes, ids = known
    found = word_hashes(encode(text), WHITE)[0]
    if not len(found) or not len(hashes):
        return np.full(len(found), OTHER, np.int64), found
    at = np.searchsorted(hashes, found)
    at[at == len(hashes)] = 0
    same = hashes[at] == found
    return np.where(same, ids[at], OTHER), found[~same]


def other_log_shares(encoded, counts, total):
    """(row, share): the sum of log(count / total) over the words of a row that are OTHER, in units of 1 / _FRACTION.

    A task sends its words to the shards of their hashes, packed; a shard holds the counts of its words only and answers
    each parcel in one row, and a parcel's answers are added up in one place.
    """
    shards = 1 << int(np.ceil(np.log2(max(16, total / SHARD))))

    def ask(batches):
        held, size = [], 0
        for part in slices(batches):
            for row, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                held.append((row, np.frombuffer(raw, np.uint64)))
                size += len(held[-1][1])
            if size > GATHERED:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    def packed(held):
        rows = np.repeat(np.array([r for r, _ in held], np.int64), [len(h) for _, h in held])
        words = np.concatenate([h for _, h in held])
        shard = (words & np.uint64(shards - 1)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        used, starts = np.unique(shard[order], return_index=True)
        cuts = [order[a:b] for a, b in zip(starts, np.append(starts[1:], len(order)))]
        parcel = [held[0][0]] * len(cuts)  # a row is in one parcel only
        return pa.RecordBatch.from_arrays([pa.array(used), pa.array(parcel, pa.int64()),
                                           pa.array([rows[c].tobytes() for c in cuts], pa.binary()),
                                           pa.array([words[c].tobytes() for c in cuts], pa.binary())],
                                          ["shard", "parcel", "rows", "words"])

    def answer(asked, known):
        h = known.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        h, n = np.append(h[order], np.uint64(0)), np.append(known.column("n").to_numpy()[order], 1)
        out = []
        for rows, words in zip(asked.column("rows").to_pylist(), asked.column("words").to_pylist()):
            rows, words = np.frombuffer(rows, np.int64), np.frombuffer(words, np.uint64)
            at = np.searchsorted(h[:-1], words)
            share = np.rint(np.log(np.where(h[at] == words, n[at], 1) / total) * _FRACTION).astype(np.int64)
            heads = np.flatnonzero(np.diff(rows, prepend=rows[0] - 1))  # a row's words stand together
            out.append((rows[heads].tobytes(), np.add.reduceat(share, heads).tobytes()))
        return pa.table({"parcel": asked.column("parcel"), "rows": pa.array([r for r, _ in out], pa.binary()),
                         "shares": pa.array([x for _, x in out], pa.binary())})

    def add(table):
        rows, shares = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("rows", "shares"))
        rows, at = np.unique(rows, return_inverse=True)
        total = np.zeros(len(rows), np.int64)
        np.add.at(total, at, shares)
        return pa.table({"row": rows, "share": total})

    asked = encoded.select("row", "others").where(F.octet_length("others") > 0).mapInArrow(
        ask, "shard long, parcel long, rows binary, words binary")
    # a word that is not sent was counted once
    known = counts.where("n > 1").select(F.col("h").bitwiseAND(F.lit(shards - 1)).alias("shard"), "h", "n")
    found = asked.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(
        answer, "parcel long, rows binary, shares binary")
    return found.groupBy("parcel").applyInArrow(add, "row long, share long")


def new_network(counts, width=WIDTH, seed=11):
    """Parameters: embeddings, offset scales, hidden bias, class and member layers with corpus log-counts as biases."""
    rng = np.random.default_rng(seed)
    side = int(round(len(counts) ** 0.5))
    table = np.log(counts.reshape(side, side) + 0.5)
    classes = np.log(np.exp(table).sum(axis=1))
    return {"E": rng.normal(0, 0.3, (side * side, width)).astype(np.float32),
            "s": np.ones((len(OFFSETS), width), np.float32) / 2, "c": np.zeros(width, np.float32),
            "A": np.zeros((width, side), np.float32), "a": (classes - classes.max()).astype(np.float32),
            "U": np.zeros((width, side), np.float32), "B": (table - table.max(axis=1, keepdims=True)).astype(np.float32)}


def contexts(ids, spots=None):
    """Neighbours of every position, or of those in `spots`, by offset; beyond the text stands EDGE."""
    wide = np.concatenate(([EDGE, EDGE], ids, [EDGE, EDGE]))
    spots = np.arange(len(ids)) if spots is None else spots
    return wide.take(spots[:, None] + _PLACES)


def _hidden(net, around):
    x = net["E"].take(around, axis=0)
    return x, np.tanh(net["c"] + np.einsum("njw,jw->nw", x, net["s"]))


def _log_softmax(z):
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _log_share(z, chosen):
    """Logarithm of the chosen row's share in every column; a column per position, so that sums run along the memory."""
    z -= z.max(axis=0)
    own = z[chosen, np.arange(z.shape[1])]
    np.exp(z, out=z)
    return own - np.log(z.sum(axis=0))


def _scores(net, h, group):
    """Layers of classes and members as one; their values, classes above the members of the given ones, a column per position."""
    both = np.concatenate((net["A"], net["U"]), axis=1)
    z, side = both.T @ h.T, net["A"].shape[1]
    z[:side] += net["a"][:, None]
    z[side:] += np.ascontiguousarray(net["B"].T).take(group, axis=1)
    return both, z


def log_probabilities(net, ids):
    """Conditional log-probability of every token of a document, given the tokens on both sides."""
    return _log_probabilities(net, ids, contexts(ids))


def _log_probabilities(net, ids, around):
    side, out = net["A"].shape[1], np.empty(len(ids))
    for at in range(0, len(ids), _CHUNK):
        target = ids[at:at + _CHUNK]
        group, member = target // side, target % side
        _, h = _hidden(net, around[at:at + _CHUNK])
        _, z = _scores(net, h, group)
        out[at:at + _CHUNK] = _log_share(z[:side], group) + _log_share(z[side:], member)
    return out


def text_scores(net, texts):
    """Summed log-probabilities of many texts' tokens; short texts share the network's calls."""
    out, waiting, size = np.zeros(len(texts)), [], 0

    def close():
        sums = _log_probabilities(net, np.concatenate([texts[i] for i in waiting]), np.concatenate([contexts(texts[i]) for i in waiting]))
        starts = np.cumsum([0, *[len(texts[i]) for i in waiting[:-1]]])
        out[waiting] = np.add.reduceat(sums, starts)

    for i, text in enumerate(texts):
        if len(text):
            waiting.append(i)
            size += len(text)
        if size >= _CHUNK:
            close()
            waiting, size = [], 0
    if waiting:
        close()
    return out.tolist()


def _softmax(z):
    """In place: shares of every column."""
    z -= z.max(axis=0)
    np.exp(z, out=z)
    z /= z.sum(axis=0)
    return z


def step(net, moments, around, target, rate):
    """One AdaGrad step on a batch of masked positions."""
    side, n = net["A"].shape[1], len(target)
    group, member, rows = target // side, target % side, np.arange(n)
    x, h = _hidden(net, around)
    both, z = _scores(net, h, group)
    p, q = _softmax(z[:side]), _softmax(z[side:])
    p[group, rows] -= 1
    q[member, rows] -= 1
    back = np.ascontiguousarray((both @ z).T)
    back *= (1 - h * h) / n
    pulls = z @ h / n
    classes = np.zeros((side, n), q.dtype)
    classes[group, rows] = 1
    grads = {"A": pulls[:side].T, "a": p.sum(axis=1) / n, "U": pulls[side:].T, "B": classes @ q.T / n, "c": back.sum(axis=0),
             "s": np.einsum("njw,nw->jw", x, back)}
    flat = around.reshape(-1).astype(np.uint16 if len(net["E"]) <= 1 << 16 else np.int64)  # short numbers sort by radix
    order = np.argsort(flat, kind="stable")
    ranked = flat[order]
    heads = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    used = ranked[heads]
    pull = (back[:, None] * net["s"]).reshape(len(order), -1)
    pulled = np.add.reduceat(pull.take(order, axis=0), heads, axis=0)
    moments["E"][used] += pulled ** 2
    net["E"][used] -= rate * pulled / (np.sqrt(moments["E"][used]) + 1e-6)
    for k, g in grads.items():
        moments[k] += g * g
        net[k] -= (rate * g / (np.sqrt(moments[k]) + 1e-6)).astype(np.float32)


@lru_cache(1 << 14)
def _start(n, masked):
    return int(mix(np.array([n], np.uint64))[0] % np.uint64(masked))


def _masked(ids, turn, masked):
    """Positions of a text that are targets in a round: every `masked`-th, from a start that the text's length deals.

    Any `masked` rounds that follow one another have every position once.
    """
    return np.arange((_start(len(ids), masked) + turn) % masked, len(ids), masked)


def _average(parts, shapes):
    """Weighted means of the partitions' parameters by blocks: first over groups of partitions, then over all."""

    def mean(table):
        w = table.column("w").to_numpy()
        x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float32).reshape(len(w), -1)
        total = w.sum()
        out = (x * (w / max(total, 1))[:, None]).sum(axis=0).astype(np.float32)
        return pa.table({"block": table.column("block")[:1], "w": pa.array([total]), "x": pa.array([out.tobytes()])})

    few = parts.groupBy("block", "deal").applyInArrow(mean, "block int, w double, x binary")
    rows = few.groupBy("block").applyInArrow(mean, "block int, w double, x binary").orderBy("block").collect()
    flat = np.frombuffer(b"".join(r["x"] for r in rows), np.float32)  # one network
    net, at = {}, 0
    for k, shape in shapes:
        size = int(np.prod(shape))
        net[k] = flat[at:at + size].reshape(shape).copy()
        at += size
    return net


def train(encoded, net, rounds=ROUNDS, masked=MASKED, batch=2048, rate=0.05, block=1 << 14):
    """Rounds of local training and averaging over (tokens binary) rows; returns the network."""
    if rounds < masked:
        raise ValueError("fewer rounds than `masked` leave positions out of training")
    shapes = [(k, v.shape) for k, v in net.items()]

    def run_with(start, turn):
        def run(batches):
            from pyspark import TaskContext

            mine = {k: v.copy() for k, v in start.items()}
            moments = {k: np.full(v.shape, 1e-3, np.float32) for k, v in mine.items()}
            held, seen = [], 0

            def learn():
                around, target = (np.concatenate(x) for x in zip(*held))
                few = -(-len(target) // batch)  # even batches: no step rests on a few left over
                for x, t in zip(np.array_split(around, few), np.array_split(target, few)):
                    step(mine, moments, x, t, rate)

            waiting = 0
            for part in slices(batches):
                for raw in part.column(0).to_pylist():
                    ids = np.frombuffer(raw, np.uint16).astype(np.int64)
                    spots = _masked(ids, turn, masked)
                    if len(spots):
                        held.append((contexts(ids, spots), ids[spots]))
                        waiting += len(spots)
                        seen += len(spots)
                if waiting >= 16 * batch:
                    learn()
                    held, waiting = [], 0
            if held:
                learn()
            if seen:
                flat = np.concatenate([mine[k].ravel() for k, _ in shapes])
                blocks = [flat[i:i + block].tobytes() for i in range(0, len(flat), block)]
                deal = TaskContext.get().partitionId() % 64
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array(range(len(blocks)), pa.int32()), "deal": pa.array([deal] * len(blocks), pa.int32()),
                    "w": pa.array([float(seen)] * len(blocks)), "x": blocks})

        return run

    for turn in range(rounds):
        parts = encoded.select("tokens").mapInArrow(run_with(net, turn), "block int, deal int, w double, x binary")
        averaged = _average(parts, shapes) if not encoded.isEmpty() else net
        net = averaged if averaged and averaged["E"].size else net
    return net


def log_likelihood(docs, id_column="doc_id", text_column="text", size=VOCABULARY, rounds=ROUNDS, masked=MASKED):
    """One row per row of docs: (id, n_tokens, log_prob, mean_log_prob).

    A null or empty text has no tokens, log_prob 0 and a null mean.  Repeated rows score alike, each in a row of its
    own.  Without any text the untrained network is used (and no row needs it).  Other columns are not read.  The network depends on
    how the rows lie in partitions, as every averaged training does; for one layout it is deterministic.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    hashes, ids, counts, words = vocabulary(rows.select("text"), size)

    def tokens(batches):
        for part in slices(batches):
            made = [token_ids(t, (hashes, ids)) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:2], pa.array([t.astype(np.uint16).tobytes() for t, _ in made], pa.binary()),
                 pa.array([o.tobytes() for _, o in made], pa.binary())], ["id", "row", "tokens", "others"])

    # the row numbers are written once, so they stay what they are
    numbered = rows.select("id", F.monotonically_increasing_id().alias("row"), "text")
    encoded = settle(numbered.mapInArrow(tokens, "id long, row long, tokens binary, others binary"), "encoded")
    packed = pickle.dumps(train(encoded.where(F.octet_length("tokens") > 0), new_network(counts), rounds, masked))

    def score(batches):
        net = pickle.loads(packed)
        for part in slices(batches):
            made = [np.frombuffer(t, np.uint16).astype(np.int64) for t in part.column(2).to_pylist()]
            sums = text_scores(net, made)
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([len(t) for t in made], pa.int64()),
                                              pa.array(sums, pa.float64())], ["id", "row", "n_tokens", "network"])

    scored = encoded.select("id", "row", "tokens").mapInArrow(score, "id long, row long, n_tokens long, network double")
    if counts[OTHER] > 0:
        scored = scored.join(other_log_shares(encoded, words, float(counts[OTHER])), "row", "left")
    else:
        scored = scored.withColumn("share", F.lit(0))
    log_prob = F.col("network") + F.coalesce("share", F.lit(0)) / F.lit(float(_FRACTION))
    scored = scored.select("id", "n_tokens", log_prob.alias("log_prob"))
    return scored.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))
