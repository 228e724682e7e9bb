"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    y(x) = w0 + w.x + 1/2 sum_f [ (V_f.x)^2 - V_f^2.x^2 ]

The pairwise part costs one pass over a text's features (sum-of-squares identity).  It is fitted in one task on at most
`sample` labelled rows, chosen by a hash of their id; every row is scored.
"""

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plumbline.llm.common import settle, slices
from plumbline.llm.words import WHITE, encode, word_hashes

#: Labelled rows that the fit takes at most.
SAMPLE = 8000
BUCKETS = 4096
RANK = 8
THRESHOLD = 0.3
STATISTICS = 15
_LETTERS = np.zeros(256, np.int8)
_LETTERS[0x61:0x7B] = 1
_LETTERS[0x41:0x5B] = 2
_LETTERS[0x30:0x3A] = 3
_LETTERS[[0x21, 0x22, 0x23, 0x24, 0x25, 0x26, 0x2A, 0x2B, 0x2F, 0x3C, 0x3D, 0x3E, 0x40, 0x5B, 0x5C, 0x5D, 0x5E, 0x5F,
          0x60, 0x7B, 0x7C, 0x7D, 0x7E]] = 4
_LETTERS[[0x2E, 0x2C, 0x27, 0x3B, 0x3A, 0x3F, 0x28, 0x29, 0x2D]] = 5
_LETTERS[0x80:] = 6


def features(text, n_chars=None):
    """(word buckets, their values, statistics) of a text; an empty text has no buckets and zero statistics."""
    data = encode(text)
    hashes, starts, ends, _ = word_hashes(data, WHITE)
    octets = np.frombuffer(data, np.uint8)
    n, size = len(hashes), max(1, len(data))
    kinds = np.bincount(_LETTERS[octets], minlength=7) / size
    lines = data.count(b"\n") + 1
    stats = np.zeros(STATISTICS, np.float32)
    if n:
        found, counts = np.unique(hashes, return_counts=True)
        letters = kinds[1] + kinds[2]
        stats[:] = [np.log1p(n), np.log1p(lines), np.log1p(n / lines), (ends - starts).mean() / 10, len(found) / n,
                    counts.max() / n, (hashes[1:] == hashes[:-1]).mean() if n > 1 else 0,
                    kinds[2] / letters if letters else 0, kinds[3], kinds[4], kinds[5], kinds[6],
                    np.log1p(counts.max()), np.log1p(float(n_chars or 0)), np.minimum(n, 20) / 20]
        buckets, inverse = np.unique((found >> np.uint64(40)) % np.uint64(BUCKETS), return_inverse=True)
        values = np.bincount(inverse, counts)
        return buckets.astype(np.int16), (values / np.sqrt((values ** 2).sum())).astype(np.float32), stats
    return np.empty(0, np.int16), np.empty(0, np.float32), stats


def dense(rows):
    """A matrix of the rows' buckets and statistics."""
    x = np.zeros((len(rows), BUCKETS + STATISTICS), np.float32)
    for i, (buckets, values, stats) in enumerate(rows):
        x[i, buckets] = values
        x[i, BUCKETS:] = stats
    return x


def margin(x, model):
    """The machine's value for each row of x."""
    w0, w, v = model
    return w0 + x @ w + 0.5 * ((x @ v) ** 2 - (x * x) @ (v * v)).sum(axis=1)


def fit(rows, labels, epochs=12, batch=128, rate=0.02, decay=1e-4, seed=7):
    """Logistic loss by Adam over shuffled mini-batches.  Without both labels the machine is even: score 0.5."""
    y = np.asarray(labels, np.float32)
    stats = np.array([r[2] for r in rows], np.float32).reshape(-1, STATISTICS)
    middle, scale = (stats.mean(axis=0), stats.std(axis=0) + 1e-3) if len(rows) else (0, 1)
    size = BUCKETS + STATISTICS
    rng = np.random.default_rng(seed)
    model = [np.zeros(1, np.float32), np.zeros(size, np.float32), rng.normal(0, 0.01, (size, RANK)).astype(np.float32)]
    if len(set(y.tolist())) < 2:
        return {"model": [m * 0 for m in model], "middle": middle, "scale": scale}
    rows = [(b, x, (s - middle) / scale) for b, x, s in rows]
    first, second, step = [np.zeros_like(m) for m in model], [np.zeros_like(m) for m in model], 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            picked = order[at:at + batch]
            x = dense([rows[i] for i in picked])
            inner = x @ model[2]
            g = (1 / (1 + np.exp(-np.clip(margin(x, model), -40, 40))) - y[picked]) / len(picked)
            grads = [g.sum(keepdims=True), x.T @ g + decay * model[1],
                     x.T @ (g[:, None] * inner) - model[2] * ((x * x).T @ g)[:, None] + decay * model[2]]
            step += 1
            for m, a, b, d in zip(model, first, second, grads):
                a += 0.1 * (d - a)
                b += 0.001 * (d * d - b)
                m -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
    return {"model": model, "middle": middle, "scale": scale}


def scores(rows, fitted):
    """Scores between 0 and 1."""
    ready = [(b, x, (s - fitted["middle"]) / fitted["scale"]) for b, x, s in rows]
    return 1 / (1 + np.exp(-np.clip(margin(dense(ready), fitted["model"]).astype(float), -40, 40)))


def held_out(column):
    return F.crc32(column.cast("string").cast("binary")) % 5 == 0


def train(docs, labels, id_column="doc_id", text_column="text", label_column="quality", size_column=None, sample=SAMPLE):
    """Fit on labelled rows that are not held out; returns the model, whose size is fixed.

    Labels without an id or a 0/1 value are left out; of labels that contradict each other the lower counts.
    """
    named = labels.select(F.col(id_column).alias("k"), F.col(label_column).cast("int").alias("y"))
    named = named.where(F.col("k").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("k"))).groupBy("k").agg(
        F.min("y").alias("y"))
    chosen = named.orderBy(F.xxhash64("k"), "k").limit(sample)
    sizes = F.col(size_column).cast("long") if size_column else F.lit(None).cast("long")
    texts = docs.select(F.col(id_column).alias("k"), F.col(text_column).cast("string").alias("text"), sizes.alias("n"))
    rows = texts.join(F.broadcast(chosen), "k").select("k", "text", "n", "y")  # at most `sample` rows of two numbers

    def measure(batches):
        for part in slices(batches):
            made = [features(t, n) for t, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(3), pa.array([pickle.dumps(m) for m in made], pa.binary())], ["k", "y", "x"])

    kind = dict(docs.select(F.col(id_column).alias("k")).dtypes)["k"]
    measured = settle(rows.mapInArrow(measure, f"k {kind}, y int, x binary"), "labelled")

    def learn(batches):
        table = pa.Table.from_batches(list(batches), pa.schema([("y", pa.int32()), ("x", pa.binary())]))
        found = [(y, pickle.loads(x)) for y, x in zip(table.column(0).to_pylist(), table.column(1).to_pylist())]
        fitted = fit([x for _, x in found], [y for y, _ in found])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fitted)], pa.binary())], ["model"])

    one = measured.orderBy("k", "x").limit(2 * sample).select("y", "x").coalesce(1)
    return pickle.loads(one.mapInArrow(learn, "model binary").first()["model"])


def score(docs, fitted, text_column="text", size_column=None, name="score_"):
    """Adds the score of every row as a last column called `name`; all other columns stay."""
    import pyspark.sql.types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    at = docs.columns.index(text_column)
    size = docs.columns.index(size_column) if size_column else None

    def run(batches):
        for part in slices(batches):
            texts = part.column(at).to_pylist()
            sizes = part.column(size).to_pylist() if size is not None else [None] * len(texts)
            made = scores([features(t, n) for t, n in zip(texts, sizes)], fitted)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.float64())], names=[*part.schema.names, name])

    return docs.mapInArrow(run, schema)
