"""Grouped work on sorted record batches inside a task."""

import numpy as np
import pyarrow as pa

#: Rows gathered before the groups they complete are handed on.
GATHERED = 1 << 17


def sorted_groups(batches, keys, gathered=GATHERED):
    """Sorted batches -> (first row of each group, columns by name) over whole groups.

    The first `keys` columns name the group; rows of a group stand together.  A group is handed on whole, so callers
    bound its size; many small groups come together, for work on all of them at once.
    """
    held, rows = [], 0

    def cut(final):
        table = pa.Table.from_batches(held).combine_chunks()
        columns = {n: table.column(n).to_numpy() for n in table.column_names}
        names = table.column_names[:keys]
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for n in names:
            new[1:] |= columns[n][1:] != columns[n][:-1]
        heads = np.flatnonzero(new)
        if final:
            return heads, columns, None
        end = heads[-1]
        rest = [b for b in table.slice(end).to_batches()]
        return heads[:-1], {n: c[:end] for n, c in columns.items()}, rest

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= gathered:
            heads, columns, held = cut(False)
            rows = sum(b.num_rows for b in held)
            if len(heads):
                yield heads, columns
    if held:
        heads, columns, _ = cut(True)
        yield heads, columns


def forest(a, b, names):
    """Links between rows a and b -> (names of rows, smallest name linked) without those that name themselves."""
    rows, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a):]
    label = names[rows]
    order = np.argsort(label, kind="stable")
    rank = np.empty(len(rows), np.int64)
    rank[order] = np.arange(len(rows))
    root = rank.copy()
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[order[new]]  # follow the link of the row that a row points to
        if (new == root).all():
            break
        root = new
    linked = root != rank
    return label[linked], label[order[root[linked]]]
