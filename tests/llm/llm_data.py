"""Small inputs of the tests: prose with copies, gaps and clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, h string, rep string, component int"
WORDS = [a + b for a in ("ka", "lo", "mi", "ser", "tun", "vel", "é", "Zo") for b in ("r", "nde", "st", "ío", "a", "pp")]


def prose(seed, lines=6, words=12):
    rng = random.Random(seed)
    return "\n".join(" ".join(rng.choice(WORDS) for _ in range(words)) + "." for _ in range(lines))


def row(doc_id, text):
    return (doc_id, text, "en", "s", len(text or ""), 5, "x", None, 1)


def awkward():
    """Nulls in every column, empty and long texts, copies, repeated rows."""
    one, two = prose(1), prose(2)
    near = one.replace("\n", " ", 1)
    return [row(1, one), row(2, two), row(3, one), row(3, one), row(4, near), row(5, ""), row(6, None), row(7, " \t\n "),
            row(8, prose(3, 400, 30)), row(9, "one"), row(10, two + "\n" + prose(4, 3)), row(None, two), row(None, None),
            (11, prose(5), None, None, None, None, None, None, None), row(12, "a " * 3000), row(13, "\n".join(["ab cd"] * 9))]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def table_folder(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)
