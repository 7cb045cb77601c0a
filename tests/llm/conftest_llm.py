import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def frame(spark, rows, **extra):
    """A documents table of (id, text), with extra columns of constant values."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and blank texts, copies, near copies, shared passages, repeats inside a text, a very long text, other scripts."""
    rng = random.Random(11)
    base = [prose(rng, 120) for _ in range(6)]
    passage = prose(rng, 70, 5000)
    rows = [(10, None), (11, ""), (12, " \t\n "), (13, "one"), (14, "ein zwei drei\x0bvier\x0cfünf"), (15, "é" * 40), (16, "=" * 700), (17, "=" * 500 + "ab")]
    rows += [(20 + i, t) for i, t in enumerate(base)] + [(40 + i, base[0]) for i in range(8)]
    rows += [(60 + i, prose(rng, 40) + " " + passage + "\n" + prose(rng, 30)) for i in range(5)]
    words = base[1].split()
    for i in range(5):
        changed = list(words)
        changed[rng.randrange(len(words))] = "CHANGED"
        rows.append((80 + i, "  ".join(changed)))
    rows += [(90, (passage + " . ") * 3), (91, base[2].upper()), (92, "x y " * 400), (93, prose(rng, 20_000)), (94, "\\ $1 <|end|> &amp; 字字字 " * 30)]
    return rows


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    """The edge rows, with columns whose names the operators use inside."""
    return frame(spark, edge_rows, id=1, chunk=2, bucket="b", key=3, fp=4, component="c", matches=5, n_words="n", n_hit=True, score="s", n_found="f", kept="k", node=6, token=7).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def repeated(spark):
    """Rows that share an id, rows without one, and equal rows."""
    text = prose(random.Random(3), 60)
    return frame(spark, [(1, text), (1, text), (1, text + " more"), (None, text), (None, text), (2, text), (2, None)])
