"""Small tables with the cases that every operator must bear."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
# names that operators use inside
CLASHES = ("row", "row_key", "positions", "fingerprint", "component", "bucket", "key", "n_words", "line_text", "keep_bitmap")


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def texts(seed=1, n=60):
    """Random texts with copies, near copies, shared passages and lines, odd and long ones."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, 90))
    out = []
    for i in range(n):
        body = words(rng, rng.randrange(20, 260))
        kind = i % 6
        if kind == 1 and out:
            out.append(rng.choice(out))
            continue
        if kind == 2 and out and out[-1]:
            near = out[0].split(" ")
            near[rng.randrange(len(near))] = "changed"
            out.append(" ".join(near))
            continue
        text = " ".join(body)
        if kind == 3:
            text = f"{text} {passage}\nShared Line here.\n{' '.join(body[:9])}\nshared line HERE.  "
        if kind == 4:
            text = "\n".join(" ".join(body[j : j + 7]) for j in range(0, len(body), 7)) + "\nShared line here.\n\n"
        out.append(text)
    return out


def rows(seed=1, n=60):
    """Documents with null ids and texts, blank and very long texts, ties and repeated rows."""
    rng = random.Random(seed)
    base = [(i, t) for i, t in enumerate(texts(seed, n))]
    long = " ".join(words(rng, 30_000, 300))
    base += [(n, None), (n + 1, ""), (n + 2, " \t\n \n"), (n + 3, long), (n + 4, "\n".join(["same line"] * 500)), (None, texts(seed, n)[0]), (None, None)]
    base += [(n + 5, "É à ß 漢字 😀 İ ﬁ\x1c x y z"), (n + 6, "one"), (n + 7, "one two"), (n + 8, "A B C"), (n + 9, "a b c")]
    base += [base[3], base[3], (7, "another text with the same id")]
    return [(i, t, rng.choice(["en", "de", None]), f"src{rng.randrange(4)}", len(t or "")) for i, t in base]


def frame(spark, data=None, extra=True):
    """The rows as a table, with columns whose names clash with inner ones."""
    df = spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(5)
    for name in CLASHES if extra else ():
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def write(spark, folder, data=None):
    frame(spark, data, extra=False).coalesce(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)
