"""Small tables with every awkward case."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéßn") for _ in range(r.randrange(1, 7))) for _ in range(60)] + ["The", "AND", "x.", "a,b", "日本", "10", "'s", "don't"]
    passage = " ".join(r.choice(vocabulary) for _ in range(30))
    rows = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.choice([0, 1, 2, 5, 14, 40, 90]))]
        text = r.choice([" ", " ", " ", "  ", "\n"]).join(words)
        if i % 5 == 0:
            text += r.choice([" ", "\n", "\t"]) + passage
        rows.append((i * 7, text, r.choice(["en", "de", None]), r.choice(["a", "b", "b", None]), len(text)))
    copy = rows[10]
    rows += [(1000 + i, copy[1], "en", "b", 1) for i in range(12)] + [copy, copy]
    rows += [(None, passage, None, None, None), (None, None, None, "a", None), (2000, None, "en", "a", None), (2001, "", "en", "a", 0), (2002, " \n\t ", "de", "a", 4)]
    rows += [(2003, " ".join(r.choice(vocabulary) for _ in range(30000)), "en", "b", 1), (-5, passage + " " + passage, "en", "a", 2)]
    rows += [(2010, "a" * 5000, "en", "a", 1), (2011, "a\x1cb    c d <|endoftext|> <|startoftext|>", "en", "a", 1), (7, passage, "en", "a", 1)]
    near = [r.choice(vocabulary) for _ in range(400)]
    for i in range(8):
        near[i * 11] = "changed"
        rows.append((3000 + i, " ".join(near), "en", "b", 1))
    return rows


def frame(spark, rows, clash=True):
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        for name in ("key", "content", "h", "fp", "length", "pos", "size", "row", "w", "bucket", "score", "component_id", "_t", "_y", "label"):
            df = df.withColumn(name, F.lit("x"))
    return df
