"""Small tables with the cases every operator must handle."""

import random

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "\n\n", "a", "a b", "Hello, World! Hello, World!", "x" * 5000, "don't DON'T we'll 're",
    "ÉÉ ß Σς İ ² Ⅷ 中文 👍 \x1c ​", "<|endoftext|> and <|startoftext|>", "1234 !!! ...",
]


def docs_frame(spark, texts, ids=None, clash=False):
    rows = [(i, t) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    if clash:
        for name in ("ids", "row", "length", "fp", "key", "bucket", "label", "lang", "score", "component", "pos", "line", "n"):
            from pyspark.sql import functions as F

            frame = frame.withColumn(name, F.lit("clash"))
    return frame


def random_texts(n, seed=0, words=40, vocab=30):
    rng = random.Random(seed)
    names = ["w%d" % i for i in range(vocab)]
    return [" ".join(rng.choices(names, k=rng.randint(0, words))) for _ in range(n)]
