"""Rows with every odd case, for the tests of this folder."""

import random

LONG = " ".join(f"w{i % 977}" for i in range(60_000))
DIGITS = "7" * 60_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, fp string, score string, lang_pred string, spans string, `count` string, kept_text string"


def prose(seed: int, n: int, letters: str = "aeioustrnl") -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(n))


def rows() -> list[tuple]:
    texts = [
        (1, prose(1, 80)), (2, prose(1, 80)), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "one two"), (8, "..., !! 123"),
        (None, prose(2, 40)), (None, None), (9, prose(3, 30)), (9, prose(3, 30)), (9, prose(3, 30)), (10, LONG), (11, DIGITS), (12, "+1" + DIGITS + " a@" + "b." * 2000),
        (13, "mail a.b@c.de, ip 1.2.3.4 and 300.1.1.1, card 4111 1111 1111 1111, call +1 (555) 123-4567 now"), (14, "héllo wörld ünïcode 😀 x@y.zz"), (15, prose(4, 60)), (16, None),
    ]
    out = [(i, t, None if k % 5 == 0 else ("en", "de", "fr")[k % 3], None if k % 4 == 0 else "s0", None if t is None else len(t), "x", "y", None, "z", "q", None, "w", "v") for k, (i, t) in enumerate(texts)]
    return out


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def write(spark, path, data=None, benchmark=(), pages=(), conversations=()):
    table(spark, data).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(list(pages), "page_id long, url string, html string").write.mode("overwrite").parquet(f"{path}/pages.parquet")
    spark.createDataFrame(list(conversations), "conv_id long, turn long, role string, text string").write.mode("overwrite").parquet(f"{path}/conversations.parquet")
    return str(path)
