"""Awkward documents that every operator takes: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, fp long, rank int, _key string, word string, key string, n long, piece int, label map<string,string>"


def awkward(spark, long=60_000):
    rnd = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "thing", "ÉCOLE", "straße", "über", "don't", "x1"]
    prose = " ".join(rnd.choice(words) for _ in range(400))
    texts = [
        None, "", " ", "\n\t", "a", "A a", prose, prose, prose + " end", "z" * 5_000, " ".join(rnd.choice(words) for _ in range(long // 6)), "日本語 テスト 😀", "1.2.3.4 a@b.co +1 (555) 010-9999 or 4111 1111 1111 1111", "<|endoftext|> <|startoftext|>",
    ]
    rows = [(i, t, "en", "s", 0, 1, 2, 3, 4, "k", "w", "y", 5, 6, {"a": "b"}) for i, t in enumerate(texts)]
    rows += [rows[6], (None, "no id", None, None, None, None, None, None, None, None, None, None, None, None, None), (99, "same id", *rows[0][2:]), (99, "same id, other text", *rows[0][2:])]
    return spark.createDataFrame(rows, SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def folder(spark, tmp_path, **tables):
    """A folder with these tables, as queries read it."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
