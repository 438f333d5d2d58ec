"""Small tables with every awkward case: null ids and texts, empty and very long texts, repeated rows, clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, slot long, shard int, key string, score double, rep long, token long, text_crc32 long"


def make_rows():
    rng = random.Random(7)
    words = ["the", "of", "alpha", "beta", "gamma", "Delta", "été", "naïve", "x1", "42", "don't", "co-op", "end.", "(y)", "日本語"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 120))) for _ in range(24)]
    out = []
    for i, t in enumerate(base):
        out.append((i * 3, t))
    for k in range(12):  # near copies of one text
        w = base[0].split() + base[1].split() + base[2].split()
        w[k * 3 % len(w)] = f"changed{k}"
        out.append((100 + k, " ".join(w)))
    out += [(200 + k, base[3]) for k in range(6)]  # exact copies
    out += [(7, None), (8, ""), (9, " \n\t "), (10, "one"), (11, "one two three"), (12, "One  two\nTHREE"), (13, "a" * 50_000), (14, "word " * 20_000), (None, "no id at all here"), (None, None), (15, "<|endoftext|> in <|startoftext|>text"), (16, " a̸ ≠   x y \x1c z"), (17, "  two  spaces \n\n new  ")]
    out += [(18, "same row twice in the table")] * 2 + [(19, "one id"), (19, "with two texts")]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0", None, 1, 2, 3, "k", 0.5, 4, 5, 6) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def messy_rows():
    return make_rows()


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return frame(spark, messy_rows).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
