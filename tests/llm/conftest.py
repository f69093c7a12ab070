import random

import pytest
from pyspark.sql import types as T

DOC = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("size", T.IntegerType()),  # an extra column that clashes with results
    ]
)


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghiéüß") for _ in range(rng.randint(2, 8))) for _ in range(400)]


@pytest.fixture(scope="session")
def corpus(words):
    """Rows of documents: prose, copies, near copies, nulls, blanks, one long text, repeated rows."""
    rng = random.Random(11)

    def prose(n):
        return "\n".join(" ".join(rng.choice(words) for _ in range(12)) + "." for _ in range(n))

    rows = [(i, prose(rng.randint(1, 9)), rng.choice(["en", "fr"]), f"s{rng.choice([0, 0, 0, 1, 2, 3])}") for i in range(120)]
    rows += [(200 + i, rows[7][1], "en", "s0") for i in range(60)]
    rows += [(300 + i, rows[9][1].replace(rows[9][1].split()[i % 5], "zzz", 1), "en", "s1") for i in range(12)]
    rows += [(400, None, None, None), (401, "", "en", None), (402, " \n\t ", "en", "s2"), (403, "one", "en", "s2")]
    rows += [(404, prose(700), "en", "s3"), (405, "42 17 !!", "fr", "s3"), rows[3], rows[3], (None, "no id here at all", None, "s0")]
    return [(i, t, lang, s, len(t) if t is not None else None, 1) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOC).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
