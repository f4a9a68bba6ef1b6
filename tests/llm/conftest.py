import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, places string, copy string, score double, u double, rank int, label int"


def make_docs(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    full = [(i, t, "en", s, len(t or ""), "p", "c", 1.0, 0.5, 1, 7) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def corpus_rows():
    """Texts with copies, near copies, shared passages, nulls, empties, a null id, a repeated row and a very long text."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "Élan", "über", "中文"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = text(60)
    rows = [(i, text(r.randint(3, 120)), f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[0][1], "s0") for i in range(20)]
    rows += [(200 + i, f"{text(20)} {passage} {text(10)}", "s1") for i in range(12)]
    near = text(200).split()
    rows += [(300 + i, " ".join(near[:i] + [f"x{i}"] + near[i + 1 :]), None) for i in range(15)]
    rows += [(400, None, "s1"), (401, "", "s2"), (402, " \t\n ", None), (403, "one", "s0"), (404, text(9000), "s2"), (405, passage, None), (5, rows[5][1], rows[5][2]), (None, passage, "s0")]
    return rows


@pytest.fixture(scope="session")
def corpus(spark, corpus_rows):
    return make_docs(spark, corpus_rows).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return make_docs(spark, [])
