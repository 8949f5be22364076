import random

import pytest

DOC_TYPE = (
    "doc_id long, text string, lang string, source string, n_chars long,"
    " _block string, size string, fp string, source_n int, slot string"
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table with nulls allowed anywhere and extra columns of clashing names."""

    def make(rows):
        full = [
            (i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "b", "z", "f", 1, "q") for i, t in rows
        ]
        return spark.createDataFrame(full, DOC_TYPE).repartition(3)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, shared passages, empty, NULL, odd and very long texts."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(150)] + ["ñandú", "Straße", "GNU", "x.y", "1984"]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passage = text(40)
    rows = [(i, text(rng.randint(1, 120))) for i in range(1, 60)]
    rows += [(100 + i, f"{text(15)}\n{passage}\t{text(9)}") for i in range(20)]
    rows += [(200 + i, rows[3][1]) for i in range(15)]
    rows += [(300, ""), (301, None), (302, "  \n "), (303, "one"), (304, "A b\x0bc  d")]
    rows += [(None, passage), (None, None), (7, rows[6][1]), (305, text(8000)), (306, passage)]
    near = rows[8][1].split()
    rows += [(400 + i, " ".join([*near[:i], "new", *near[i:]])) for i in range(6)]
    return rows
