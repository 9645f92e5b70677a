import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, size string, part int, kind string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, source]) with extra columns whose names clash with the operators' own."""

    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, "x", "y", 7, "z") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and long texts, ties and repeated rows."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma,", "délta", "the", "of", "and", "ω漢字", "x|y", "x1"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [text(rng.randint(1, 60)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(40, None), (41, ""), (42, " \t\n"), (43, text(6000)), (44, base[3]), (45, base[3].replace(" ", "  \n")), (46, base[4] + " end"), (3, base[3]), (None, base[5]), (47, "=" * 2000), (48, "one"), (49, "two words")]
    return rows
