import pytest

# Columns whose names clash with those the operators use inside.
EXTRA = "row bigint, place bigint, set_id string, value int, id int, cid int, text string"


@pytest.fixture(scope="session")
def sidecars(spark):
    """Builds a table of sidecar texts ``dataset, key, content, lang`` with extra columns, from ``(key, content)`` or longer rows."""
    def build(rows):
        full = [(r[2] if len(r) > 2 else "ds1", r[0], r[1], r[3] if len(r) > 3 else None, 1, 2, "x", 3, 4, 5, "y") for r in rows]
        return spark.createDataFrame(full, f"dataset string, key bigint, content string, lang string, {EXTRA}").repartition(3)
    return build


def made_words(n, seed, size=400):
    import random
    pick = random.Random(seed)
    return [f"w{pick.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="session")
def words_of():
    return made_words
