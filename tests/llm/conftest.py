import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))  # tests share their brute-force versions

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows):
        """Documents from (id, text) or (id, text, source)."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture()
def words():
    def make(n, seed):
        r = random.Random(seed)
        return [f"w{r.randrange(4000)}" for _ in range(n)]

    return make
