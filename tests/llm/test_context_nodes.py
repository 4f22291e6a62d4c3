import math

import pytest
from pyspark.sql import functions as F

from evoq.llm import context_tree as ct
from test_text_scores import WORD, brute_tree


@pytest.mark.parametrize("gram_head", [0, 40])
def test_scores_do_not_depend_on_places_or_on_the_head(sidecars, words_of, gram_head):
    """A model of 16 places would mix up all nodes; the scores are those of the definition, whatever is looked up or joined."""
    rows = [(i, " ".join(words_of(8, i, 9))) for i in range(12)] + [(20, "zq unseen"), (21, None)]
    spec = ct.TreeSpec(depth=2, slots=4, head=3, gram_head=gram_head)
    out = {r.key: r.score for r in ct.tree_scores(sidecars(rows), held_out=F.col("key") >= 10, spec=spec).collect()}
    data = {k: (" ".join(w.lower() for w in WORD.findall(t or "")) + "\n").encode() for k, t in rows}
    chance = brute_tree([d for k, d in data.items() if k < 10], 2)
    for k, d in data.items():
        want = sum(math.log10(chance(tuple(d[j] if j >= 0 else 0 for j in (i - 2, i - 1)), (1 << bit) | (byte >> (8 - bit)), (byte >> (7 - bit)) & 1))
                   for i, byte in enumerate(d) for bit in range(8))
        assert out[k] == pytest.approx(want, rel=1e-9)
