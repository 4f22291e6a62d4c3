import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from evoq.llm import near_copies as nc
from evoq.llm import store, words

WORD = re.compile("[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (key, _) in enumerate(rows):
        keys = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        component = min(keys) if keys else None
        out.append((key, len(sets[i]), component if sets[i] else key))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.key, r.n_shingles, r.component) for r in df.collect()), key=repr)


def test_word_hashes_follow_the_word_rule():
    texts = ["Ab c\td  E", "", None, "\x1cq ab", "É é", " x\x0by "]
    found = []
    for block in words.blocks_of_words(pa.array(texts)):
        found += [[block.text(k) for k in range(block.rows[i], block.rows[i + 1])] for i in range(block.last - block.first)]
    assert found == [WORD.findall(lower(t or "")) for t in texts]


def test_one_text_over_many_blocks():
    text = " ".join(f"word{i % 977}" for i in range(800_000))
    block = next(words.blocks_of_words(pa.array([text])))
    alone = {w: next(words.blocks_of_words(pa.array([w]))).hashes[0] for w in {f"word{i}" for i in range(977)}}
    assert len(text) > 4 * words.BLOCK
    assert (block.hashes == np.array([alone[f"word{i % 977}"] for i in range(800_000)])).all()


def test_equal_to_brute_force(sidecars, words_of):
    pick, rows = random.Random(3), []
    for group in range(12):
        base = words_of(pick.choice([3, 30, 80, 300]), group)
        for _ in range(pick.choice([1, 2, 5])):
            w = list(base)
            for _ in range(pick.choice([0, 0, 1, 2, 4])):
                w[pick.randrange(len(w))] = f"e{pick.randrange(10**6)}"
            rows.append((len(rows) * 7 % 101, " ".join(w)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "ONE  two"), (None, "one two"), (None, "alone here"), rows[0], (5000, rows[0][1])]
    assert result(nc.near_copies(sidecars(rows))) == brute(rows)


def test_kept_is_the_least_key(sidecars):
    got = {r.key: r.kept for r in nc.near_copies(sidecars([(4, "a b c d e f"), (2, "a b c d e f"), (9, None)])).collect()}
    assert got == {4: False, 2: True, 9: True}


def test_large_group_by_blocks(sidecars, words_of):
    base, rows = words_of(140, 1, 5000), []
    pick = random.Random(5)
    for i in range(150):
        w = list(base)
        for _ in range(pick.choice([0, 1, 1, 2, 3, 5])):
            w[pick.randrange(140)] = f"e{pick.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    small = nc.NearSpec(block_bytes=60_000)
    assert result(nc.near_copies(sidecars(rows), spec=small)) == brute(rows)


def test_least_matches_keep_similar_pairs():
    spec = nc.NearSpec()
    least = nc.least_matches(spec)
    pick = np.random.default_rng(1)
    equal = (pick.random((20_000, spec.hashes)) < 0.85).reshape(20_000, -1, spec.batch).sum(axis=2).cumsum(axis=1)
    assert (equal >= np.array(least)).all(axis=1).mean() > 0.999
    different = (pick.random((2_000, spec.hashes)) < 0.5).reshape(2_000, -1, spec.batch).sum(axis=2).cumsum(axis=1)
    assert (different >= np.array(least)).all(axis=1).mean() < 0.01


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7)]
    got = {r.node: r.component for r in store.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, **{200 + i: 100 for i in range(50)}}
    assert store.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_key_filter_has_no_misses(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("k"))
    bitmap = store.key_filter(keys, "k")
    held = np.array([r.k for r in keys.collect()])
    assert words.may_hold(bitmap, held).all()
    assert words.may_hold(bitmap, np.arange(1 << 40, (1 << 40) + 1000, dtype=np.int64) * 7919 ** 4).mean() < 0.05


def test_empty_table(sidecars):
    assert nc.near_copies(sidecars([]).limit(0)).count() == 0
