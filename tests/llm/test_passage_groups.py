import random

import numpy as np
import pytest

from evoq.llm import passages


def edited(passage, at, kind):
    return passage[:at] + (["zz"] if kind == "insert" else []) + passage[at + (kind == "delete"):]


@pytest.mark.parametrize("kind", ["insert", "delete"])
def test_passages_with_a_word_more_or_less(sidecars, words_of, kind):
    """50 or 51 words with one word put in or left out in the middle: similarity 0.82."""
    rows = []
    for i in range(60):
        passage = words_of(51 if kind == "delete" else 50, 100 + i, 99999)
        other = edited(passage, 25, kind)
        rows += [(2 * i, " ".join(words_of(40 + i, 300 + i, 99999) + passage + words_of(30, 500 + i, 99999))),
                 (2 * i + 1, " ".join(words_of(20, 700 + i, 99999) + other + words_of(60, 900 + i, 99999)))]
    out = {r.key: r for r in passages.shared_passages(sidecars(rows)).collect()}
    assert set(out) == set(range(120))
    assert all(out[k].class_key == k - k % 2 and out[k].n_links == 1 for k in out)


@pytest.mark.parametrize("block", [4, 1024])
def test_variants_do_not_hide_an_exact_passage(sidecars, words_of, block):
    """Two texts with one passage among 30 variants of it that are less similar than 0.8, in several templates."""
    pick, rows = random.Random(5), []
    for t in range(12):
        passage = words_of(60, 40 + t, 99999)
        for v in range(32):
            own = list(passage)
            if v >= 2:
                for at in (14 + v % 4, 30 + v % 3, 45 + v % 5):
                    own[at] = f"x{pick.randrange(10**9)}"
            rows.append((100 * t + v, " ".join(words_of(30, 1000 + 50 * t + v, 99999) + own + words_of(30, 3000 + 50 * t + v, 99999))))
    out = {r.key: r for r in passages.shared_passages(sidecars(rows), spec=passages.PassageSpec(block=block)).collect()}
    for t in range(12):
        assert {100 * t, 100 * t + 1} <= set(out) and out[100 * t + 1].class_key == 100 * t
        assert [tuple(s) for s in out[100 * t].spans] == [(30, 90)]


@pytest.mark.parametrize("repeats", [100, 200])
def test_a_text_that_repeats_a_passage_shares_all_of_it(sidecars, words_of, repeats):
    passage = words_of(60, 77, 99999)
    rows = [(1, " ".join(passage * repeats)), (2, " ".join(words_of(30, 78, 99999) + passage + words_of(30, 79, 99999)))]
    out = {r.key: r for r in passages.shared_passages(sidecars(rows)).collect()}
    assert out[1].n_words == 60 * repeats and [tuple(s) for s in out[2].spans] == [(30, 90)]


@pytest.mark.parametrize("block", [8, 1024])
def test_every_shared_passage_of_hot_texts_is_in_the_spans(sidecars, words_of, block):
    """Boilerplate that all texts hold, and in it or beside it passages that only some of them share."""
    plate, rows, want = words_of(55, 7, 99999), [], {}
    for k in range(48):
        extra = words_of(52, 9000 + k // 3, 99999)
        rows.append((k, " ".join(words_of(20 + k, 100 + k, 99999) + plate + words_of(10, 300 + k, 99999) + extra + words_of(9, 500 + k, 99999))))
        want[k] = [(20 + k, 75 + k), (85 + k, 137 + k)]
    out = {r.key: r for r in passages.shared_passages(sidecars(rows), spec=passages.PassageSpec(block=block)).collect()}
    assert {k: [tuple(s) for s in r.spans] for k, r in out.items()} == want
    assert {(r.class_key, r.n_links) for r in out.values()} == {(0, 47)}


def test_windows_without_repeated_shingles_need_no_sets(monkeypatch):
    """The places of a plain window in another give the same ranges as sets of their shingles, and no set is made for them."""
    pick, spec = random.Random(9), passages.PassageSpec()
    passage = [pick.randrange(1 << 32) for _ in range(150)]
    bodies = []
    for _ in range(40):
        own = [pick.randrange(1 << 32) if pick.random() < 0.03 else x for x in passage]
        at = pick.randrange(20)
        bodies.append(np.array(own[at:at + 100 + pick.randrange(30)], "<u4"))
    whole = [(i, j, [(0, len(bodies[i]) - 1, 0, len(bodies[j]) - 1)]) for i in range(40) for j in range(i)]
    plain = [passages.common_runs(bodies[i], bodies[j], w, spec) for i, j, w in whole]
    links = passages.group_links(np.arange(40), bodies, spec)
    with monkeypatch.context() as m:
        m.setattr(passages, "_places", lambda a, b: None)
        assert plain == [passages.common_runs(bodies[i], bodies[j], w, spec) for i, j, w in whole] and any(plain) and not all(plain)
    monkeypatch.setattr(np, "isin", None)
    assert passages.group_links(np.arange(40), bodies, spec) == links and len(links) > 39


def test_small_groups_give_the_same_links_by_table(monkeypatch):
    """Windows that share, repeat, extend and alter passages: the table of a small group tells what the flags of a large one do."""
    pick, spec, links = np.random.default_rng(11), passages.PassageSpec(), 0
    for _ in range(40):
        base = [pick.integers(0, 1 << 32, 70, dtype=np.uint32) for _ in range(2)]
        bodies = []
        for _ in range(14):
            body = base[pick.integers(2)][pick.integers(0, 12):].copy()
            body[pick.integers(0, len(body), pick.integers(0, 6))] = pick.integers(0, 1 << 32, dtype=np.uint32)
            bodies.append(np.concatenate([body, body[:30]]) if pick.random() < 0.3 else body)
        ids = pick.integers(0, 9, len(bodies)).astype(np.int64)
        got = passages.group_links(ids, bodies, spec)
        with monkeypatch.context() as flags:
            flags.setattr(passages, "TABLE_CELLS", 0)
            assert passages.group_links(ids, bodies, spec) == got
        links += len(got)
    assert links > 100


def test_equal_windows_are_one_range_without_a_search(monkeypatch):
    tokens, spec = np.arange(80, dtype=np.uint64), passages.PassageSpec()
    monkeypatch.setattr(passages, "_dense_range", None)
    assert passages.common_runs(tokens, tokens, [(3, 59, 3, 59)], spec) == [(3, 64, 3, 64)]
    assert passages.common_runs(tokens, tokens, [(3, 40, 3, 40)], spec) == []


def test_a_text_of_many_pairs_is_cut_into_words_once_in_a_row(spark, monkeypatch):
    spec, text = passages.PassageSpec(), " ".join(f"w{i}" for i in range(70))
    other = text.replace("w9 ", "v ")
    rows = [(1, k, [(0, 50, 0, 50)], text) for k in range(5)] + [(2, 9, [(10, 60, 0, 50)], other)]
    pairs = spark.createDataFrame(rows, "a bigint, b bigint, hits array<struct<al: int, ar: int, bl: int, br: int>>, text_a string").coalesce(1)
    made, cut = [], passages.words.shingles
    monkeypatch.setattr(passages.words, "shingles", lambda *x: made.append(1) or cut(*x))
    run = []
    monkeypatch.setattr(passages.words, "giving_back", lambda f: run.append(f) or f)
    passages._window_tokens(pairs, spec)
    batches = pairs.toArrow().to_batches()
    got = [t for b in run[0](iter(batches)) for t in b.column(3).to_pylist()]
    whole = {1: cut(next(passages.words.blocks_of_words(passages.pa.array([text]))).hashes), 2: cut(next(passages.words.blocks_of_words(passages.pa.array([other]))).hashes)}
    assert got == [whole[1][:51].tobytes()] * 5 + [whole[2][10:61].tobytes()] and len(made) == 2
