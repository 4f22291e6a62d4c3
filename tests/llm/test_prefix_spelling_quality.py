import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evoq.llm import event_prefixes as ep
from evoq.llm import quality, spelling

EVENTS = "recording bigint, event_pos bigint, type string, value string, path string, depth int, node string"


def trie(recordings):
    """All figures of the prefix trie from its definition; ``recordings`` maps an id to its list of (type, value)."""
    members = collections.defaultdict(set)
    for r, events in recordings.items():
        for d in range(len(events) + 1):
            members[tuple(events[:d])].add(r)
    out = {}
    for node, inside in members.items():
        under = [n for n in members if n[:len(node)] == node]
        ends = sorted(r for r in inside if len(recordings[r]) == len(node))
        out[(min(inside), len(node))] = (
            min(members[node[:-1]]) if node else None, len(inside), sum(len(n) == len(node) + 1 for n in under),
            sum(not any(len(m) == len(n) + 1 and m[:len(n)] == n for m in members) for n in under),
            sum((len(members[n]) - 1) * len(n[-1][1]) for n in under if n), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return out


def nodes(spark, rows):
    events = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], EVENTS).repartition(3)
    paths = ep.recording_paths(events)
    found = ep.event_prefixes(events).join(ep.ended_digests(paths), "node", "left").collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len({(r.recording, r.depth) for r in found}) == len(found)
    return {(r.recording, r.depth): (r.parent_recording, r.n_recordings, r.n_children, r.n_leaves, r.saved, r.ended_sha256 or empty)
            for r in found}


def test_depths_that_few_reach():
    assert ep.few_below([]) is None and ep.few_below([(0, 5)]) == 0
    assert ep.few_below([(3, 10), (5, 2), (100, 1)], few=3) == 3
    assert ep.few_below([(3, 10), (5, 2), (100, 1)], few=1) == 5
    assert ep.few_below([(3, 10), (5, 2), (100, 1)], few=13) == 0
    assert ep.few_below([(3, 10), (5, 2), (100, 1)], few=3, events=50) == 50
    assert ep.few_below([(3, 10)], few=3) == 3


@pytest.mark.parametrize("few", [0, 5, 1024])
def test_prefix_nodes_equal_the_definition(spark, monkeypatch, few):
    monkeypatch.setattr(ep.few_below, "__defaults__", (few, 1_000_000))
    pick = random.Random(3)
    rows, recordings = [], {}
    for r in range(60):
        events = [(pick.choice(["stim", "rate"]), pick.choice(["S 1", "S 2é🎉", ""])) for _ in range(pick.randrange(1, 7))]
        recordings[r * 1000 - 5000] = events
        rows += [(r * 1000 - 5000, i, k, v) for i, (k, v) in enumerate(events)]
    for r in (-1, -2, -3):  # a few that are much longer
        recordings[r] = recordings[0][:1] + [("stim", f"v{i - i % 90 * (r == -1)}") for i in range(20 - r)]
        rows += [(r, i, k, v) for i, (k, v) in enumerate(recordings[r])]
    assert nodes(spark, rows) == trie(recordings)


def test_prefix_nodes_nulls_ties_and_hot_paths(spark):
    rows = [(1, None, None, "first"), (1, 2, "stim", None), (2, None, "", "first"), (2, 5, "stim", ""), (None, 1, "stim", "of none"),
            (3, 0, "ab", "c"), (4, 0, "a", "bc"), (5, 1, "x" * 3, "long " * 50_000), (5, 1, "x" * 3, "long " * 50_000)]
    rows += [(i, t, "stim", f"v{t}") for i in range(10_000, 15_000) for t in range(2)]
    same = [("", "first"), ("stim", "")]
    recordings = {1: same, 2: same, 3: [("ab", "c")], 4: [("a", "bc")], 5: [("xxx", "long " * 50_000)] * 2}
    recordings |= {i: [("stim", "v0"), ("stim", "v1")] for i in range(10_000, 15_000)}
    assert nodes(spark, rows) == trie(recordings)
    one = nodes(spark, [(1, 1, "a", "b"), (1, 1, "c", "d")])  # a tie has one order, whatever the order of the rows
    assert one == nodes(spark, [(1, 1, "c", "d"), (1, 1, "a", "b")]) and len(one) == 3
    assert nodes(spark, []) == {}


def test_a_path_may_be_empty_and_null_ones_are_left_out(spark):
    schema = "recording bigint, path array<struct<event:binary,size:bigint>>, node int"
    found = ep.prefix_nodes(spark.createDataFrame([(7, [], 1), (8, None, 1), (None, [], 1)], schema)).collect()
    assert [(r.recording, r.depth, r.n_recordings, r.n_children, r.n_leaves, r.saved) for r in found] == [(7, 0, 1, 0, 1, 0)]


def edits(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_forms(counts, ratio):
    out = {}
    for w, n in counts.items():
        near = sorted((v for v in counts if v != w and edits(w, v)), key=lambda v: (-counts[v], v))
        form = near[0] if near and counts[near[0]] >= ratio * n else None
        out[w] = (form, n, len(near), counts[form] if form else None)
    for w in out:
        end = w
        while out[end][0]:
            end = out[end][0]
        out[w] = (out[w][0], end, *out[w][1:])
    return out


@pytest.mark.parametrize("letters, length, group", [("ab", (1, 7), 4), ("aé🎉z", (3, 9), 50), ("abcdefgh", (7, 12), 100_000)])
def test_forms_equal_brute_force(spark, letters, length, group):
    pick = random.Random(len(letters))
    counts = {}
    for _ in range(250):
        word = "".join(pick.choice(letters) for _ in range(pick.randrange(*length)))
        counts[word] = pick.choice([1, 2, 3, 30, 300, 3000])
        at = pick.randrange(len(word))
        for other in (word[:at] + word[at + 1:], word[:at] + pick.choice(letters) + word[at:], word[:at] + pick.choice(letters) + word[at + 1:]):
            if other:
                counts.setdefault(other, pick.choice([1, 2, 20]))
    words = spark.createDataFrame([(w, n, "x", 1) for w, n in counts.items()] + [(None, 5, "x", 1), ("", 9, "x", 1)],
                                  "word string, n bigint, root string, m int").repartition(3)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_forms(words, 10, group).collect()}
    assert got == plain_forms(counts, 10)


def test_hot_parts_are_cut_further(spark):
    """Words that share their first and last letters, more than one index may hold."""
    counts = {f"prefix{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + i % 7)}{j}middle": 1 + i % 3 * 20 for i in range(300) for j in "01"}
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    first = spelling.pieces(words, 100_000)
    finer = spelling.pieces(words, 20)
    assert finer.count() > first.count() and finer.agg(F.min(F.expr("high - low"))).first()[0] <= 2
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_forms(words, 10, 20).collect()}
    assert got == plain_forms(counts, 10)


def test_words_of_sidecars(spark, sidecars):
    text = "Stimulus STIMULUS stimulus-ÉLECTRODE électrode short électrodes 1234567 " + "x" * 100_000
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, "stimulus")]
    found = collections.Counter(r.word for r in spelling.word_runs(sidecars(rows)).collect())
    want = collections.Counter()
    for _, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            want[run] += len(run) >= 7
    assert found == +want
    assert {r.word: r.n for r in spelling.vocabulary(spelling.word_runs(sidecars(rows))).collect()} == {w: n for w, n in want.items() if n >= 2}
    assert spelling.spelling_forms(spelling.vocabulary(spelling.word_runs(sidecars([])))).count() == 0


def test_quality_of_held_out_texts(spark, sidecars, words_of):
    pick = random.Random(5)
    rows, marks = [], []
    for i in range(400):
        words = words_of(pick.randrange(20, 200), i, 3000)
        if i % 4 == 0:
            words = [w.upper() + "!!" for w in words] if i % 8 else [w for w in words[:8] for _ in range(12)]
        rows.append((i, " ".join(words)))
        marks += [(i, int(i % 4 != 0), "x")] * (1 + i % 2)
    marks += [(i, None, "x") for i in range(5)] + [(None, 0, "x"), (5, 7, "x"), (99_999, 0, "x")]
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "w1 " * 200_000), (None, "null key"), (7, rows[7][1]), (7, "another text of the key")]
    marks = spark.createDataFrame(marks, "key bigint, quality int, content string")
    held_out = F.col("key") % 3 == 1
    spec = quality.QualitySpec(sample=120)
    got = quality.score_quality(sidecars(rows), marks, held_out=held_out, spec=spec).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (r.key is not None and r.key % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.key < 400]
    assert np.mean([r.predicted == int(r.key % 4 != 0) for r in held]) >= 0.98
    of = {r.key: r.score for r in got}
    assert of[1000] == of[1001] == of[1002] and abs(of[1000] - 0.75) < 0.05
    assert of[1003] < 0.5
    again = quality.score_quality(sidecars(rows), marks, held_out=held_out, spec=spec).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_quality_votes_equal_the_definition(spark, sidecars, words_of):
    """Every text against every sampled one: the nearest by cosine, weighted by it."""
    rows = [(i, " ".join(words_of(40, i, 50 + 400 * (i % 2)))) for i in range(80)]
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)], "key bigint, quality int")
    spec = quality.QualitySpec(sample=20, neighbours=7)
    model = quality.fit_quality_model(sidecars(rows), marks, spec=spec)
    assert len(model.marks) == 40 and collections.Counter(model.marks) == {0: 20, 1: 20}
    import pyarrow as pa
    vectors = model.vectors_of(quality.term_counts(pa.array([t for _, t in rows]), spec))
    for row in quality.score_quality(sidecars(rows), marks, spec=spec).collect():
        near = sorted(((round(float(vectors[row.key] @ v), 5), m, w) for v, m, w in zip(model.vectors, model.marks, model.worth)), reverse=True)
        near = [x for x in near if x[0] >= near[6][0] and x[0] > 0]
        votes = [c ** spec.sharpness * w for c, _, w in near]
        want = (sum(v * m for v, (_, m, _) in zip(votes, near)) + spec.prior * model.share) / (sum(votes) + spec.prior)
        assert abs(row.score - want) < 1e-3


def test_quality_without_marks_or_texts(spark, sidecars):
    none = spark.createDataFrame([], "key bigint, quality int")
    assert [r.score for r in quality.score_quality(sidecars([(1, "some text")]), none).collect()] == [0.5]
    assert quality.score_quality(sidecars([]), none).count() == 0
