import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evoq.llm import contamination as cm
from evoq.llm import neighbours, object_rules, passages, secrets

WORD = re.compile("[^\x20\x09-\x0D]+")
PATTERNS = {"assign": (re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 12),
            "access": (re.compile("AKIA[A-Z0-9]+"), 0, 18), "hex": (re.compile("[0-9a-f]+"), 0, 16)}


def base_spans(text):
    found = []
    for i, (kind, (pattern, group, least)) in enumerate(PATTERNS.items()):
        found += [(m.start(), i, kind, m.end(), m[group]) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return sorted(found)


LIVE = "Zk3" + "qWbv7xLm" * 3
SECRETS = [(1, "token=api_key : abcdefghijklmnop é🎉 Password = 'x1234567890ab'"), (2, "AKIA" + "Q" * 13 + " AKIA" + "Z" * 14 + " secret:short"),
           (3, None), (4, ""), (5, "a" * 15 + " " + "0" * 16 + f" {LIVE} AKIAAKIA" + "B" * 10), (6, "copied R" + "t5Yu8" * 5), (7, "copied R" + "t5Yu8" * 5),
           (8, "copied R" + "t5Yu8" * 5), (9, "API_KEY:\"Ab/+=_.-12345\" " * 3), (None, "passwd=aaaaaaaaaaaa"), (1, "no secret here")]


def test_secret_spans(sidecars):
    df = sidecars([(k, t, f"ds{i % 2}") for i, (k, t) in enumerate(SECRETS)]).withColumn("subject", F.col("key"))
    out = secrets.scan_secrets(df).collect()
    got = sorted(((r.key, [tuple(s) for s in r.base]) for r in out), key=repr)
    assert got == sorted(((k, base_spans(t)) for k, t in SECRETS), key=repr)
    for r in out:
        kinds = [s.kind for s in r.spans]
        assert [s for s in r.spans if s.kind != "live"] == list(r.base) and [s.start for s in r.spans] == sorted(s.start for s in r.spans)
        # The token of one owner is live; the one that three subjects of two datasets hold is not.
        assert kinds.count("live") == (1 if r.key == 5 else 0)
        assert r.n_live + r.n_copied == len(r.spans)
    assert secrets.scan_secrets(df.limit(0)).count() == 0


def test_ownership_counts_holders_once(spark):
    rows = [("a", "d1", "s1"), ("a", "d1", "s1"), ("a", "d1", "s2"), ("a", "d2", "s1"), ("b", None, None), ("c", "d1", None)]
    got = {r.digest: (r.n_subjects, r.n_datasets) for r in secrets.ownership(spark.createDataFrame(rows, "digest string, dataset string, subject string")).collect()}
    assert got == {"a": (3, 2), "b": (0, 0), "c": (0, 1)}


def test_redaction(spark):
    df = spark.createDataFrame([("0123456789", [(2, 4), (3, 6), (8, 10)]), ("é🎉ab", [(1, 2)]), ("plain", []), (None, [])],
                               "t string, spans array<struct<start: int, end: int>>")
    assert [r.x for r in df.select(secrets.redact(F.col("t"), F.col("spans"), "#").alias("x")).collect()] == ["01#67#", "é#ab", "plain", None]


def test_spans_only_use_column_functions(sidecars):
    df = sidecars(SECRETS).withColumn("subject", F.col("key"))
    plan = secrets.candidates(df, "dataset", "subject", "key", "content")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("dims,shard", [(3, 40), (16, 64), (1, 8192)])
def test_nearest_equals_brute_force(spark, dims, shard):
    pick = np.random.default_rng(dims)
    rows = [(i, [float(x) for x in pick.normal(0, 1, dims).round(1)]) for i in range(300)]
    rows += [(300, None), (320, [float("nan")] * dims), (340, [None] * dims), (360, [float("inf")] + [0.0] * (dims - 1)), (380, []), (None, [1.0] * dims),
             rows[0], (400, [5.0] * (dims + 1)), (420, [1e10] * dims)]
    df = spark.createDataFrame([(k, v, 1, 2, 3) for k, v in rows], "epoch bigint, features array<double>, vector int, score int, block int").repartition(4)
    spec = neighbours.SearchSpec(shard=shard, block=7, leaf=4)
    out = collections.defaultdict(list)
    for r in neighbours.nearest_trials(df, F.col("epoch") % 20 == 0, spec=spec).collect():
        out[r.query_key].append((r["rank"], r.key, r.score))
    whole = {k: [int(np.floor(1024 * x)) for x in v] for k, v in rows if k is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    for q in (k for k in whole if k % 20 == 0):
        scores = sorted(((-sum(a * b for a, b in zip(whole[q], v)), k) for k, v in whole.items() if k != q and len(v) == len(whole[q])))[:10]
        assert sorted(out.pop(q, [])) == [(i + 1, k, -s) for i, (s, k) in enumerate(scores)]
    assert not out
    assert neighbours.nearest_trials(df.limit(0), F.lit(True)).count() == 0


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def test_rules_and_mined_verdicts(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/1", "http://example.net/EN/1", "ftp://x.org/fr/a?b=://", "http://notexample.com/de/", "http://example.com/de/x#y",
            "http://net", "http://net/", "://org/fr/", "http://a\nb.org/fr/x\ny?z"]
    urls += [f"http://h{i % 7}.example.net/ads/{i}" for i in range(60)] + [f"https://h{i % 5}.org/fr/news/{i}" for i in range(60)]
    urls += [f"http://other{i}.io/ads/{i}" for i in range(5)] + [f"https://other{i}.io/news/{i}" for i in range(5)]
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)] + [(None, urls[3], "x", 1)], "key bigint, url string, host string, tokens int").repartition(3)
    out = object_rules.judge_objects(df, RULES).collect()
    assert len(out) == len(urls) + 1
    for r in out:
        host, path, rule, verdict = plain_rule(urls[3] if r.key is None else urls[r.key])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if verdict:
            assert r.verdict == verdict
        elif r.host.startswith("other"):
            assert r.verdict == ("block" if "/ads/" in r.path else "allow")
    assert object_rules.judge_objects(df.limit(0), RULES).count() == 0


def test_mined_rules_equal_brute_force(spark):
    pick = random.Random(2)
    baskets = [(sorted(pick.sample("abcdef", pick.randrange(1, 5))), None) for _ in range(200)]
    baskets = [(t, "block" if ("a" in t and "b" in t) or (pick.random() < .1) else "allow") for t, _ in baskets]
    spec = object_rules.RuleSpec(support=0.05, confidence=0.7)
    df = spark.createDataFrame(baskets, "tokens array<string>, verdict string")
    rules = object_rules.mined_rules(df, spec)
    import itertools
    want = {}
    for n in range(1, 5):
        for combo in itertools.combinations("abcdef", n):
            held = [v for t, v in baskets if set(combo) <= set(t)]
            for verdict in ("allow", "block"):
                hits = held.count(verdict)
                if held and hits >= 0.05 * len(baskets) and hits / len(held) >= 0.7:
                    want[combo, verdict] = (hits / len(held), hits / len(baskets))
    kept = {k: c for k, c in want.items() if not any(v == k[1] and set(p) < set(k[0]) and want[p, v][0] >= c[0] for p, v in want)}
    got = {(tuple(r.antecedent), r.verdict): (r.confidence, r.support) for r in rules.collect()}
    assert got.keys() == kept.keys() and all(got[k] == pytest.approx(kept[k]) for k in kept)
    judged = {tuple(r.tokens): r.mined for r in object_rules.judged_by_rules(df, rules, df).collect()}
    for tokens, _ in baskets:
        best = max(((c, s, len(a), " ".join(a), v) for (a, v), (c, s) in kept.items() if set(a) <= set(tokens)), default=None)
        assert judged.get(tuple(tokens)) == (best and best[-1])


def test_object_rules_run_no_python(spark):
    df = spark.createDataFrame([(1, "http://a.net/x")], "key bigint, url string")
    plan = object_rules.judge_objects(df, RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def shared_by_brute_force(rows, least=50):
    seen, want = {}, set()
    for row, (_, text) in enumerate(rows):
        w = [x.lower() for x in WORD.findall(text or "")]
        for i in range(len(w) - least + 1):
            run = tuple(w[i:i + least])
            other = seen.setdefault(run, row)
            if other != row:
                want |= {other, row}
    return want


def test_shared_passages(sidecars, words_of):
    passage, near = words_of(60, 1, 9999), words_of(90, 2, 9999)
    changed = list(near)
    changed[45] = "edited"
    short = words_of(48, 3, 9999)
    rows = [(10, " ".join(words_of(80, 11, 9999) + passage + words_of(40, 12, 9999))), (3, " ".join(passage + words_of(100, 13, 9999))),
            (7, " ".join(words_of(30, 14, 9999) + near)), (8, " ".join(words_of(200, 15, 9999) + changed)),
            (20, " ".join(words_of(90, 16, 9999) + short)), (21, " ".join(short + words_of(90, 17, 9999))),
            (30, " ".join(words_of(300, 18, 9999))), (40, None), (41, ""), (42, "few words"), (50, " ".join(words_of(55, 19, 9999))),
            (51, " ".join(words_of(55, 19, 9999))), (52, "few words"), (None, " ".join(words_of(70, 20, 9999) + passage))]
    out = {r.key: r for r in passages.shared_passages(sidecars(rows)).collect()}
    assert set(out) == {10, 3, None, 7, 8, 50, 51} and shared_by_brute_force(rows) <= {i for i, r in enumerate(rows) if r[0] in out}
    assert {out[k].class_key for k in (10, 3, None)} == {3} and {out[k].class_key for k in (7, 8)} == {7}
    assert [tuple(s) for s in out[10].spans] == [(80, 140)] and [tuple(s) for s in out[3].spans] == [(0, 60)]
    assert out[50].class_key == out[51].class_key == 50 and out[50].n_words == 55
    assert passages.shared_passages(sidecars(rows).limit(0)).count() == 0


def test_compact_windows_are_wide_tree_nodes():
    pick = np.random.default_rng(3)
    for n in (5, 46, 47, 200, 1000):
        x = pick.permutation(n).astype(np.uint64)
        want = []
        for c in range(n):
            left, right = c, c
            while left > 0 and x[left - 1] > x[c]:
                left -= 1
            while right < n - 1 and x[right + 1] > x[c]:
                right += 1
            if right - left + 1 >= 46:
                want.append((c, max(left, c - 45), min(right, c + 45)))
        got = list(zip(*(a.tolist() for a in passages.compact_windows(x, 46))))
        assert sorted(got) == sorted(want)


def test_contamination(sidecars, spark, words_of):
    items = [(i, " ".join(words_of(15 + i % 60, 100 + i, 700)), None) for i in range(80)]
    items += [(80, " ".join(words_of(300, 190, 700)), None), (81, "", None), (82, None, None), (None, "a b c d e f", None), (83, "one two three", None),
              (84, "what is the capital city of that far country", "blue river town"), items[0]]
    other = lambda n, seed: words_of(n, seed, 700)
    texts, want = [], set()
    for i in range(60):
        k = i % 81
        w = other(40 * i, 500 + i)
        if i % 2 and items[k][1]:
            at = (i * 37) % (len(w) + 1)
            w = w[:at] + items[k][1].split() + w[at:]
            want.add((i, k))
        texts.append((i, " ".join(w)))
    texts += [(900, None), (901, ""), (902, "x " * 5), (903, " ".join(other(150, 9) + items[80][1].split() + other(90, 8))),
              (904, "so what is the capital city of that far country then it is blue river town"), (905, "what is the capital city of that far country"), texts[1]]
    want |= {(903, 80), (904, 84)}
    table = spark.createDataFrame([(*r, 1) for r in items], "item bigint, question string, answer string, overlap int")
    out = cm.contaminated(sidecars(texts), table).collect()
    assert {(r.key, r["item"]) for r in out} == want
    assert sum(r.key == 1 for r in out) == 2 and all(r.overlap >= 0.8 for r in out)
    small = cm.contaminated(sidecars(texts), table, spec=cm.MatchSpec(shard=30)).collect()
    assert {(r.key, r["item"]) for r in small} == want
    assert cm.contaminated(sidecars(texts).limit(0), table).count() == 0 and cm.contaminated(sidecars(texts), table.limit(0)).count() == 0


def test_wand_finds_all_above_the_threshold(words_of):
    rows = [(i, " ".join(words_of(20 + i % 30, i, 120)), None) for i in range(60)]
    spec = cm.MatchSpec(block=3)
    frequency = collections.Counter(t for r in rows for t in np.unique(cm.word_hashes(r[1])).tolist())
    index = cm.ItemIndex(rows, spec, 60, 35.0, frequency)
    for seed in range(150):
        w = words_of(60, 1000 + seed, 120) + (rows[seed % 60][1].split() if seed % 3 == 0 else [])
        window = np.unique(cm.word_hashes(" ".join(w)))
        at = np.searchsorted(index.terms, window)
        at[at == len(index.terms)] = 0
        terms = at[index.terms[at] == window].tolist()
        scores = collections.Counter()
        for t in terms:
            for i, s in zip(index.lists[t].items, index.lists[t].scores):
                scores[i] += s
        assert sorted(index.search(terms)) == sorted(i for i, s in scores.items() if s >= index.needed[i] - 1e-6)


def test_contamination_of_partial_and_short_items(sidecars, spark, words_of):
    """Against every item: of items cut, changed and with words put in, those that keep 0.8 of their shingles are all found."""
    import random
    pick = random.Random(8)
    items, texts = {}, []
    for i in range(150):
        # Common words and three rare ones at the end, which are the first to go.
        items[i] = [f"c{pick.randrange(30)}" for _ in range(pick.randrange(8, 60))] + [f"rare{i}x{j}" for j in range(3)]
    items |= {200: ["capital", "city", "berlin"], 201: ["c1"] * 12, 202: words_of(200, 3, 50)}
    for i, item in items.items():
        for kind in range(4):
            w = list(item)
            if kind == 1:
                w = w[:-3]
            elif kind == 2:
                w[pick.randrange(len(w))] = "changed"
            elif kind == 3:
                w.insert(pick.randrange(len(w)), "added")
            texts.append((i * 10 + kind, " ".join(words_of(pick.randrange(200), i * 10 + kind, 5000) + w + words_of(50, i, 5000))))
    texts.append((9999, "we think the Capital City Berlin is fine today"))

    def runs(w, size):
        return {tuple(w[k:k + size]) for k in range(len(w) - size + 1)}

    want, size = set(), {i: min(len(q), 5) for i, q in items.items()}
    held = {i: runs(q, size[i]) for i, q in items.items()}
    for key, text in texts:
        w = text.lower().split()
        of = {3: runs(w, 3), 5: runs(w, 5)}
        want |= {(key, i) for i, q in held.items() if len(q & of[size[i]]) >= 0.8 * len(q)}
    table = spark.createDataFrame([(i, " ".join(q), None) for i, q in items.items()], "item bigint, question string, answer string")
    for spec in (cm.MatchSpec(), cm.MatchSpec(shard=20), cm.MatchSpec(shard_bytes=3000)):
        got = {(r.key, r["item"]) for r in cm.contaminated(sidecars(texts), table, spec=spec).collect()}
        assert got == want
    assert len(want) > 300 and (9999, 200) in want
