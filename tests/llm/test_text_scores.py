import collections
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evoq.llm import context_tree as ct
from evoq.llm import language, packing, word_bpe, words
from evoq.llm.queries import tokenizer_file

WORD = re.compile("[^\x20\x09-\x0D]+")
TEXTS = ["Hello World it's", "", None, "<|endoftext|>x <|ENDOFTEXT|> ΣΑΣ İ 日本 é 12 a\x1cb c", "don't WE'LL ... !!??",
         "supercalifragilistic " * 50, "🎉👩‍👧 ½ Ⅷ é"]


def test_word_bpe_equals_the_library(sidecars):
    from tokenizers import Tokenizer

    model = tokenizer_file("word_bpe_49k.json")
    library = Tokenizer.from_str(model)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (None, "null key")]
    got = sorted(((r.key, r.n_tokens, r.ids, r.decoded) for r in word_bpe.encode_texts(sidecars(rows), model).collect()), key=repr)
    want = []
    for key, text in rows:
        e = library.encode(text or "", add_special_tokens=False)
        want.append((key, len(e.ids), " ".join(map(str, e.ids)), library.decode(e.ids, skip_special_tokens=False)))
    assert got == sorted(want, key=repr)
    assert word_bpe.encode_texts(sidecars(rows).limit(0), model).count() == 0


def test_last_tokens_follow_the_merges():
    merges = [("a", "b"), ("ab", "c</w>"), ("b", "c"), ("a", "a"), ("bc", "a"), ("aa", "ab")]
    letters = [x + e for x in "abc" for e in ("", "</w>")]
    vocabulary = {t: i for i, t in enumerate(letters + [x + y for x, y in merges])}
    rules = word_bpe.LastTokens(vocabulary, merges, "</w>")
    every = [""]
    for _ in range(6):
        every = [w + c for w in every for c in "abc"] + every
    pieces = sorted({w for w in every if w})[:1500]
    got = word_bpe.encode_words(pieces, rules)
    assert all(got[w] == rules.merged(rules.symbols(w + "</w>"))[0] for w in pieces)


def test_packing_is_lossless(sidecars):
    pattern, ranks = public_tokenizers.PATTERN, tokenizer_file("byte_bpe_50k.tiktoken")
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(i, "word " * (i * 7 % 90)) for i in range(20, 60)]
    spec = packing.PackSpec(length=64, pool=500)
    packed = packing.pack_texts(sidecars(rows), ranks, pattern, 50256, spec=spec).cache()
    pieces = collections.defaultdict(list)
    for r in packing.unpack(packed).collect():
        pieces[r.key].append((r.offset, r.ids))
    coder = packing.TokenIds(ranks, pattern)
    for key, text in rows:
        assert [t for _, ids in sorted(pieces[key]) for t in ids] == coder.encoding.encode_ordinary(text or "") + [50256]
    for r in packed.collect():
        position = np.frombuffer(r["positions"], "<u4")
        assert r.n_tokens <= 64 and r.ends[-1] == r.n_tokens == len(position) == len(r.ids) // 4
        assert [int(p) for p in position[[0, *r.ends[:-1]]]] == [0] * len(r.ends)
    assert len({r.pack for r in packed.collect()}) == packed.count()
    assert packing.pack_texts(sidecars(rows).limit(0), ranks, pattern, 50256).count() == 0


def test_long_runs_of_white_space(sidecars):
    ranks, space = tokenizer_file("byte_bpe_50k.tiktoken"), " " * 120_000
    coder = packing.TokenIds(ranks, public_tokenizers.PATTERN)
    for text in ("a" + space + "b", "a" + space, space + "!", "a" + space + "\nb", "é\u2003" + space + "\t9 b" + space, "a" + space + "\x1c" + space + "b", space):
        assert coder.text_ids(text) == coder.encoding.encode_ordinary(text)
    text = "a" + " " * 1_000_000 + "b"
    packed = packing.pack_texts(sidecars([(1, text)]), ranks, public_tokenizers.PATTERN, 50256)
    ids = [i for r in sorted(packing.unpack(packed).collect(), key=lambda r: r.offset) for i in r.ids]
    assert ids[-1] == 50256 and coder.encoding.decode(ids[:-1]) == text


def test_best_fit_is_that_of_the_plain_search():
    pick = np.random.default_rng(4)
    for _ in range(20):
        sizes = pick.integers(1, 65, 200)
        place, rows = packing.best_fit(sizes, 64)
        room, want = [], {}
        for i in np.argsort(-sizes, kind="stable"):
            fits = [r for r in range(len(room)) if room[r] >= sizes[i]]
            if not fits:
                room.append(64)
                fits = [len(room) - 1]
            best = min(room[r] for r in fits)
            chosen = [r for r in fits if room[r] == best]
            room[chosen[0]] -= sizes[i]
            want[i] = best
        assert rows == len(room) and (np.bincount(place, sizes, rows) <= 64).all()


def test_language(sidecars, spark):
    lines = {"en": "the house and the old garden with some trees", "de": "das Haus und der alte Garten mit einigen Bäumen",
             "fr": "la maison et le vieux jardin avec quelques arbres"}
    rows = [(i, " ".join(np.random.default_rng(i).permutation(lines[k].split())[:6]), "ds1", k) for i in range(240) for k in [sorted(lines)[i % 3]]]
    rows += [(1000, None, "ds1", "en"), (1001, "12 34 !", "ds1", None), (1002, "", "ds1", "de"), (None, "the old house", "ds1", None), (3, rows[3][1], "ds1", rows[3][3])]
    df = sidecars(rows)
    out = language.identify_language(df, held_out=F.crc32(F.col("key").cast("string")) % 4 == 2).collect()
    truth = {r[0]: r[3] for r in rows[:240]}
    held = [r for r in out if r.held_out and r.key is not None and r.key < 240]
    assert all(r.held_out == (zlib.crc32(str(r.key).encode()) % 4 == 2) for r in out if r.key is not None)
    assert sum(r.lang_pred == truth[r.key] for r in held) / len(held) > 0.95
    assert {(r.lang_pred, r.score, r.accepted) for r in out if r.key in (1000, 1001, 1002)} == {("und", 0.0, False)}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert sum(not r.accepted for r in out) <= 3 + 3
    assert {r.lang_pred for r in language.identify_language(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify_language(df.limit(0)).count() == 0


def brute_tree(train, depth):
    """Counts and weighted probabilities of the whole tree, straight from the definition."""
    counts = collections.defaultdict(lambda: [0, 0])
    for data in train:
        for i, byte in enumerate(data):
            for d in range(depth + 1):
                context = tuple(data[j] if j >= 0 else 0 for j in range(i - d, i))
                for bit in range(8):
                    counts[context, (1 << bit) | (byte >> (8 - bit))][(byte >> (7 - bit)) & 1] += 1

    def kt(a, b):
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weighted, below = {}, collections.defaultdict(float)
    for d in range(depth, -1, -1):
        for (context, prefix), (a, b) in counts.items():
            if len(context) == d:
                own = kt(a, b)
                weighted[context, prefix] = own if d == depth else math.log(.5) + np.logaddexp(own, below[context, prefix])
                if d:
                    below[context[1:], prefix] += weighted[context, prefix]

    def chance(context, prefix, bit):
        mixed, seen = .5, False
        for d in range(depth, -1, -1):
            node = (context[len(context) - d:], prefix)
            if node in counts:
                a, b = counts[node]
                p = (b + .5) / (a + b + 1)
                own = 1.0 if d == depth else 1 / (1 + math.exp(below[node] - kt(a, b)))
                mixed, seen = (own * p + (1 - own) * mixed if seen else p), True
        return mixed if bit else 1 - mixed
    return chance


def test_context_tree_equals_the_definition(sidecars, words_of):
    rows = [(i, " ".join(words_of(12, i, 6)) + ("  X\n" if i % 2 else "")) for i in range(30)] + [(50, None), (51, ""), (None, "w1 w1"), (3, "w2 zz")]
    held = F.coalesce(F.crc32(F.col("key").cast("string")) % 7 == 2, F.lit(False))
    spec = ct.TreeSpec(depth=2, slots=22, head=3)
    out = {(r.key, r.n_tokens, r.n_known): r for r in ct.tree_scores(sidecars(rows), held_out=held, spec=spec).collect()}
    lower = lambda t: [w.lower() for w in WORD.findall(t or "")]
    is_held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    train = [lower(t) for k, t in rows if not is_held(k)]
    counts = collections.Counter(w for t in train for w in t)
    counts["\n"] = len(train)
    total, distinct = sum(counts.values()), len(counts)
    chance = brute_tree([(" ".join(t) + "\n").encode() for t in train], 2)
    for key, text in rows:
        tokens = lower(text) + ["\n"]
        r = out[key, len(tokens), sum(counts[t] > 0 for t in tokens)]
        assert r.train_tokens == total and r.held_out == is_held(key)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens))
        data, want = (" ".join(lower(text)) + "\n").encode(), 0.0
        for i, byte in enumerate(data):
            context = tuple(data[j] if j >= 0 else 0 for j in (i - 2, i - 1))
            for bit in range(8):
                want += math.log10(chance(context, (1 << bit) | (byte >> (8 - bit)), (byte >> (7 - bit)) & 1))
        assert r.score == pytest.approx(want, rel=1e-4)
    assert ct.tree_scores(sidecars(rows).limit(0)).count() == 0


def test_chances_of_all_bytes_sum_to_one(spark, sidecars):
    spec = ct.TreeSpec(depth=2, slots=20)
    counts = ct.corpus_counts(sidecars([(1, "abra cadabra abra")]), "content", F.lit(True), 2).where("kind = 1").groupBy("item").agg(F.sum("n").alias("n"))
    one, own = ct.model_table(ct.tree_nodes(counts, 2), spec)
    for context in (b"ab", b"zz", b"\0\0"):
        keys = np.array([(context[0] << 16) | (context[1] << 8) | b for b in range(256)], np.uint64)
        assert (10 ** ct.gram_scores(keys, one, own, 2, 20)).sum() == pytest.approx(1, abs=1e-6)


def test_token_bytes():
    block = next(words.blocks_of_words(pa.array(["  A b ", "", None, "c"])))
    data, begins = ct.token_bytes(block)
    assert data.tobytes() == b"a b\n\n\nc\n" and begins.tolist() == [0, 4, 5, 6, 8]


def test_word_bpe_of_long_texts_and_words(sidecars, monkeypatch):
    """A very long word, a very long text, white space at the ends, and caches that hold next to nothing."""
    from tokenizers import Tokenizer

    model = tokenizer_file("word_bpe_49k.json")
    library = Tokenizer.from_str(model)
    texts = ["x" * 20_000 + " end", "  \t\n ", " lead and trail \n", "Some words, again. " * 60_000, "a b c \x1c\x1f d", "<|endoftext|>" * 3 + " x"]
    rows = list(enumerate(texts))
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in rows}
    for words_held in (word_bpe.WORD_BYTES, 1):
        monkeypatch.setattr(word_bpe, "WORD_BYTES", words_held)
        monkeypatch.setattr(word_bpe, "PIECE_BYTES", words_held)
        got = {r.key: (r.n_tokens, r.ids, r.decoded) for r in word_bpe.encode_texts(sidecars(rows), model).collect()}
        assert {i: g[:2] for i, g in got.items()} == {i: (len(w), " ".join(map(str, w))) for i, w in want.items()}
        assert {i: g[2] for i, g in got.items()} == {i: library.decode(w, skip_special_tokens=False) for i, w in want.items()}


def test_sample_of_languages_is_bounded(spark, sidecars, words_of):
    spec = language.LanguageSpec(sample=5, rows=400, epochs=1)
    # A key that repeats, with several texts, and more languages than any list holds.
    rows = [(7, f"the repeated text {i % 3}", "d", "aa") for i in range(3000)]
    rows += [(i, " ".join(words_of(5, i)), "d", f"l{i % 201:03d}") for i in range(201 * 4)] + [(10**6 + i, "one more", "d", "aa") for i in range(300)]
    table = sidecars(rows)
    sample = language.training_sample(table, "key", "content", "lang", F.lit(True), spec).collect()
    assert len(sample) == 202 and len({r.lang for r in sample}) == 202
    model = language.fit_language_model(table, "key", "content", "lang", F.lit(True), spec)
    assert len(model.names) == 202 and "l200" in model.names
    few = language.training_sample(table.where("lang = 'aa'"), "key", "content", "lang", F.lit(True), spec).collect()
    assert sorted(r.nth for r in few) == [1, 2, 3, 4, 5]
    short = language.LanguageSpec(sample=5, bytes=1)
    assert language.training_sample(table.where("lang = 'aa'"), "key", "content", "lang", F.lit(True), short).count() == 1


def test_language_of_clashing_columns_and_long_texts(spark, sidecars):
    rows = [(i, ("der die das und nicht " if i % 2 else "the and of with not ") * 9, "d", "de" if i % 2 else "en") for i in range(60)]
    rows += [(100, "der und die " * 100_000, "d", None)]
    table = sidecars(rows).withColumns({"lang_pred": F.lit("x"), "score": F.lit("y"), "accepted": F.lit(1)})
    model = language.fit_language_model(table, "key", "content", "lang", F.lit(True))
    out = language.predict(table, model, "content", language.LanguageSpec())
    assert sorted(out.columns) == sorted(table.columns)
    assert all(r.lang_pred == (r.lang or "de") for r in out.collect())
