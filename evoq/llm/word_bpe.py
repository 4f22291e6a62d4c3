"""Byte-pair encoding of sidecar texts by one depth-first walk over the trie of their distinct words, and decoding."""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoq.llm import words

# Text encoded at once, and bounds in bytes of each generation of what a worker remembers; an entry's objects take some 350 bytes.
BLOCK = 2 << 20
WORD_BYTES, PIECE_BYTES, ENTRY_BYTES = 16 << 20, 40 << 20, 350


class LastTokens:
    """Merge rules seen through last tokens.

    The encoding of a prefix ends in one token, and what is before it is the encoding of the shorter prefix. So a
    trie node needs only its last token: of the vocabulary tokens that end there, the longest that may follow the last
    token of the prefix before it.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], word_end: str):
        self.vocabulary, self.word_end = vocabulary, word_end
        self.rank = {pair: i for i, pair in enumerate(merges)}
        # By their last three letters, how long tokens are at most: those within a word, and those that end one.
        self.reach: tuple[dict[str, int], dict[str, int]] = ({}, {})
        for token in vocabulary:
            final = token.endswith(word_end) and len(token) > len(word_end)
            body = token[:-len(word_end)] if final else token
            if len(body) > 2:
                self.reach[final][body[-3:]] = max(len(body), self.reach[final].get(body[-3:], 0))
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.edges: dict[str, tuple[list, list]] = {}
        self.follows: dict[tuple[str, str], bool] = {}

    def symbols(self, token: str) -> list[str]:
        end = self.word_end
        if token.endswith(end) and len(token) > len(end):
            return [*token[:-len(end) - 1], token[-len(end) - 1:]]
        return list(token)

    def merged(self, symbols: list[str]) -> tuple[list[str], tuple[str, str] | None]:
        """The plain procedure, merging by rank, leftmost first, and the last merge made. Used for single tokens only."""
        last = None
        while len(symbols) > 1:
            at = min(range(len(symbols) - 1), key=lambda i: (self.rank.get((symbols[i], symbols[i + 1]), 1 << 60), i))
            if (symbols[at], symbols[at + 1]) not in self.rank:
                break
            last = symbols[at], symbols[at + 1]
            symbols = symbols[:at] + [symbols[at] + symbols[at + 1]] + symbols[at + 2:]
        return symbols, last

    def whole(self, token: str) -> bool:
        """Whether the merge rules make the token of its own characters; notes the two halves of its last merge."""
        if token not in self.halves:
            parts, last = self.merged(self.symbols(token))
            self.halves[token] = last if len(parts) == 1 else None
            if len(parts) == 1 and last is None:
                self.halves[token] = ("", "")
        return self.halves[token] is not None

    def sides(self, token: str) -> tuple[list, list]:
        """Tokens at the left and at the right edge while the token is built, each with the rank that absorbs it."""
        found = self.edges.get(token)
        if found is None:
            found = ([], [])
            for side in (0, 1):
                t, absorbed = token, 1 << 60
                while t and self.whole(t):
                    found[side].append((t, absorbed))
                    half = self.halves[t]
                    if not half[0]:
                        break
                    t, absorbed = half[side], self.rank[half]
            self.edges[token] = found
        return found

    def may_follow(self, before: str, token: str) -> bool:
        """Whether the two stay apart: no merge over their border comes up before either side has moved on. Where ranks
        are equal the left merge goes first."""
        pair = (before, token)
        found = self.follows.get(pair)
        if found is None:
            if len(self.follows) > 100_000:
                self.follows.clear()
            rank, found = self.rank, True
            for x, x_gone in self.sides(before)[1]:
                for y, y_gone in self.sides(token)[0]:
                    r = rank.get((x, y))
                    if r is not None and r < x_gone and r <= y_gone:
                        found = False
            self.follows[pair] = found
        return found


def encode_words(pieces: list[str], rules: LastTokens) -> dict[str, list[str]]:
    """Tokens of distinct words. In sorted order the words are a depth-first walk over their trie: the states of the
    characters that a word shares with the one before it are still on the path and are not computed again."""
    vocabulary, halves, follows, (within, final), end = rules.vocabulary, rules.halves, rules.follows, rules.reach, rules.word_end
    whole, may_follow, out = rules.whole, rules.may_follow, {}
    path, before, cut = [""], "", len(end)
    for word in sorted(pieces):
        shared, size = min(len(path) - 1, len(word)), len(word)
        while word[:shared] != before[:shared]:
            shared -= 1
        del path[shared + 1:]
        for n in range(shared + 1, size + 1):
            last = n == size
            # Other tokens are of two letters at most.
            longest = (final if last else within).get(word[n - 3:n], 2) if n > 2 else n
            for at in range(n - longest if n > longest else 0, n):
                token = word[at:] + end if last else word[at:n]
                if token in vocabulary and (halves.get(token) or whole(token)):
                    if not at:
                        break
                    ok = follows.get((path[at], token))
                    if may_follow(path[at], token) if ok is None else ok:
                        break
            else:
                raise ValueError(f"the vocabulary lacks {word[n - 1:n]!r}")
            if not last:
                path.append(token)
        tokens = [token]
        n = size - len(token) + cut
        while n > 0:
            token = path[n]
            tokens.append(token)
            n -= len(token)
        tokens.reverse()
        out[word] = tokens
        before = word
    return out


class WordEncoder:
    """Token ids of white-space separated words of a tokenizer file with word ends."""

    def __init__(self, model: str, decoded: bool = True, part: float = 1.0):
        from tokenizers import Tokenizer

        spec = json.loads(model)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rules = LastTokens(spec["model"]["vocab"], merges, spec["model"]["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.letters_only = any(t.isalpha() for t in self.special)  # such a token could hide in a word of letters
        # Only its normalizer and splitter are used, so the library need not hold the vocabulary.
        bare = {**spec, "added_tokens": [], "model": {**spec["model"], "vocab": {}, "merges": []}}
        library = Tokenizer.from_str(json.dumps(bare))
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        # The splitting rule of the file for printable ASCII, where it needs no Unicode classes.
        self.ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
        self.decoded = decoded
        self.words, self.known = Remembered(int(part * WORD_BYTES)), Remembered(int(part * PIECE_BYTES))

    def pieces(self, word: str) -> list[str | tuple[str]]:
        """Pieces of a word in the letters of the vocabulary; a special token is a tuple of it."""
        if word.isascii():
            if word.isalpha() and not self.letters_only:
                return [word.lower()]
            if word.isprintable() and not any(t in word for t in self.special):
                return self.ascii.findall(word.lower())
        out = []
        for part in self.split_special.split(word) if self.split_special else [word]:
            if part in self.special:
                out.append((part,))
            elif part:
                out += [p for p, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part))]
        return out

    def learn(self, seen: list[str]) -> dict[str, tuple[int, str, str]]:
        """Number of tokens, ids and tokens (each joined by spaces) of words; words and pieces used of late are remembered. The tokens are
        empty if no decoding is wanted."""
        fresh = self.words.missing(seen)
        split = {w: self.pieces(w) for w in fresh}
        every = {p for parts in split.values() for p in parts if type(p) is str}
        ids, decoded = self.rules.vocabulary, self.decoded
        for p, tokens in encode_words(self.known.missing(every), self.rules).items():
            self.known.add(p, (1, str(ids[tokens[0]]), tokens[0] if decoded else "") if len(tokens) == 1 else
                           (len(tokens), " ".join([str(ids[t]) for t in tokens]), " ".join(tokens) if decoded else ""))
        known = self.known.now
        for w, parts in split.items():
            found = [known[p] if type(p) is str else (1, str(self.special[p[0]]), p[0] if decoded else "") for p in parts]
            self.words.add(w, found[0] if len(found) == 1 else
                           (sum([f[0] for f in found]), " ".join([f[1] for f in found]), " ".join([f[2] for f in found]) if decoded else ""))
        return self.words.now


class Remembered:
    """Encodings by word, in two generations of about ``size`` bytes: what is not asked for during one goes with the next."""

    def __init__(self, size: int):
        self.size, self.held = size, 0
        self.now: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}

    def missing(self, keys) -> list[str]:
        """The keys that are not held; the others are in ``now`` afterwards."""
        if self.held > self.size:
            self.older, self.now, self.held = self.now, {}, 0
        now, older, out = self.now, self.older, []
        for key in keys:
            if key not in now:
                found = older.get(key)
                if found is None:
                    out.append(key)
                else:
                    self.add(key, found)
        return out

    def add(self, key: str, found: tuple[int, str, str]) -> None:
        self.now[key] = found
        self.held += ENTRY_BYTES + len(key) + len(found[1]) + len(found[2])


def _blocks_of_words(column: pa.Array, block: int = BLOCK) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """First row, words and where each row's words end, so many rows at a time that they hold ``block`` bytes or are one row. The words
    are between the library's ASCII white space, which is that of the operator; empty ones are left for the caller."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        before = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, before + block, "right")), first + 1)
        lists = pc.ascii_split_whitespace(pc.fill_null(column.slice(first, last - first), "").cast(pa.large_string()))
        yield first, lists.flatten(), np.cumsum(np.concatenate(([0], lists.value_lengths().to_numpy())))
        first = last


def encode_texts(sidecars: DataFrame, model: str, key: str = "key", content: str = "content", decoded: bool = True,
                 part: float = 1.0) -> DataFrame:
    """One row per sidecar text: ``key, n_tokens, ids, decoded``; the last only if ``decoded``. ``part``: a worker remembers that part
    of the usual bytes of words and encodes so much less at once, for sessions with little memory; results are the same.

    ``model`` is the text of a public tokenizer file (BPE with word ends, white space dropped). ``ids`` holds the decimal token
    ids joined by one space, ``decoded`` the decoded text, as the tokenizer's library makes them without adding special
    tokens: this kind of file has no decoder, so tokens are joined by one space. Special tokens that a text holds are
    kept whole, as there.

    A null or empty text has no token. Every row gives one row, repeated ones included; other columns are ignored.
    """
    kind = sidecars.schema[key].dataType.simpleString()

    wanted, block = 3 if decoded else 2, max(1, int(part * BLOCK))

    def run(batches):
        # The caches are large and hold no cycles: what earlier tasks left in the worker is collected before and after.
        gc.collect()
        gc.disable()
        try:
            yield from encoded_rows(batches)
        finally:
            gc.enable()

    def encoded_rows(batches):
        encoder = None
        for batch in batches:
            encoder = encoder or WordEncoder(model, decoded, part)
            for first, found, ends in _blocks_of_words(batch.column(1), block):
                distinct = found.dictionary_encode()
                seen, at = distinct.dictionary.to_pylist(), distinct.indices.to_numpy()
                known = encoder.learn([w for w in seen if w])
                each = [known[w] if w else (0, "", "") for w in seen]
                sizes = np.array([e[0] for e in each], np.int64)[at]
                counts, full = np.concatenate(([0], np.cumsum(sizes))), sizes > 0
                offsets = pa.array(np.concatenate(([0], np.cumsum(full)))[ends], pa.int32())
                at = pa.array(at[full])
                joined = [pc.binary_join(pa.ListArray.from_arrays(offsets, pa.array([e[i] for e in each], pa.string()).take(at)), " ")
                          for i in range(1, wanted)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(ends) - 1), pa.array(counts[ends[1:]] - counts[ends[:-1]]),
                     *joined], ["key", "n_tokens", "ids", "decoded"][:wanted + 1])

    return sidecars.select(F.col(key).alias("key"), F.col(content).cast("string").alias("content")) \
        .mapInArrow(words.giving_back(run), f"key {kind}, n_tokens bigint, ids string" + ", decoded string" * decoded)
