"""Passages that sidecar texts share: compact windows meet by their min-hashes, are compared in their groups and verified on the words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoq.llm import store, words
from evoq.session import pin


@dataclass(frozen=True)
class PassageSpec:
    """A passage has at least ``least`` words; tokens are its shingles of ``shingle`` words. ``hashes``: min-hashes; a passage of
    similarity s goes unseen by all of them with chance (1 - s) ** hashes. ``similarity`` is asked of the shingles. A min-hash
    with more than ``block`` windows is compared by pairs of blocks; none of its pairs is left out."""

    least: int = 50
    shingle: int = 5
    hashes: int = 5
    similarity: float = 0.8
    block: int = 1024

    @property
    def width(self) -> int:
        return self.least - self.shingle + 1

    @property
    def needed(self) -> float:
        """Similar ranges of at least ``width`` shingles share this many."""
        return 2 * self.similarity / (1 + self.similarity) * self.width * 0.9


def sliding_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window, by running minima from both sides of blocks of the width."""
    n = len(x)
    pad = np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate([x, pad]).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - width + 1], left[width - 1:n])


def seeded(tokens: np.ndarray, h: int) -> np.ndarray:
    return words.mix(tokens + np.uint64((h + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def compact_windows(tokens: np.ndarray, width: int, valid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``at, left, right`` of the compact windows: the Cartesian tree's nodes that span at least ``width`` tokens.

    A node of the tree over the token hashes is a token and the longest range in which it is the least: all ranges
    within it that hold that token share the min-hash. The nodes that wide are the runs of equal sliding minima. A
    window is cut to the tokens less than ``width`` away from its least one, so it holds all ranges of ``width`` tokens
    with this min-hash; a longer passage is the union of such ranges. Equal tokens side by side count as one node.
    Ranges whose start is not ``valid`` (they would cross into the next text) are left out.
    """
    if len(tokens) < width:
        return (np.zeros(0, np.int64),) * 3
    low = sliding_minima(tokens, width)
    valid = np.ones(len(low), bool) if valid is None else valid[:len(low)]
    change = low[1:] != low[:-1]
    first = np.flatnonzero(np.concatenate([[True], change | ~valid[:-1]]) & valid)
    last = np.flatnonzero(np.concatenate([change | ~valid[1:], [True]]) & valid)
    at = np.empty(len(first), np.int64)
    for k in range(0, len(first), 4096):
        at[k:k + 4096] = first[k:k + 4096] + tokens[first[k:k + 4096, None] + np.arange(width)].argmin(axis=1)
    return at, first, last + width - 1


def _block_shingles(block: words.Words, spec: PassageSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles at every word of a block, the row of every word, and where a passage of the least size may begin."""
    row = np.repeat(np.arange(block.last - block.first), np.diff(block.rows))
    tokens = words.shingles(block.hashes, spec.shingle)
    starts = np.zeros(len(tokens), bool)
    n = len(row) - spec.least + 1
    starts[:n] = row[:n] == row[spec.least - 1:]
    return tokens, row, starts


def block_keys(block: words.Words, spec: PassageSpec) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``key, row, left, right`` of a block's windows for every hash, and the block's shingles, among which the ranges count.

    The key is the min-hash alone: a word put in or left out moves nothing that it depends on.
    """
    if len(block.hashes) < spec.least:
        return
    tokens, row, starts = _block_shingles(block, spec)
    for h in range(spec.hashes):
        hashed = seeded(tokens, h)
        at, left, right = compact_windows(hashed, spec.width, starts)
        yield words.mix(hashed[at] + np.uint64(h + 1)), row[left], left, right, tokens


def keys_held(texts: DataFrame, spec: PassageSpec) -> DataFrame:
    """``value, n``: keys of all windows with how often they occur, summed per block."""
    def run(batches):
        for batch in batches:
            for block in words.blocks_of_words(batch.column(0)):
                found = [key for key, *_ in block_keys(block, spec)]
                if found:
                    values, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], ["value", "n"])

    return texts.select("content").mapInArrow(words.giving_back(run), "value bigint, n bigint")


def shared_windows(texts: DataFrame, wanted: np.ndarray, spec: PassageSpec) -> DataFrame:
    """``value, id, start, stop, body``: windows whose key may be among the wanted ones, with 32 bits of each of their shingles."""
    def run(batches):
        for batch in batches:
            for block in words.blocks_of_words(batch.column(1)):
                for key, row, left, right, tokens in block_keys(block, spec):
                    keep = np.flatnonzero(words.may_hold(wanted, key))
                    for k in range(0, len(keep), 4096):
                        part = keep[k:k + 4096]
                        own, low, sizes = row[part], left[part], right[part] - left[part] + 1
                        ends = np.concatenate([[0], np.cumsum(sizes)])
                        body = (tokens[np.repeat(low - ends[:-1], sizes) + np.arange(ends[-1])] >> np.uint64(32)).astype("<u4")
                        bodies = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(body)])
                        base = block.rows[own]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key[part].view(np.int64)), batch.column(0).take(pa.array(block.first + own)),
                             pa.array((low - base).astype(np.int32)), pa.array((right[part] - base).astype(np.int32)), bodies],
                            ["value", "id", "start", "stop", "body"])

    return texts.select("id", "content").mapInArrow(words.giving_back(run), "value bigint, id bigint, start int, stop int, body binary")


def may_be_dense(has: np.ndarray, spec: PassageSpec) -> np.ndarray:
    """Which rows of flags (a shingle is shared) may hold a similar range, if no shingle repeats: c shared ones of the L of a range
    and of the K of its counterpart need c >= s * (L + K - c), and K is at least c and at least ``width``."""
    n, w = has.shape[1], spec.width
    sums, at = np.concatenate([np.zeros((len(has), 1)), np.cumsum(has, axis=1)], axis=1), np.arange(n + 1)
    out, share = np.ones(len(has), bool), spec.similarity / (1 + spec.similarity)
    for rate, least in ((spec.similarity, 0.0), (share, share * w)):
        rest = sums - rate * at
        out &= (rest[:, w:] - np.minimum.accumulate(rest[:, :n + 1 - w], axis=1) >= least - 1e-6).any(axis=1)
    return out


TABLE_CELLS = 1 << 20  # of a group's table of windows by shingles


def group_links(ids: np.ndarray, bodies: list[np.ndarray], spec: PassageSpec) -> list[tuple[int, int]]:
    """Pairs of windows of one min-hash that hold a verified passage, as far as they tell something new.

    Equal windows are linked to one of them, so that each is linked to one of another text. Of different ones every two
    are compared, unless both are in one class already and neither has a shared shingle outside its verified ranges. A
    window that stands for several of one text alone brings all of them along.
    """
    order = np.argsort(words.mix(ids.view(np.uint64)), kind="stable")
    same_body: dict[bytes, list[int]] = {}
    for k in order.tolist():
        same_body.setdefault(bodies[k].tobytes(), []).append(k)
    out, reps, alone = [], [], []
    for rows in same_body.values():
        other = next((k for k in rows if ids[k] != ids[rows[0]]), None)
        if other is not None:
            out += [(rows[0] if ids[k] != ids[rows[0]] else other, k) for k in rows[1:]]
        reps.append(rows[0])
        alone.append(rows if other is None else rows[:1])
    n = len(reps)
    if n < 2:
        return out
    sizes = np.array([len(bodies[k]) for k in reps])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    codes = np.unique(np.concatenate([bodies[k] for k in reps]), return_inverse=True)[1]
    flags, fresh = np.zeros(int(codes.max()) + 1, np.int32), np.zeros(int(codes.max()) + 1, np.int32)
    own, root, told, spot = ids[reps], np.arange(n), np.zeros(len(codes), bool), np.full(len(flags), -1)
    if n * len(flags) <= TABLE_CELLS:
        # Of a small group a table tells which window holds which shingle, so all its windows are compared at once.
        times = np.bincount(np.repeat(np.arange(n), sizes) * len(flags) + codes, minlength=n * len(flags)).reshape(n, -1)
        holds = (times > 0).astype(np.float32)
        plain, untold = times.max(axis=1) == 1, holds.copy()
        partners = np.triu((holds @ times.T.astype(np.float32) >= spec.needed) & (own[:, None] != own), 1)
        todo = np.flatnonzero(partners.any(axis=1)).tolist()
    else:
        plain = np.array([len(np.unique(codes[x:y])) == y - x for x, y in zip(ends[:-1], ends[1:])])
        holds, todo = None, range(n - 1)
    for i in todo:
        mine = codes[ends[i]:ends[i + 1]]
        if holds is not None:
            others = np.flatnonzero(partners[i])
        else:
            flags[mine] = 1
            there = flags[codes[ends[i + 1]:]]
            shared = np.add.reduceat(there, ends[i + 1:-1] - ends[i + 1])
            others = i + 1 + np.flatnonzero((shared >= spec.needed) & (own[i + 1:] != own[i]))
        if len(others):
            # Of one class, only those with a shared shingle outside the verified ranges, on either side, are looked at again.
            if holds is not None:
                still = (holds[others] @ untold[i] > 0) | (untold[others] @ holds[i] > 0)
            else:
                open_there = np.add.reduceat(there * ~told[ends[i + 1]:], ends[i + 1:-1] - ends[i + 1])[others - i - 1]
                fresh[mine[~told[ends[i]:ends[i + 1]]]] = 1
                open_here = np.add.reduceat(fresh[codes[ends[i + 1]:]], ends[i + 1:-1] - ends[i + 1])[others - i - 1]
                fresh[mine] = 0
                still = (open_there > 0) | (open_here > 0)
            others = others[(root[others] != root[i]) | still]
        if len(others):
            at = np.minimum(ends[others, None] + np.arange(sizes[others].max()), ends[others + 1, None] - 1)
            has = (flags if holds is None else holds[i])[codes[at]] * (np.arange(at.shape[1]) < sizes[others, None])
            others = others[~(plain[others] & plain[i]) | may_be_dense(has, spec)]
        flags[mine] = 0
        for j in others.tolist():
            theirs = codes[ends[j]:ends[j + 1]]
            if root[i] == root[j]:
                # Shared shingles that no verified range holds yet, on either side.
                if holds is not None:
                    new = untold[i] @ holds[j] > 0 or untold[j] @ holds[i] > 0
                else:
                    left, right = mine[~told[ends[i]:ends[i + 1]]], theirs[~told[ends[j]:ends[j + 1]]]
                    fresh[theirs] = 1
                    new = fresh[left].any()
                    fresh[theirs] = 0
                    fresh[mine] = 1
                    new = new or fresh[right].any()
                    fresh[mine] = 0
                if not new:
                    continue
            places = None
            if plain[i] and plain[j]:
                spot[theirs] = np.arange(sizes[j])
                places = spot[mine]
                spot[theirs] = -1
            ranges = common_runs(bodies[reps[i]], bodies[reps[j]], [(0, int(sizes[i]) - 1, 0, int(sizes[j]) - 1)], spec, places)
            if ranges:
                out += [(k, reps[j]) for k in alone[i]] + [(reps[i], k) for k in alone[j][1:]]
                root[root == root[j]] = root[i]
                for x, y, u, v in ranges:
                    told[ends[i] + x:ends[i] + y - spec.shingle + 1] = True
                    told[ends[j] + u:ends[j] + v - spec.shingle + 1] = True
                if holds is not None:
                    for k in (i, j):
                        untold[k] = 0
                        untold[k, codes[ends[k]:ends[k + 1]][~told[ends[k]:ends[k + 1]]]] = 1
    return out


def _group_hits(groups: np.ndarray, ids: np.ndarray, flat: np.ndarray, ends: np.ndarray, spec: PassageSpec) -> tuple[np.ndarray, ...]:
    """Rows of whole groups that are linked, as two arrays, and how much of each row is cut at its head and its tail.

    A window with too few shingles that others of its group have has no partner. Of the others the ends that no other window has
    are cut: what stands around a passage differs, and without it the windows of one passage are equal. A range begins and ends with a
    shared shingle, so what is cut holds none of it. Two windows left in a group go on unverified, as every pair is verified later.
    """
    sizes = np.diff(ends)
    marks = words.mix(np.repeat(groups, sizes).astype(np.uint64) + np.uint64(1)) ^ flat.astype(np.uint64)
    _, back, times = np.unique(marks, return_inverse=True, return_counts=True)
    common = times[back] > 1
    kept = np.flatnonzero(np.add.reduceat(common.astype(np.int64), ends[:-1]) >= spec.needed)
    spots = np.flatnonzero(common)
    head, tail = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    head[kept] = spots[np.searchsorted(spots, ends[kept])] - ends[kept]
    tail[kept] = ends[kept + 1] - 1 - spots[np.searchsorted(spots, ends[kept + 1]) - 1]
    kept = kept[(sizes - head - tail)[kept] >= spec.width]
    cut = np.flatnonzero(np.diff(groups[kept], prepend=-1, append=-1))
    one, two = [], []
    for low, high in zip(cut[:-1].tolist(), cut[1:].tolist()):
        rows = kept[low:high]
        if high - low == 2:
            if ids[rows[0]] != ids[rows[1]]:
                one.append(int(rows[0]))
                two.append(int(rows[1]))
        elif high - low > 2:
            for x, y in group_links(ids[rows], [flat[ends[r] + head[r]:ends[r + 1] - tail[r]] for r in rows], spec):
                one.append(int(rows[x]))
                two.append(int(rows[y]))
    return np.array(one, np.int64), np.array(two, np.int64), head, tail


def window_hits(windows: DataFrame, counts: DataFrame, spec: PassageSpec) -> DataFrame:
    """``a, b, al, ar, bl, br``: pairs of windows of different texts that share a min-hash and pass ``group_links``.

    ``counts`` holds ``value, n``. Windows of a common min-hash are dealt to blocks, and every two blocks are one group.
    """
    hot = pin(counts.where(F.col("n") > spec.block).select("value", F.ceil(F.col("n") / (spec.block / 2)).cast("int").alias("blocks")))
    placed = windows.join(hot, "value", "left").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    others = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("blocks").cast("bigint") - 1), lambda x: x != F.col("block"))
    spread = placed.withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(others))) \
        .select("value", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "start", "stop", "body")
    dealt = spread.repartition("value", "i", "j").sortWithinPartitions("value", "i", "j")

    def hits(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        value, i, j, ids, start, stop = (table.column(c).to_numpy() for c in range(6))
        body = table.column(6).combine_chunks()
        body = body.chunk(0) if isinstance(body, pa.ChunkedArray) else body
        offsets = np.frombuffer(body.buffers()[1], np.int32)[body.offset:body.offset + len(body) + 1].astype(np.int64)
        flat = np.frombuffer(body.buffers()[2], "<u4", int(offsets[-1] - offsets[0]) // 4, int(offsets[0]))
        change = (value[1:] != value[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        one, two, head, tail = _group_hits(np.concatenate([[0], np.cumsum(change)]), ids, flat, (offsets - offsets[0]) // 4, spec)
        start, stop = (start + head).astype(np.int32), (stop - tail).astype(np.int32)
        swap = ids[one] > ids[two]
        a, b = np.where(swap, two, one), np.where(swap, one, two)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[a], ids[b], start[a], stop[a], start[b], stop[b])], ["a", "b", "al", "ar", "bl", "br"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in words.pieces(batches, 2048):
            # The last group may go on in the next batch.
            last = [batch.column(c)[batch.num_rows - 1] for c in range(3)]
            ends = np.flatnonzero(~np.logical_and.reduce([batch.column(c).to_numpy() == last[c].as_py() for c in range(3)]))
            cut = int(ends[-1]) + 1 if len(ends) else 0
            opens = held and any(held[-1].column(c)[held[-1].num_rows - 1] != batch.column(c)[0] for c in range(3))
            if opens and not cut:
                yield hits(pa.Table.from_batches(held))
                held, rows = [], 0
            if cut and rows + cut >= 4096:
                yield hits(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, rows, batch = [], 0, batch.slice(cut)
            held.append(batch)
            rows += batch.num_rows
        if held:
            yield hits(pa.Table.from_batches(held))

    return dealt.select("value", F.coalesce("i", F.lit(0)).cast("bigint").alias("i"), F.coalesce("j", F.lit(0)).cast("bigint").alias("j"), "id", "start", "stop", "body") \
        .mapInArrow(words.giving_back(run), "a bigint, b bigint, al int, ar int, bl int, br int")


def common_runs(a: np.ndarray, b: np.ndarray, hits: list[tuple[int, int, int, int]], spec: PassageSpec,
                places: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """Verified pairs of word ranges (end exclusive) of two texts, from windows ``(a_left, a_right, b_left, b_right)`` that share
    a key. ``places`` may give the ``_places`` of the only window.

    Windows that overlap on both sides are one. Within it the shingles of one side that the other has as well form
    runs; a range grows from the longest run, run by run, as long as the shared share of all its shingles stays at the
    similarity. What is left on both sides of it (or of a run that gives no range) is searched in the same way.
    """
    joined: list[list[int]] = []
    for al, ar, bl, br in sorted(hits):
        for w in joined:
            if al <= w[1] and bl <= w[3] and br >= w[2]:
                w[1], w[2], w[3] = max(w[1], ar), min(w[2], bl), max(w[3], br)
                break
        else:
            joined.append([al, ar, bl, br])
    out: set[tuple[int, int, int, int]] = set()
    todo = [(*w, _places(a[w[0]:w[1] + 1], b[w[2]:w[3] + 1]) if places is None else places) for w in joined]
    while todo:
        al, ar, bl, br, there = todo.pop()
        wa, wb = a[al:ar + 1], b[bl:br + 1]
        if there is not None and len(wa) == len(wb) and (wa == wb).all():
            # Equal windows without a repeated shingle: all of them is the range.
            if len(wa) >= max(spec.width, spec.needed):
                out.add((al, ar + spec.shingle, bl, br + spec.shingle))
            continue
        shared = np.flatnonzero(np.isin(wa, wb) if there is None else there >= 0)
        if len(shared) < spec.needed:
            continue
        found, first, last = _dense_range(wa, wb, shared, spec, there)
        if found:
            x, y, u, v = found
            first, last = x, y
            out.add((al + x, al + y + spec.shingle, bl + u, bl + v + spec.shingle))
        for low, high in ((al, al + first - 1), (al + last + 1, ar)):
            if high - low + 1 >= spec.width // 2:
                todo.append((low, high, bl, br, None if there is None else there[low - al:high - al + 1]))
    return sorted(out)


def _places(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Where each shingle of ``a`` is in ``b``, -1 if nowhere; None if one of them repeats a shingle."""
    order, own = b.argsort(), np.sort(a)
    held = b[order]
    if (own[1:] == own[:-1]).any() or (held[1:] == held[:-1]).any():
        return None
    at = order[np.minimum(held.searchsorted(a), len(b) - 1)] if len(b) else np.zeros(len(a), np.int64)
    return np.where(b[at] == a, at, -1) if len(b) else at - 1


def runs_both_ways(a: np.ndarray, b: np.ndarray, hits: list[tuple[int, int, int, int]], spec: PassageSpec) -> list[tuple[int, int, int, int]]:
    """``common_runs`` from either text: a range has one counterpart, though the other text may hold it many times."""
    def found(one, two, some):
        return common_runs(one, two, some, spec) or [x for r in some for x in common_runs(one, two, [r], spec)]

    back = found(b, a, [(bl, br, al, ar) for al, ar, bl, br in hits])
    return sorted({*found(a, b, hits), *((x, y, u, v) for u, v, x, y in back)})


def _dense_range(wa, wb, shared, spec: PassageSpec, there: np.ndarray | None = None) -> tuple[tuple[int, int, int, int] | None, int, int]:
    """A range of ``wa`` grown from the longest run of ``shared`` places that, with its counterpart in ``wb``, is similar and long
    enough, or None; and the longest run. ``there`` holds the places in ``wb`` if neither side repeats a shingle: each shared one then
    counts once, and no sets are made."""
    cut = np.flatnonzero(np.diff(shared) > 1)
    begins, ends = shared[np.concatenate([[0], cut + 1])], shared[np.concatenate([cut, [len(shared) - 1]])]
    sizes = ends - begins + 1
    first = last = int(sizes.argmax())
    run = int(begins[first]), int(ends[first])

    def measure(i: int, j: int):
        x, y = int(begins[i]), int(ends[j])
        if there is None:
            places = np.flatnonzero(np.isin(wb, wa[x:y + 1]))
        else:
            places = there[x:y + 1]
            places = np.sort(places[places >= 0])
        if not len(places):
            return None
        # The counterpart is the part of the other side around the middle of its shared places.
        middle = int(places[len(places) // 2])
        near = places[np.abs(places - middle) <= (y - x + 1)]
        u, v = int(near[0]), int(near[-1])
        if there is not None:
            return len(near) / (y - x + v - u + 2 - len(near)), x, y, u, v
        one, two = np.unique(wa[x:y + 1]), np.unique(wb[u:v + 1])
        both = len(np.intersect1d(one, two, assume_unique=True))
        return both / (len(one) + len(two) - both), x, y, u, v

    best = measure(first, last)
    while True:
        steps = []
        if first > 0:
            steps.append((int(begins[first] - ends[first - 1]), first - 1, last))
        if last < len(begins) - 1:
            steps.append((int(begins[last + 1] - ends[last]), first, last + 1))
        grown = False
        for _, i, j in sorted(steps):
            wider = measure(i, j)
            if wider and wider[0] >= spec.similarity:
                first, last, best, grown = i, j, wider, True
                break
        if not grown:
            break
    if best and best[0] >= spec.similarity and min(best[2] - best[1], best[4] - best[3]) + spec.shingle >= spec.least:
        return best[1:], *run
    return None, *run


HITS = "array<struct<al: int, ar: int, bl: int, br: int>>"


def _window_tokens(pairs: DataFrame, spec: PassageSpec) -> DataFrame:
    """``a, b, hits, tokens``: of the first text only the shingles in the windows of its hits go on, one range after another."""
    def run(batches):
        last, tokens = None, np.zeros(0, np.uint64)
        for batch in words.pieces(batches, 512):
            out, ids = [], batch.column(0).to_pylist()
            for i, hits in enumerate(batch.column(2).to_pylist()):
                if ids[i] != last:  # the join gives the rows of a text one after another
                    last = ids[i]
                    tokens = words.shingles(next(words.blocks_of_words(batch.column(3).slice(i, 1))).hashes, spec.shingle)
                out.append(b"".join(tokens[a:b + 1].tobytes() for a, b in _ranges(hits)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], ["a", "b", "hits", "tokens"])

    return pairs.select("a", "b", "hits", "text_a").mapInArrow(words.giving_back(run), f"a bigint, b bigint, hits {HITS}, tokens binary")


def _ranges(hits: list[dict]) -> list[tuple[int, int]]:
    """Joined ranges of the hits' windows in the first text."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((h["al"], h["ar"]) for h in hits):
        if out and a <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def _verified(pairs: DataFrame, spec: PassageSpec) -> DataFrame:
    """``a, b, hits, tokens, text_b`` to ``a, b, spans_a, spans_b``: verified ranges of words."""
    spans = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches):
        last, b = None, np.zeros(0, np.uint64)
        for batch in words.pieces(batches, 512):
            keep, left, right = [], [], []
            all_hits = batch.column(2).to_pylist()
            for i in range(batch.num_rows):
                hits, raw = all_hits[i], np.frombuffer(batch.column(3)[i].as_py(), np.uint64)
                a, at = np.zeros(max(h["ar"] for h in hits) + 1, np.uint64), 0
                for low, high in _ranges(hits):
                    a[low:high + 1] = raw[at:at + high - low + 1]
                    at += high - low + 1
                if batch.column(1)[i] != last:  # the join gives the rows of a text one after another
                    last = batch.column(1)[i]
                    b = words.shingles(next(words.blocks_of_words(batch.column(4).slice(i, 1))).hashes, spec.shingle)
                ranges = [(h["al"], h["ar"], h["bl"], h["br"]) for h in hits]
                found = runs_both_ways(a, b, ranges, spec)
                if found:
                    keep.append(i)
                    left.append([{"start": x, "stop": y} for x, y in sorted({f[:2] for f in found})])
                    right.append([{"start": u, "stop": v} for u, v in sorted({f[2:] for f in found})])
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(left, spans), pa.array(right, spans)],
                                             ["a", "b", "spans_a", "spans_b"])

    kind = "array<struct<start: int, stop: int>>"
    return pairs.select("a", "b", "hits", "tokens", "text_b").mapInArrow(words.giving_back(run), f"a bigint, b bigint, spans_a {kind}, spans_b {kind}")


def merged(spans: Column) -> Column:
    """Sorted ranges with touching ones joined."""
    empty = F.expr("cast(array() as array<struct<start: int, stop: int>>)")
    return F.aggregate(F.array_sort(spans), empty, lambda acc, s: F.when(
        (F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["stop"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], s["stop"]).alias("stop")))))
        .otherwise(F.concat(acc, F.array(s))))


def shared_passages(sidecars: DataFrame, key: str = "key", content: str = "content", spec: PassageSpec = PassageSpec()) -> DataFrame:
    """One row per sidecar text that shares a passage with another: ``key, class_key, n_links, n_words, spans``.

    ``sidecars`` are stored JSON sidecar texts (``dataset, key, content``). ``spans`` are the word ranges (``start, stop``; end
    exclusive, of the whole text) of passages of at least 50 words whose 5-word shingles another text has with a
    similarity of 0.8 or more; ``class_key`` is the least key of the texts linked so, directly or by others.
    ``n_links`` counts the other texts of that class. One min-hash in common brings windows together; within its group all
    windows are compared that verified links have not joined yet.

    * Texts that are equal are one class: its members, if they hold 50 words, share the whole text.
    * Null, empty and shorter texts share nothing. Repeated rows are copies. A null key stays null and is never the
      least. An empty table gives an empty one. Other columns are ignored.
    """
    rows = sidecars.select(F.col(key).alias("key"), F.col(content).cast("string").alias("content")).where("content is not null") \
        .withColumn("digest", F.xxhash64("content", F.length("content"), F.md5("content")))
    members = pin(rows.select("key", "digest"))
    sizes = members.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("least_key"))
    texts = rows.select(F.col("digest").alias("id"), "content")

    whole = pin(sizes.where("copies > 1"))
    copied = store.key_filter(whole.select("digest"), "digest")
    alone = pin(_chosen(texts, copied).groupBy("id").agg(F.first("content").alias("content")))
    single = _others(texts, copied).union(alone)

    counts = pin(keys_held(single, spec).groupBy("value").agg(F.sum("n").alias("n")).where("n > 1"))
    wanted = store.key_filter(counts, "value")
    hits = window_hits(shared_windows(single, wanted, spec), counts, spec)
    pairs = pin(hits.groupBy("a", "b").agg(F.array_sort(F.collect_set(F.struct("al", "ar", "bl", "br"))).alias("hits")))

    needed = pin(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    held = store.key_filter(needed, "id")
    kept = pin(_chosen(texts, held).groupBy("id").agg(F.first("content").alias("content")).join(needed, "id", "left_semi"))
    half = _window_tokens(pairs.join(kept.select(F.col("id").alias("a"), F.col("content").alias("text_a")), "a"), spec)
    checked = half.join(kept.select(F.col("id").alias("b"), F.col("content").alias("text_b")), "b")
    links = pin(_verified(checked, spec))

    ends = links.select(F.col("a").alias("id"), "spans_a").union(links.select(F.col("b"), "spans_b"))
    found = ends.select("id", F.explode("spans_a").alias("s")).groupBy("id").agg(merged(F.collect_set("s")).alias("spans"))
    classes = pin(store.components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "id"))
    least = classes.join(sizes.select(F.col("digest").alias("id"), "least_key", "copies"), "id").groupBy("component").agg(
        F.min("least_key").alias("class_key"), (F.sum("copies") - 1).alias("n_links"))
    shared = found.join(classes, "id").join(least, "component").select("id", "class_key", "n_links", "spans")

    lengths = _lengths(alone).groupBy("id").agg(F.max("n").alias("n_words")).where(F.col("n_words") >= spec.least)
    copies = whole.join(lengths.withColumnRenamed("id", "digest"), "digest").select(
        F.col("digest").alias("id"), F.col("least_key").alias("copy_key"), (F.col("copies") - 1).alias("n_copies"), "n_words")
    everything = shared.join(copies, "id", "full").select(
        "id", F.least("class_key", "copy_key").alias("class_key"), F.coalesce("n_links", "n_copies").cast("bigint").alias("n_links"),
        F.when(F.col("n_words").isNull(), F.col("spans")).otherwise(
            F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("stop")))).alias("spans"))
    return members.withColumnRenamed("digest", "id").join(everything, "id").select(
        "key", "class_key", "n_links", F.aggregate("spans", F.lit(0), lambda acc, s: acc + s["stop"] - s["start"]).cast("bigint").alias("n_words"), "spans")


def _chosen(texts: DataFrame, held: np.ndarray) -> DataFrame:
    """Texts whose id may be among the chosen ones; a task gives most of them only once."""
    def run(batches):
        given: set[int] = set()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if len(given) > 200_000:
                given.clear()
            keep = []
            for i in np.flatnonzero(words.may_hold(held, ids)).tolist():
                if int(ids[i]) not in given:
                    given.add(int(ids[i]))
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(keep, pa.int64())) for c in batch.columns], ["id", "content"])

    return texts.select("id", "content").mapInArrow(words.giving_back(run), "id bigint, content string")


def _others(texts: DataFrame, held: np.ndarray) -> DataFrame:
    """Texts whose id is not among the chosen ones."""
    def run(batches):
        for batch in batches:
            keep = pa.array(np.flatnonzero(~words.may_hold(held, batch.column(0).to_numpy())))
            yield pa.RecordBatch.from_arrays([c.take(keep) for c in batch.columns], ["id", "content"])

    return texts.select("id", "content").mapInArrow(words.giving_back(run), "id bigint, content string")


def _lengths(texts: DataFrame) -> DataFrame:
    """Number of words of the texts."""
    def run(batches):
        for batch in batches:
            ids, counts = batch.column(0), []
            for block in words.blocks_of_words(batch.column(1)):
                counts += np.diff(block.rows).tolist()
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64())], ["id", "n"])

    return texts.select("id", "content").mapInArrow(words.giving_back(run), "id bigint, n bigint")
