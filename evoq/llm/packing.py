"""Token ids of sidecar texts in packed rows of one length: best-fit decreasing, lossless splits, restartable tasks."""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoq.llm import words


@dataclass(frozen=True)
class PackSpec:
    """``length``: tokens per row. ``pool``: tokens that a task packs at a time, a bound on its memory."""

    length: int = 2048
    pool: int = 1 << 22


class Capacities:
    """Open rows by the room left in them: a segment tree over room 0..length that counts the open rows below each node."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = self.size + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and gives the room and row with the least room of at least ``need``."""
        node, count = self.size + need, self.count
        if not count[node]:
            # Up to the first right neighbour that holds a row, then down on its left.
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.size
        while node:
            count[node] -= 1
            node >>= 1
        return room, self.rows[room].pop()


def best_fit(sizes: np.ndarray, length: int) -> tuple[np.ndarray, int]:
    """Row of each piece and the number of rows: pieces in decreasing order (ties: as they come), each into the fullest row
    that still holds it, else a new one."""
    place, rows, free = np.zeros(len(sizes), np.int64), 0, Capacities(length)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = free.take(size)
        if found is None:
            room, row = length, rows
            rows += 1
        else:
            room, row = found
        place[i] = row
        if room > size:
            free.add(room - size, row)
    return place, rows


def pieces_of(lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``text, first, size`` of the pieces: a longer text is cut into full rows and a rest."""
    per_text = -(-lengths // length)
    text = np.repeat(np.arange(len(lengths)), per_text)
    part = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    return text, part * length, np.minimum(lengths[text] - part * length, length)


# White space as the splitting rule's \\s has it, in runs too long for the library's matcher.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{50000,}")


class TokenIds:
    """Token ids of texts under public byte-pair ranks.

    The rule must split runs of white space as the public ones do: a run is one piece, but for its last character where
    something follows. Very long runs are cut out by that, as the matcher fails on a million characters.
    """

    def __init__(self, ranks_file: str, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks_file.splitlines() if line)}
        self.encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def text_ids(self, text: str) -> list[int]:
        ids, at = [], 0
        for run in LONG_SPACE.finditer(text):
            stop = run.end() - (run.end() < len(text))
            ids += self.encoding.encode_ordinary(text[at:run.start()])
            ids += self.encoding._core_bpe.encode_single_piece(text[run.start():stop].encode())
            at = stop
        return ids + self.encoding.encode_ordinary(text[at:])

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end``, and the number of ids per text."""
        ids = []
        for text in column.to_pylist():
            own = self.text_ids(text)
            own.append(end)
            ids.append(np.array(own, np.int32))
        return np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids))


PACKED = ("pack bigint, ids binary, positions binary, n_tokens int, ends array<int>, keys array<{kind}>, offsets array<bigint>")


def pack_rows(keys: pa.Array, ids: np.ndarray, lengths: np.ndarray, first_pack: int, spec: PackSpec) -> tuple[pa.RecordBatch, int]:
    """Packed rows of some texts: the id matrix row by row, positions that restart with every piece, cumulative ends."""
    text, first, size = pieces_of(lengths, spec.length)
    begins = np.cumsum(lengths) - lengths
    place, rows = best_fit(size, spec.length)
    order = np.lexsort((first, text, place))
    text, first, size, place = text[order], first[order], size[order], place[order]
    total = np.bincount(place, size, rows).astype(np.int64)
    starts = np.cumsum(size) - size
    at = np.repeat(begins[text] + first - starts, size) + np.arange(int(size.sum()))
    packed, position = ids[at].astype("<u4"), (np.arange(int(size.sum())) - np.repeat(starts, size)).astype("<u4")
    row_starts = np.cumsum(total) - total
    bounds = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=rows))]).astype(np.int32)
    ends = (starts + size - row_starts[place]).astype(np.int32)
    cuts = (4 * np.concatenate([row_starts, [int(total.sum())]])).astype(np.int32)
    binary = lambda values: pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(values.tobytes())])
    lists = lambda values: pa.ListArray.from_arrays(pa.array(bounds), values)
    return pa.RecordBatch.from_arrays(
        [pa.array(first_pack + np.arange(rows)), binary(packed), binary(position), pa.array(total.astype(np.int32)),
         lists(pa.array(ends)), lists(keys.take(pa.array(text))), lists(pa.array(first.astype(np.int64)))],
        ["pack", "ids", "positions", "n_tokens", "ends", "keys", "offsets"]), rows


def pack_texts(sidecars: DataFrame, ranks_file: str, pattern: str, end_id: int, key: str = "key", content: str = "content",
               spec: PackSpec = PackSpec()) -> DataFrame:
    """Rows of at most ``length`` token ids made of whole texts or pieces of long ones.

    ``ranks_file`` is the text of a public byte-pair vocabulary, ``pattern`` its splitting rule, ``end_id`` closes every text. Of each row:
    ``ids`` and ``positions`` (little-endian 32-bit numbers; positions restart with every piece), ``n_tokens``, ``ends`` (cumulative
    piece ends), ``keys`` and ``offsets`` (text of each piece and where in its ids it begins). ``unpack`` gives the texts' ids back.

    Tasks pack the texts they read, ``pool`` tokens at a time, best-fit decreasing with a segment tree over the room left.
    Nothing is shuffled and a task run again gives the same rows, so ``pack`` (unique) depends on how the input is split.

    * Texts and runs of white space may be of any length. A null or empty text is its end id alone. Repeated rows are packed each. An empty table gives an empty one.
      A null key stays null. Other columns are ignored.
    """
    kind = sidecars.schema[key].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        coder, pack = None, TaskContext.get().partitionId() << 33
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        tokens = 0

        def flush():
            keys = pa.concat_arrays([h[0] for h in held])
            return pack_rows(keys, np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]), pack, spec)

        for batch in batches:
            coder = coder or TokenIds(ranks_file, pattern)
            texts = pc.fill_null(batch.column(1), "")
            _, offsets = words.text_bytes(texts)
            for first, last in words.slices(offsets, 1 << 22):
                ids, lengths = coder.encode(texts.slice(first, last - first), end_id)
                held.append((batch.column(0).slice(first, last - first), ids, lengths))
                tokens += len(ids)
                if tokens >= spec.pool:
                    rows, n = flush()
                    yield rows
                    pack, held, tokens = pack + n, [], 0
        if held:
            yield flush()[0]

    return sidecars.select(F.col(key).alias("key"), F.col(content).cast("string").alias("content")) \
        .mapInArrow(run, PACKED.format(kind=kind))


def unpack(packed: DataFrame) -> DataFrame:
    """``key, offset, ids``: the pieces of all rows as arrays of ids."""
    kind = packed.schema["keys"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            keys, offsets, ids = [], [], []
            for raw, ends, own, firsts in zip(*(batch.column(c).to_pylist() for c in range(4))):
                values = np.frombuffer(raw, "<u4")
                for a, b, k, o in zip([0, *ends[:-1]], ends, own, firsts):
                    keys.append(k)
                    offsets.append(o)
                    ids.append(values[a:b].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(2).type.value_type), pa.array(offsets, pa.int64()),
                                              pa.array(ids, pa.list_(pa.int64()))], ["key", "offset", "ids"])

    return packed.select("ids", "ends", "keys", "offsets").mapInArrow(run, f"key {kind}, offset bigint, ids array<bigint>")


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet files, one group of rows per task."""
    packed.write.parquet(path)
