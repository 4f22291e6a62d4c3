"""Prefix trie of the recordings' event sequences, found by truncation peeling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoq.session import pin, scratch_path

# Recordings of one block of ids; a block's ids are one short text.
ID_BLOCK = 4096
# The few deepest sequences that one task peels: their number and the events they have below the depth where it ends.
FEW, FEW_EVENTS = 1024, 1_000_000
_PATH = "array<struct<event:binary,size:bigint>>"
_LEVEL = f"path {_PATH}, node binary, above binary, recording bigint, depth bigint, n_recordings bigint, n_children bigint, " \
         "n_leaves bigint, saved bigint"
_ARROW = pa.schema([("path", pa.list_(pa.struct([("event", pa.binary()), ("size", pa.int64())]))), ("node", pa.binary()), ("above", pa.binary()),
                    *((name, pa.int64()) for name in ["recording", "depth", "n_recordings", "n_children", "n_leaves", "saved"])])


def recording_paths(events: DataFrame, recording: str = "recording", position: str = "event_pos", kind: str = "type",
                    value: str = "value") -> DataFrame:
    """``recording, path``: the events of each recording in the order of ``position`` (null first).

    An event is a digest of ``kind`` and ``value`` (null: empty; 128 bits of SHA-256) and the code points of its value,
    so no text is shuffled and two paths agree just where the events do. Events at one position are ordered by
    their digests, repeated events stay. Events without a recording belong to none and are left out. The events of one
    recording, some 30 bytes each, are one row.
    """
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    whole = F.concat(F.length(text(kind)).cast("string"), F.lit(":"), text(kind), text(value))
    event = F.struct(F.col(position).alias("at"), F.unhex(F.substring(F.sha2(whole, 256), 1, 32)).alias("event"),
                     F.length(text(value)).cast("bigint").alias("size"))
    rows = events.where(F.col(recording).isNotNull()).select(F.col(recording).cast("bigint").alias("recording"), event.alias("e"))
    path = F.transform(F.sort_array(F.collect_list("e")), lambda e: F.struct(e["event"].alias("event"), e["size"].alias("size")))
    return rows.groupBy("recording").agg(path.alias("path"))


def node_of(path: Column) -> Column:
    """Key of a node: 128 bits of a digest of its events."""
    return F.unhex(F.substring(F.sha2(F.array_join(F.transform(path, lambda e: F.hex(e["event"])), ""), 256), 1, 32))


def few_below(depths: list, few: int = FEW, events: int = FEW_EVENTS) -> int | None:
    """The least depth with at most ``few`` sequences below it, and ``events`` of their events; None without sequences."""
    longer = left = 0
    depths = sorted(((d, n) for d, n in depths), reverse=True)
    for i, (depth, n) in enumerate(depths):
        shallower = depths[i + 1][0] if i + 1 < len(depths) else 0
        longer += n
        if longer > few or left + longer > events:
            return depth
        steps = min(depth - shallower, (events - left) // longer)
        if steps < depth - shallower:
            return depth - steps
        left += longer * steps
    return 0 if depths else None


def peel(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """The nodes below depth ``top`` of a few ``path, recording, n_recordings``; those just below it carry their path."""
    ends: dict[int, list] = {}
    for batch in batches:
        for path, recording, n in zip(*(c.to_pylist() for c in batch.columns)):
            chain, keys = hashlib.sha256(), []
            for event in path:
                keys.append(chain.digest()[:16])
                chain.update(event["event"].hex().upper().encode())
            keys.append(chain.digest()[:16])
            ends.setdefault(len(path), []).append((path, keys, [recording, n, 0, 0, 0]))
    alive: list[tuple] = []
    for depth in range(max(ends, default=top), top, -1):
        merged: dict[bytes, tuple] = {}
        for path, keys, figures in ends.get(depth, []) + [(p, k, [r, n, 1, leaves, saved]) for p, k, (r, n, _, leaves, saved) in alive]:
            held = merged.setdefault(keys[depth], (path, keys, [figures[0], 0, 0, 0, 0]))[2]
            held[0] = min(held[0], figures[0])
            for i in range(1, 5):
                held[i] += figures[i]
        alive = list(merged.values())
        for path, _, figures in alive:
            figures[3] = max(figures[3], 1)
            figures[4] += (figures[1] - 1) * path[depth - 1]["size"]
        for at in range(0, len(alive), 10_000):
            part = alive[at:at + 10_000]
            columns = [[p[:depth] if depth == top + 1 else None for p, _, _ in part], [k[depth] for _, k, _ in part],
                       [k[depth - 1] for _, k, _ in part], [f[0] for *_, f in part], [depth] * len(part)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns + [[f[i] for *_, f in part] for i in range(1, 5)], _ARROW.types)], schema=_ARROW)


def prefix_nodes(paths: DataFrame) -> DataFrame:
    """One row per distinct sequence of first events, the empty one (root) included: ``node, recording`` (least of those that
    begin so), ``depth, parent_recording`` (of the node one event shorter; root: null), ``n_recordings, n_children, n_leaves``
    (childless nodes at or below), ``saved`` (code points not stored again: summed over the nodes at or below, the last event's
    code points times the recordings beyond the first).

    ``paths`` has ``recording, path`` as ``recording_paths`` gives them (an empty path ends at the root); further columns are
    ignored, rows whose recording or path is null are left out, an empty table has no nodes.

    The levels are peeled from the deepest up: recordings that end at a depth join the nodes that survive from
    below, which have lost their last event, and are grouped with them; all figures of a node are sums or minima over what
    was merged into it, so a level is one grouping with partial sums and a sequence that many recordings share is one
    row before the first of them. Each level is written to the shared folder and read by the next. As that costs a job per
    level, the depths that at most 1,024 sequences (and a million of their events) reach are peeled by one task in the same
    way: a few very long recordings cost no jobs of their own. Parents' recordings are joined once at the end.
    """
    spark = paths.sparkSession
    ended = paths.where("recording is not null and path is not null").groupBy("path").agg(
        F.min("recording").alias("recording"), F.count(F.lit(1)).alias("n_recordings")).withColumn("depth", F.size("path"))
    ends_at, levels_at = scratch_path(spark, "ended"), scratch_path(spark, "levels")
    ended.hint("rebalance", "depth").write.partitionBy("depth").parquet(ends_at)
    ended = spark.read.schema(f"path {_PATH}, recording bigint, n_recordings bigint, depth int").parquet(ends_at)
    top = few_below(ended.groupBy("depth").count().collect())
    if top is None:
        return spark.createDataFrame([], "node binary, recording bigint, depth bigint, parent_recording bigint, n_recordings bigint, "
                                         "n_children bigint, n_leaves bigint, saved bigint")
    ended.where(F.col("depth") > top).select("path", "recording", "n_recordings").coalesce(1) \
        .mapInArrow(lambda batches: peel(batches, top), _LEVEL).write.parquet(f"{levels_at}/deep")
    below, zero = spark.read.schema(_LEVEL).parquet(f"{levels_at}/deep").where("path is not null"), F.lit(0).cast("bigint")
    for depth in range(top, -1, -1):
        rows = ended.where(F.col("depth") == depth).select(
            "path", "recording", "n_recordings", zero.alias("child"), zero.alias("leaves"), zero.alias("saved")).union(
            below.select(F.slice("path", 1, depth), "recording", "n_recordings", F.lit(1).cast("bigint"), "n_leaves", "saved"))
        size = F.element_at("path", -1)["size"] if depth else zero
        rows.groupBy("path").agg(
            F.min("recording").alias("recording"), F.sum("n_recordings").alias("n_recordings"), F.sum("child").alias("n_children"),
            F.greatest(F.sum("leaves"), F.lit(1)).alias("n_leaves"), F.sum("saved").alias("below")) \
            .select("path", node_of(F.col("path")).alias("node"), (node_of(F.slice("path", 1, depth - 1)) if depth else F.lit(None).cast("binary")).alias("above"),
                    "recording", F.lit(depth).cast("bigint").alias("depth"), "n_recordings", "n_children", "n_leaves",
                    (F.col("below") + (F.col("n_recordings") - 1) * size).alias("saved")) \
            .write.parquet(f"{levels_at}/{depth}")
        below = spark.read.schema(_LEVEL).parquet(f"{levels_at}/{depth}")
    nodes = spark.read.schema(_LEVEL).option("recursiveFileLookup", "true").parquet(levels_at).drop("path")
    parents = nodes.where("n_children > 0").select(F.col("node").alias("above"), F.col("recording").alias("parent_recording"))
    return nodes.join(parents, "above", "left") \
        .select("node", "recording", "depth", "parent_recording", "n_recordings", "n_children", "n_leaves", "saved")


def ended_recordings(paths: DataFrame) -> DataFrame:
    """``node, block, recordings``: the recordings that end at each node, ascending, in blocks of at most 4,096 ids."""
    block = F.floor(F.col("recording") / ID_BLOCK).alias("block")
    return paths.where("recording is not null and path is not null").select(node_of(F.col("path")).alias("node"), block, "recording") \
        .groupBy("node", "block").agg(F.sort_array(F.collect_list("recording")).alias("recordings"))


def ended_digests(paths: DataFrame) -> DataFrame:
    """``node, ended_sha256``: SHA-256 of the ids of the recordings that end at the node, ascending, joined by commas.

    The digest is a chain, so a node's blocks are read in order by one task, a batch at a time and in constant memory.
    """
    blocks = ended_recordings(paths).select("node", "block", F.array_join("recordings", ",").alias("ids"))

    def digest(batches):
        node, chain = None, None
        for batch in batches:
            nodes, out = [], []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key == node:
                    chain.update(b",")
                else:
                    if node is not None:
                        nodes.append(node)
                        out.append(chain.hexdigest())
                    node, chain = key, hashlib.sha256()
                chain.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(out, pa.string())], ["node", "ended_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([chain.hexdigest()])], ["node", "ended_sha256"])

    return blocks.repartition("node").sortWithinPartitions("node", "block").select("node", "ids") \
        .mapInArrow(digest, "node binary, ended_sha256 string")


def event_prefixes(events: DataFrame, recording: str = "recording", position: str = "event_pos", kind: str = "type",
                   value: str = "value") -> DataFrame:
    """The nodes of the prefix trie of all recordings' events, see ``recording_paths`` and ``prefix_nodes``.

    The raw events of a study (``dataset, subject`` make a recording, numbered beforehand) or any other ordered sequences.
    """
    return prefix_nodes(pin(recording_paths(events, recording, position, kind, value)))
