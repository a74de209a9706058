"""Chat formatting as a prefix tree of turns.

Conversations that begin with the same turns share the nodes of these turns.  Nodes are encoded and written
once, in depth-first order, as a stream of token ids cut into rows: each has its place in the stream, the position
its first token has in the conversation (the tokens of all turns above it), the range of its tokens that
counts for the loss, and the stretches of the stream its tokens may attend to, which are its ancestors; neighbouring ones
are joined, so a chain of turns has one stretch.

A turn is formatted as ``<|turn|>role\\ntext<|end|>\\n``.  In role and text a backslash becomes two, and ``<|``
becomes ``<\\|``, so the marks never occur inside; a line break in a role becomes ``\\n``.  All of it is undone
on reading.  Role, text and end are encoded apart, so the loss covers the tokens of the text exactly.

A node is named by a digest of its parent's name, its role and its text.  Conversations are sorted by the
names along their path, which is depth-first order; a node belongs to the first conversation that has it,
so a very common first turn is a single row and conversations below it spread over all partitions.  The nodes of a
conversation that others own come first on its path, and sums along the path give all positions, so work
grows with the number of turns.

Defined cases: a null text or role is empty; turns are ordered by number (null first), then role and text;
repeated rows are turns of their own; a null id is a conversation like any other; an empty table gives no
rows; extra columns are ignored.  A conversation is one row of a table: its turns together stay below 2 GiB.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyhound.llm import encoding, tokens

#: Rows of nodes that are handed over together.
_ROWS_AT_ONCE = 5_000
OPEN, CLOSE = "<|turn|>", "<|end|>\n"
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    parts = text.split("\\\\")  # a doubled backslash is one sign; the others only break up marks
    return "\\".join(x.replace("\\|", "|").replace("\\n", "\n") for x in parts)


def format_turn(role: str, text: str) -> str:
    return f"{OPEN}{escape(role).replace(chr(10), chr(92) + 'n')}\n{escape(text)}{CLOSE}"


def parse_turn(piece: str) -> tuple[str, str]:
    role, text = piece[len(OPEN) : -len(CLOSE)].split("\n", 1)
    return unescape(role), unescape(text)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names and formatted turns along each conversation's path."""
    for batch in batches:
        names, pieces, losses = [], [], []
        for turns in batch.column("turns").to_pylist():
            above, path, texts, marks = "", [], [], []
            for turn in turns:
                role, text = turn["role"] or "", turn["text"] or ""
                piece = format_turn(role, text)
                above = hashlib.md5(f"{above}\n{piece}".encode(), usedforsecurity=False).hexdigest()
                path.append(above)
                texts.append(piece)
                marks.append(role == LOSS_ROLE)
            names.append(path)
            pieces.append(texts)
            losses.append(marks)
        yield pa.record_batch(
            [
                batch.column("conv_id"),
                pa.array(names, pa.list_(pa.string())),
                pa.array(pieces, pa.list_(pa.string())),
                pa.array(losses, pa.list_(pa.bool_())),
            ],
            ["conv_id", "path", "pieces", "losses"],
        )


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rank = TaskContext.get().partitionId() << 40
    for batch in batches:
        yield pa.record_batch([*batch.columns, pa.array(range(rank, rank + batch.num_rows), pa.int64())], [*batch.schema.names, "rank"])
        rank += batch.num_rows


def _encoded(tokenizer: str):
    """Ids of nodes, the range of them under the loss mask, and their place in the partition's stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = encoding.encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows, pieces in tokens.slices(batch, "piece"):
                parts = []
                for piece in pieces:
                    head = piece.index(b"\n") + 1
                    parts += [piece[:head], piece[head : -len(CLOSE)], piece[-len(CLOSE) :]]
                ids, offsets = encoder.encode(parts)
                bounds = offsets[::3]
                sizes = np.diff(bounds)
                first = offsets[1::3] - bounds[:-1]
                last = np.where(rows.column("loss").to_numpy(zero_copy_only=False), offsets[2::3] - bounds[:-1], first)
                kept = [rows.column(c) for c in ("node", "rank", "parent", "depth")]
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                more = [pa.array(sizes), pa.array(first), pa.array(last), lists]
                places = [pa.array(np.full(len(sizes), part, np.int32)), pa.array(bounds[:-1] + start)]
                yield pa.record_batch([*kept, *more, *places], _STREAM_NAMES)
                start += int(bounds[-1])

    return run


_STREAM_NAMES = ["node", "rank", "parent", "depth", "size", "loss_from", "loss_to", "ids", "part", "part_start"]
_STREAM = (
    "node string, rank long, parent string, depth int, size long, loss_from long, loss_to long, ids array<int>, "
    "part int, part_start long"
)
_OWNED = "start long, position long, attends array<struct<from: bigint, to: bigint>>"


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Position and ancestors' stretches of the nodes a conversation owns, from the places along its path."""
    pair = pa.struct([("from", pa.int64()), ("to", pa.int64())])
    for batch in batches:
        starts, positions, attends, offsets = [], [], [], [0]
        for rank, way in zip(batch.column("rank").to_pylist(), batch.column("way").to_pylist(), strict=True):
            runs: list[tuple[int, int]] = []
            position = 0
            for step in way:
                start, size = step["start"], step["size"]
                if step["owner"] == rank:
                    starts.append(start)
                    positions.append(position)
                    attends += runs
                    offsets.append(len(attends))
                position += size
                if runs and runs[-1][1] == start:
                    runs[-1] = (runs[-1][0], start + size)
                else:
                    runs.append((start, start + size))
            if len(starts) >= _ROWS_AT_ONCE:
                yield _owned_batch(starts, positions, attends, offsets, pair)
                starts, positions, attends, offsets = [], [], [], [0]
        if starts:
            yield _owned_batch(starts, positions, attends, offsets, pair)


def _owned_batch(starts: list, positions: list, attends: list, offsets: list, pair: pa.DataType) -> pa.RecordBatch:
    stretches = pa.StructArray.from_arrays(
        [pa.array([x for x, _ in attends], pa.int64()), pa.array([x for _, x in attends], pa.int64())], fields=list(pair)
    )
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), stretches)
    return pa.record_batch([pa.array(starts, pa.int64()), pa.array(positions, pa.int64()), lists], ["start", "position", "attends"])


def write_tree(turns: DataFrame, path: str, tokenizer: str) -> None:
    """Write ``nodes`` (the stream, in order) and ``conversations`` (their nodes from the root) below ``path``."""
    spark = turns.sparkSession
    kind = turns.select("conv_id").schema[0].dataType.simpleString()
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    columns = f"conv_id {kind}, path array<string>, pieces array<string>, losses array<boolean>"
    found = grouped.mapInArrow(_paths, columns).repartitionByRange("path").sortWithinPartitions("path", "conv_id")
    found.mapInArrow(_ranked, f"{columns}, rank long").write.parquet(f"{path}/conversations")
    members = spark.read.parquet(f"{path}/conversations")

    parents = F.concat(F.array(F.lit(None).cast("string")), "path")  # one more than there are nodes
    zipped = F.arrays_zip("path", "pieces", "losses", parents.alias("parents"))
    spread = members.select("rank", F.size("path").alias("length"), F.posexplode(zipped).alias("depth", "turn"))
    each = spread.where(F.col("depth") < F.col("length")).select(
        F.col("turn.path").alias("node"),
        F.col("turn.parents").alias("parent"),
        "depth",
        "rank",
        F.col("turn.pieces").alias("piece"),
        F.col("turn.losses").alias("loss"),
    )
    nodes = each.groupBy("node").agg(
        F.min("rank").alias("rank"), *(F.any_value(x).alias(x) for x in ("parent", "depth", "piece", "loss"))
    )
    nodes = nodes.repartitionByRange("rank", "depth").sortWithinPartitions("rank", "depth")
    nodes.mapInArrow(_encoded(tokenizer), _STREAM).write.parquet(f"{path}/stream")
    stream = spark.read.parquet(f"{path}/stream")
    sums = stream.groupBy("part").agg(F.sum("size").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    sums = sums.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    stream = stream.join(sums, "part").withColumn("start", F.col("before") + F.col("part_start"))
    stream = stream.drop("part", "part_start", "before")

    places = stream.select("node", F.col("rank").alias("owner"), "size", "start")
    along = members.select("rank", F.posexplode("path").alias("depth", "node")).join(places, "node")
    step = F.struct("depth", "start", "size", "owner")
    ways = along.groupBy("rank").agg(F.sort_array(F.collect_list(step)).alias("way"))
    kept = stream.drop("rank").join(ways.mapInArrow(_owned, _OWNED), "start")
    kept.repartitionByRange("start").sortWithinPartitions("start").write.parquet(f"{path}/nodes")


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """``conv_id, turns`` of all conversations, put together from the nodes of the tree: ids and the range under the loss mask."""
    members = spark.read.parquet(f"{path}/conversations").select("conv_id", "rank", F.posexplode("path").alias("depth", "node"))
    nodes = spark.read.parquet(f"{path}/nodes").select("node", "ids", "loss_from", "loss_to")
    turns = F.sort_array(F.collect_list(F.struct("depth", "ids", "loss_from", "loss_to")))
    rows = members.join(nodes, "node").groupBy("rank").agg(F.any_value("conv_id").alias("conv_id"), turns.alias("turns"))
    return rows.select("conv_id", "turns")


def digests(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """Numbers and digests of the turns and of the text under the loss mask, decoded and undone from the format."""
    kind = conversations.select("conv_id").schema[0].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = batch.column("turns")
            each = turns.flatten()
            ids, masks = each.field("ids"), [each.field(x).to_numpy() for x in ("loss_from", "loss_to")]
            raw, place = encoding.decode(tokenizer, ids.flatten().to_numpy())
            first = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])
            bounds = place[first].tolist()
            low, high = (place[first[:-1] + x].tolist() for x in masks)
            out: list[list] = [[], [], [], [], []]
            at = 0
            for count in turns.value_lengths().to_pylist():
                whole, masked, loss, size = hashlib.sha256(), hashlib.sha256(), 0, 0
                for k in range(at, at + count):
                    piece = raw[bounds[k] : bounds[k + 1]].decode()
                    role, text = parse_turn(piece)
                    whole.update(f"{role}\n{text}\n".encode())
                    size += len(piece)
                    if high[k] > low[k]:
                        text = unescape(raw[low[k] : high[k]].decode())
                        masked.update(text.encode())
                        loss += len(text)
                at += count
                for column, value in zip(out, (count, whole.hexdigest(), loss, masked.hexdigest(), size), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.record_batch([batch.column("conv_id"), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], names)

    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return conversations.mapInArrow(run, schema)
