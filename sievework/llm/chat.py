"""Chat formatting into a prefix tree: shared first turns are emitted once.

Conversations are read turn by turn as sorted streams; a turn's node is the hash of all turns up to it,
so equal beginnings meet in the same nodes.  A node belongs to the smallest conversation through it.
The nodes a conversation owns are the end of its path, one unbroken chain: the tree is a tree of chains,
and depth-first order is that of the chains' branching points.  Chain texts are
emitted once, in that order.  The unit is the code point; every node carries the position ids of its units
(those they have in a conversation) and the intervals it attends to: the leading parts of its
ancestors' chains, and its own chain up to itself.

Template: ``<s>[role] text</s>`` per turn; inside role and text, each of ``\\ < [ ]`` takes a backslash before
it, so no text can contain a mark, and taking the backslashes away restores it.  The loss mask covers the
texts of assistant turns.

Defined cases: null roles and texts are empty; turns are ordered by ``turn`` (null first), equal ones by role
and text, each repeated row being a turn of its own; null ids form one conversation, the smallest; an
empty table gives empty results.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import materialise

_NO_ID = -(1 << 63)
_CONTROL = re.compile(r"([\\<\[\]])")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<s>\[((?:\\.|[^\\\[\]<])*)\] ((?:\\.|[^\\<\[\]])*)</s>", re.S)

_NODE = (
    "conv_id long, depth long, node binary, parent binary, role string, piece string,"
    " pos_start long, pos_end long, loss_start long, loss_end long"
)
_NAMES = [c.split()[0] for c in _NODE.split(",")]


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_piece(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and the range of it that is trained on."""
    head, body = f"<s>[{escape(role)}] ", escape(text)
    stop = len(head) + len(body)
    return f"{head}{body}</s>", *((len(head), stop) if role == "assistant" else (0, 0))


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns; anything else is an error."""
    found, at = [], 0
    while at < len(formatted):
        turn = _TURN.match(formatted, at)
        if turn is None:
            raise ValueError(f"no turn at character {at}")
        found.append((unescape(turn[1]), unescape(turn[2])))
        at = turn.end()
    return found


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to path nodes; the state is the last node of the current conversation."""
    current, node, depth, position = None, b"", 0, 0
    schema = pa.schema(
        [pa.field(n, {"binary": pa.binary(), "string": pa.string()}.get(k, pa.int64())) for n, k in (c.split() for c in _NODE.split(","))]
    )
    for batch in batches:
        out: list[list] = [[] for _ in _NAMES]
        for conv, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if conv != current:
                current, node, depth, position = conv, b"", 0, 0
            piece, a, b = turn_piece(role, text)
            parent = node
            node = hashlib.blake2b(parent + piece.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            row = (conv, depth, node, parent or None, role, piece, position, position + len(piece), a, b)
            for column, value in zip(out, row, strict=True):
                column.append(value)
            depth += 1
            position += len(piece)
        yield pa.record_batch(dict(zip(_NAMES, out, strict=True)), schema=schema)


class Forest:
    """``paths``: a row per turn with its node; ``chains``: a row per conversation with the parts of
    chains it runs through; ``nodes``: the formatted output, each distinct node once."""

    def __init__(self, paths: DataFrame, chains: DataFrame, nodes: DataFrame):
        self.paths, self.chains, self.nodes = paths, chains, nodes


def prefix_forest(turns: DataFrame) -> Forest:
    """Merge the conversations of ``turns`` (``conv_id, turn, role, text``) by their first turns."""
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(_NO_ID)).alias("conv_id"),
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    grown = materialise(
        rows.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .mapInArrow(_grow, _NODE),
        "chat-turns",
    )
    owners = grown.groupBy("node").agg(F.min("conv_id").alias("chain"))
    paths = materialise(
        grown.select("conv_id", "depth", "node", "pos_start", "pos_end").join(owners, "node"), "chat-paths"
    )
    part = F.struct(
        "first_depth", "chain", F.lit(0).cast("long").alias("start"), (F.col("e") - F.col("s")).alias("end")
    )
    runs = paths.groupBy("conv_id", "chain").agg(
        F.min("depth").alias("first_depth"), F.max("depth").alias("last_depth"),
        F.min("pos_start").alias("s"), F.max("pos_end").alias("e"),
    )
    chains = materialise(
        runs.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("parts")), "chat-chains"
    )
    # Depth-first: a branch comes after the chain it leaves, deepest branch first, then by conversation.
    order = F.transform("parts", lambda p: F.struct((-p["first_depth"]).alias("branch"), p["chain"].alias("chain")))
    own = chains.filter(F.element_at("parts", -1)["chain"] == F.col("conv_id")).select(
        "conv_id",
        F.element_at("parts", 1)["chain"].alias("tree"),
        order.alias("dfs"),
        F.filter("parts", lambda p: p["chain"] != F.col("conv_id")).alias("ancestors"),
    )
    # A node's text comes from its owner's row: one row per node, whatever runs through it.
    owned = (
        grown.join(paths.select("conv_id", "depth", "chain"), ["conv_id", "depth"])
        .filter(F.col("chain") == F.col("conv_id"))
        .join(own, "conv_id")
    )
    chain_start = F.coalesce(F.aggregate("ancestors", F.lit(0).cast("long"), lambda a, p: a + p["end"]), F.lit(0))
    mine = F.struct("chain", F.lit(0).cast("long").alias("start"), (F.col("pos_end") - chain_start).alias("end"))
    attends = F.concat(
        F.transform("ancestors", lambda p: F.struct(p["chain"].alias("chain"), p["start"].alias("start"), p["end"].alias("end"))),
        F.array(mine),
    )
    nodes = owned.select(
        "tree", "dfs", "chain", "depth", "node", "parent", "role", "piece",
        "pos_start", "pos_end", "loss_start", "loss_end", attends.alias("attends"),
    )
    return Forest(paths, chains, nodes)


def emitted(forest: Forest) -> DataFrame:
    """The nodes in depth-first order, tree by tree."""
    return forest.nodes.orderBy("tree", "dfs", "depth")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted nodes of conversations to one row each; texts are hashed as they stream by."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    current, out = None, [[] for _ in names]
    n = chars = loss_chars = 0
    turns, loss = hashlib.sha256(), hashlib.sha256()

    def close() -> None:
        if current is not None:
            row = (None if current == _NO_ID else current, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)
            for column, value in zip(out, row, strict=True):
                column.append(value)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    for batch in batches:
        fields = (batch[c].to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_end"))
        for conv, piece, a, b in zip(*fields, strict=True):
            if conv != current:
                close()
                current, n, chars, loss_chars = conv, 0, 0, 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            for role, text in read_turns(piece):
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                n += 1
            trained = unescape(piece[a:b])
            loss.update(trained.encode("utf-8", "surrogatepass"))
            loss_chars += len(trained)
            chars += len(piece)
        yield pa.record_batch(dict(zip(names, out, strict=True)), schema=schema)
        out = [[] for _ in names]
    close()
    yield pa.record_batch(dict(zip(names, out, strict=True)), schema=schema)


def read_back(forest: Forest) -> DataFrame:
    """Every conversation as the output has it: ``conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars``."""
    pieces = forest.nodes.select("node", "piece", "loss_start", "loss_end")
    return (
        forest.paths.select("conv_id", "depth", "node")
        .join(pieces, "node")
        .select("conv_id", "depth", "piece", "loss_start", "loss_end")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "depth")
        .mapInArrow(
            _digest,
            "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
        )
    )
