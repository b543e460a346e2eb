"""Conversations as a prefix tree of formatted turns.

Conversations that begin with the same turns share their nodes. They are sorted by the digests of their turns, which is
depth-first order of the tree, and dealt to shards of that order. A shard is one token sequence: a node's tokens stand
in it once, where the first conversation that has it comes. With them go the position ids (tokens of the ancestors
before it) and the attention intervals, the ancestors' places in the sequence, so that one pass over a shard trains on
every conversation as if it stood alone. A shard repeats the ancestors of its first conversation, to be complete in
itself.

Template: ``<turn ROLE>`` newline TEXT ``</turn>`` newline. In roles and texts a backslash, ``<`` and ``>`` get a
backslash before them, so that no text can hold a control string, and reading takes it away again.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidstrata.llm.common import pieces, settled, shared_folder

_SPECIAL = re.compile(r"([\\<>])")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>\n((?:[^\\<>]|\\.)*)</turn>\n", re.DOTALL)
LOSS_ROLE = "assistant"
#: Text (in all its repetitions) that one shard holds, about.
SHARD_BYTES = 4 << 20


def escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def formatted(role: str, text: str) -> tuple[str, str, str]:
    """What stands before a turn's text, the escaped text, and what follows it."""
    return f"<turn {escape(role)}>\n", escape(text), "</turn>\n"


def parse_turn(turn: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    found = _TURN.fullmatch(turn)
    if not found:
        raise ValueError("not a formatted turn")
    return unescape(found[1]), unescape(found[2])


# --- order ----------------------------------------------------------------------------------------

def _in_turns(conversations: DataFrame) -> DataFrame:
    """The columns used; what is null counts as empty."""
    return conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, chain): sixteen bytes a turn, the digests of role and text. Rows come sorted by conversation; no more
    than the digests of one are held."""
    last, chain, started = None, bytearray(), False

    def done(ids, chains, kind):
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(chains, pa.binary())], ["conv_id", "chain"])

    kind = None
    for batch in batches:
        kind = batch.column("conv_id").type
        ids, chains = [], []
        for conv, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text")], strict=True):
            if not started or conv != last:
                if started:
                    ids.append(last)
                    chains.append(bytes(chain))
                last, chain, started = conv, bytearray(), True
            r = role.encode()
            chain += hashlib.blake2b(len(r).to_bytes(8, "little") + r + text.encode(), digest_size=16).digest()
        if ids:
            yield done(ids, chains, kind)
    if started:
        yield done([last], [bytes(chain)], kind)


def _shared_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the sorted conversations of a shard and count the turns each shares with the one before."""
    shard, rank, before = TaskContext.get().partitionId(), 0, b""
    for batch in batches:
        shared = []
        for chain in batch.column("chain").to_pylist():
            same = len(os.path.commonprefix([before, chain])) // 16
            shared.append(same)
            before = chain
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([
            batch.column("conv_id"), pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(rank, rank + n)),
            pa.array(shared, pa.int64())], ["conv_id", "shard", "rank", "shared"])
        rank += n


# --- the tree -------------------------------------------------------------------------------------

def _emit(tokenizer_path: str):
    """Nodes of a shard in order. Of the path to the current node only the places are held."""
    names = ["conv_id", "depth", "shard", "node", "fresh", "start", "position", "tokens", "loss_start", "loss_end", "attention"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.encode_special_tokens = True
        path: list[tuple[int, int, int, int]] = []  # node, start, end, position after
        at = node = depth = 0
        current = None
        for batch in batches:
            schema = batch.schema
            for piece in pieces(batch, limit=1 << 20):
                rows = list(zip(*[piece.column(c).to_pylist() for c in ("rank", "conv_id", "shard", "shared", "role", "text")], strict=True))
                parts = [formatted(r[4], r[5]) for r in rows]
                coded = tokenizer.encode_batch([x for p in parts for x in p], add_special_tokens=False)
                out = []
                for k, (rank, conv, shard, shared, _, _) in enumerate(rows):
                    if rank != current:
                        current, depth = rank, 0
                        del path[shared:]
                    if depth < shared:
                        out.append((conv, depth, shard, path[depth][0], False, *[None] * 6))
                    else:
                        head, body, tail = (coded[3 * k + j].ids for j in range(3))
                        ids = head + body + tail
                        position = path[-1][3] if path else 0
                        spans: list[list[int]] = []
                        for _, a, b, _ in path:
                            if spans and spans[-1][1] == a:
                                spans[-1][1] = b
                            else:
                                spans.append([a, b])
                        loss = (at + len(head), at + len(head) + len(body)) if rows[k][4] == LOSS_ROLE else (None, None)
                        out.append((conv, depth, shard, node, True, at, position, ids, *loss, spans))
                        path.append((node, at, at + len(ids), position + len(ids)))
                        at, node = at + len(ids), node + 1
                    depth += 1
                columns = list(zip(*out, strict=True))
                kinds = [schema.field("conv_id").type, pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(),
                         pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return run


def write_tree(conversations: DataFrame, path: str, tokenizer_path: str, shard_bytes: int = SHARD_BYTES) -> None:
    """Write the tree of ``conversations`` (conv_id, turn, role, text) under ``path``.

    ``read_nodes`` gives shard, node, start (place of its first token in the shard's sequence), position (position
    id of that token; the next ones count on), tokens, loss_start and loss_end (places under the loss mask: an
    assistant's text), attention (pairs of places: what the node sees besides its own earlier tokens).
    ``read_turns`` gives which node is which turn (depth, from 0) of which conversation.

    Turns are ordered by turn, then role and text where turns are equal; repeated rows stay turns of their own. Null
    roles and texts are empty. Rows with null conv_id form one conversation. No rows, no nodes. There is a shard for
    about every ``shard_bytes`` of text. A conversation's turns
    stream through one task, which holds a batch of them; the shared first turns of many cost a row each.
    """
    rows = _in_turns(conversations)
    order = ["turn", "role", "text"]
    conv = rows.schema["conv_id"]
    chains = settled(
        rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)
        .mapInArrow(_chains, T.StructType([conv, T.StructField("chain", T.BinaryType())])))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = int(size // shard_bytes) + 1
    placed = settled(
        chains.repartitionByRange(shards, "chain", "conv_id").sortWithinPartitions("chain", "conv_id")
        .mapInArrow(_shared_turns, T.StructType([
            conv, T.StructField("shard", T.IntegerType()), T.StructField("rank", T.LongType()), T.StructField("shared", T.LongType())])))
    here = placed.withColumnRenamed("conv_id", "_conv")
    turns = rows.join(here, F.expr("conv_id <=> _conv")).drop("_conv")
    long = T.LongType()
    nodes = (
        turns.repartition(shards, "shard").sortWithinPartitions("shard", "rank", *order).mapInArrow(_by_shard(_emit(tokenizer_path)), T.StructType([
            conv, T.StructField("depth", long), T.StructField("shard", T.IntegerType()), T.StructField("node", long),
            T.StructField("fresh", T.BooleanType()), T.StructField("start", long), T.StructField("position", long),
            T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("loss_start", long),
            T.StructField("loss_end", long), T.StructField("attention", T.ArrayType(T.ArrayType(long)))])))
    nodes.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/tree")


def _by_shard(emit):
    """Start ``emit`` anew for each shard of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut():
            for batch in batches:
                shards = batch.column("shard").to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
                for a, b in zip(edges, edges[1:], strict=False):
                    if b > a:
                        yield int(shards[a]), batch.slice(a, b - a)

        waiting = cut()
        ahead = next(waiting, None)

        def same(shard):
            nonlocal ahead
            while ahead is not None and ahead[0] == shard:
                batch = ahead[1]
                ahead = next(waiting, None)
                yield batch

        while ahead is not None:
            yield from emit(same(ahead[0]))

    return run


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/tree").where("fresh").drop("fresh", "conv_id")


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/tree").select("conv_id", "depth", "shard", "node")


# --- reading back ---------------------------------------------------------------------------------

def _digest(tokenizer_path: str):
    """Digests of conversations from their nodes' tokens, sorted by conversation and depth; they stream through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        state = None
        kind = None

        def closed(s):
            return (s["conv"], s["turns"], s["all"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["size"])

        def batch_of(rows):
            columns = list(zip(*rows, strict=True))
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [
                "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            kind = batch.column("conv_id").type
            out = []
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                convs, starts, lo, hi, tokens = (
                    some.column(c).to_pylist() for c in ("conv_id", "start", "loss_start", "loss_end", "tokens"))
                texts = tokenizer.decode_batch(tokens, skip_special_tokens=False)
                for conv, start, a, b, ids, text in zip(convs, starts, lo, hi, tokens, texts, strict=True):
                    if state is None or state["conv"] != conv:
                        if state is not None:
                            out.append(closed(state))
                        state = {"conv": conv, "turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0}
                    role, said = parse_turn(text)
                    state["turns"] += 1
                    state["size"] += len(text)
                    state["all"].update(f"{role}\n{said}\n".encode())
                    if a is not None:
                        trained = unescape(tokenizer.decode(ids[a - start:b - start], skip_special_tokens=False))
                        state["chars"] += len(trained)
                        state["loss"].update(trained.encode())
            if out:
                yield batch_of(out)
        if state is not None:
            yield batch_of([closed(state)])

    return run


def conversation_digests(spark: SparkSession, path: str, tokenizer_path: str) -> DataFrame:
    """What the files hold, by conversation: conv_id, n_turns, turns_sha256 (of role, newline, text, newline a turn),
    loss_chars and loss_sha256 (of all text under the loss mask, unescaped), formatted_chars."""
    nodes = read_nodes(spark, path).select(
        F.col("shard").alias("_shard"), F.col("node").alias("_node"), "start", "tokens", "loss_start", "loss_end")
    turns = read_turns(spark, path)
    whole = turns.join(nodes, F.expr("shard = _shard AND node = _node")).select(
        "conv_id", "depth", "start", "tokens", "loss_start", "loss_end")
    text, long = T.StringType(), T.LongType()
    schema = T.StructType([
        turns.schema["conv_id"], T.StructField("n_turns", long), T.StructField("turns_sha256", text),
        T.StructField("loss_chars", long), T.StructField("loss_sha256", text), T.StructField("formatted_chars", long)])
    return whole.repartition("conv_id").sortWithinPartitions("conv_id", "depth").mapInArrow(_digest(tokenizer_path), schema)


def write_and_digest(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    spark = conversations.sparkSession
    path = shared_folder(spark)
    write_tree(conversations, path, tokenizer_path)
    return conversation_digests(spark, path, tokenizer_path)
