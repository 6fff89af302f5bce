"""Operator 11: chat formatting of reply trees.

Messages (tree, id, parent, role, text, score) are linked upwards. Self-joins on the ancestor known so far, which
double the steps each round, give each message its root, depth and the sum of scores on the way: log2 of the
depth in rounds, whatever the trees look like, and rows without texts (a message that very many answer makes a hot key, which
adaptive execution splits, as the other side has it once). Leaves are ranked in
their tree by that sum (ties to the smaller id), and the paths of the chosen ones are enumerated by the same jumps taken down
from the largest: a path element at depth d has one 2^k steps above it if d >= 2^k. Texts join only then.

A path becomes one conversation: each turn `<|im_start|>role`, a line feed, the text, `<|im_end|>` and a line feed. Texts are
escaped so that no control string stands in them: behind `<`, a run of backslashes before `|` gets one more (and loses it when
read). Roles get, besides, their backslashes doubled and line feeds written as `\\n`. The loss mask covers the escaped texts of
assistant turns. A conversation comes in parts of whole turns, PART characters or one turn each, in order within one
partition, so none has to fit in memory as a whole; most are one part.

Defined cases: a message whose parent is null or isn't in its tree is a root; messages in a circle and those below
have no root and come in no path; of messages that share an id, or have none, each is a message, replies hang on one
of them (the first by a digest of parent and role, then text: the same in every run), and none on a null id; a null tree is a tree; null or NaN scores count 0;
null roles and texts are empty; texts are taken whole; empty tables give empty results; only the named columns are
read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import cut, prepare
from colloquy.operators.scans import numbered

BEGIN, END, LEARNED, PART = "<|im_start|>", "<|im_end|>", "assistant", 1_000_000
#: A turn in the output, and an escaped control sign.
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def keyed(messages: DataFrame, tree: str, message: str, parent: str, role: str, text: str, score: str | None) -> DataFrame:
    """tree, id, nth (from 1 among messages of one id), parent, role, text, score."""
    value = F.lit(0.0) if score is None else F.coalesce(F.nanvl(F.col(score).cast("double"), F.lit(0.0)), F.lit(0.0))
    own = messages.select(F.col(tree).alias("tree"), F.col(message).alias("id"), F.col(parent).alias("parent"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"), value.alias("score"))
    if not own.groupBy("tree", "id").count().where("count > 1").limit(1).count():
        return own.withColumn("nth", F.lit(1).cast("long"))
    return numbered(own, ["tree", "id"], F.xxhash64("parent", "role"), "nth", [F.col("parent"), F.col("role"), F.col("text"), F.col("score")])


def jumps(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Of nodes (node, up: the parent or null, score) those that have a root: (node, depth, total); and
    the rounds: (node, up, steps), steps being 2^k where the way is that long."""
    here = F.col("up").isNull()
    state = cut(nodes.select("node", F.coalesce("up", "node").alias("up"), F.when(here, 0).otherwise(1).cast("long").alias("steps"), F.when(here, 0.0).otherwise(F.col("score")).alias("total"), F.col("score"), here.alias("done")))
    rounds, open_ = [], state.where("not done").count()
    while open_:
        rounds.append(state.select("node", "up", "steps"))
        above = state.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps"), F.col("total").alias("_total"))
        moved = state.where("not done").join(above, "up").select("node", F.col("_up").alias("up"), (F.col("steps") + F.col("_steps")).alias("steps"), (F.col("total") + F.col("_total")).alias("total"), "score", (F.col("_steps") == 0).alias("done"))
        state = cut(state.where("done").unionByName(moved))
        left = state.where("not done").count()
        if left == open_:  # what is left goes in circles
            break
        open_ = left
    first = state.where("done and steps = 0").select(F.col("node").alias("up"), F.col("score").alias("_first"))
    return state.where("done").join(first, "up").select("node", F.col("steps").alias("depth"), (F.col("total") + F.col("_first")).alias("total")), rounds


def paths(messages: DataFrame, tree: str = "tree", message: str = "id", parent: str = "parent", role: str = "role", text: str = "text", score: str | None = "score", branches: int | None = 1) -> DataFrame:
    """tree, leaf (id, nth), branch (from 1, by score in the tree), total, position (from 0), role, text: the turns of each tree's
    best branches (all, if None)."""
    prepare(messages.sparkSession)
    # Numbers stand for messages from here on; structures are equal where their nulls are.
    own = cut(keyed(messages, tree, message, parent, role, text, score).withColumn("node", F.monotonically_increasing_id()))
    there = own.where("nth = 1 and id is not null").select(F.struct("tree", "id").alias("key"), F.col("node").alias("up"))
    linked = own.where("parent is not null").select(F.struct("tree", F.col("parent").alias("id")).alias("key"), F.col("node").alias("_node")).join(there, "key").select("_node", "up")
    nodes = cut(own.join(linked, F.col("node") == F.col("_node"), "left").select("node", "up", "score"))
    rooted, rounds = jumps(nodes)
    leaves = rooted.join(nodes.where("up is not null").select(F.col("up").alias("node")).distinct(), "node", "left_anti").join(own.select("node", "tree", "id", "nth"), "node")
    order = [F.col("id"), F.col("nth")]
    if branches is None:
        ranked = numbered(leaves, "tree", -F.col("total"), "branch", order)
    else:  # only so many rows of a tree and task are shuffled
        w = Window.partitionBy("tree").orderBy(F.desc("total"), *order)
        ranked = leaves.withColumn("branch", F.row_number().over(w).cast("long")).where(F.col("branch") <= branches)
    chosen = cut(ranked.select("tree", F.col("node").alias("end"), F.struct("id", "nth").alias("leaf"), "branch", "total", "depth"))
    steps = chosen.select("end", F.col("end").alias("node"), F.col("depth").alias("position"))
    for k in reversed(range(len(rounds))):
        far = rounds[k].select("node", F.col("up").alias("_up"))
        above = steps.where(F.col("position") >= 2**k).join(far, "node").select("end", F.col("_up").alias("node"), (F.col("position") - 2**k).alias("position"))
        steps = cut(steps.unionByName(above))
    said = own.select("node", "role", "text")
    return steps.join(said, "node").join(chosen.drop("depth"), "end").select("tree", "leaf", "branch", "total", "position", "role", "text")


def formatted(turns: DataFrame, keys: list[str], order: str, part_chars: int = PART) -> DataFrame:
    """keys, part (from 0), text, mask: conversations of turns (keys, order, role, text). mask: (start, end) in code points
    of what is learned, counted in the part. The parts of a conversation follow each other in one partition."""
    head, body = F.concat(F.lit(BEGIN), escape_role(F.col("role")), F.lit("\n")), escape(F.col("text"))
    ready = turns.select(*keys, order, head.alias("head"), body.alias("body"), (F.col("role") == LEARNED).alias("learned"))
    placed = ready.repartition(*keys).sortWithinPartitions(*keys, order)
    kinds = ", ".join(f"`{k}` {placed.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = part = None
        text, mask, at, out = [], [], 0, []

        def flush() -> None:
            nonlocal text, mask, at, part
            out.append((own, part, "".join(text), mask))
            text, mask, at, part = [], [], 0, part + 1

        def made() -> pa.RecordBatch:
            columns = [pa.array([o[0][i] for o in out], types[i]) for i in range(len(keys))]
            spans = pa.array([o[3] for o in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            batch = pa.RecordBatch.from_arrays([*columns, pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string()), spans], names=[*keys, "part", "text", "mask"])
            out.clear()
            return batch

        types = None
        for b in batches:
            types = types or [b.column(k).type for k in keys]
            for key, h, s, learned in zip(zip(*(b.column(k).to_pylist() for k in keys), strict=True), *(b.column(c).to_pylist() for c in ("head", "body", "learned")), strict=True):
                if part is None or key != own:
                    if part is not None:
                        flush()
                    own, part = key, 0
                if text and at + len(h) + len(s) + len(END) + 1 > part_chars:
                    flush()
                if learned:
                    mask.append({"start": at + len(h), "end": at + len(h) + len(s)})
                text += [h, s, END, "\n"]
                at += len(h) + len(s) + len(END) + 1
            if len(out) > 256:
                yield made()
        if part is not None:
            flush()
            yield made()

    return placed.mapInArrow(run, f"{kinds}, part long, text string, mask array<struct<start:long,end:long>>")


def read_back(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in TURN.finditer(text)]


def digests(conversations: DataFrame, key: str, name: str) -> DataFrame:
    """name, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: what the parts of conversations say, which follow each
    other in one partition, as formatted() leaves them."""
    kind = conversations.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, turns, loss, n, chars, size, out = None, None, None, 0, 0, 0, []

        def close() -> None:
            if turns is not None:
                out.append((own, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for b in batches:
            for k, part, text, mask in zip(*(b.column(c).to_pylist() for c in (key, "part", "text", "mask")), strict=True):
                if part == 0:
                    close()
                    own, turns, loss, n, chars, size = k, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for role, said in read_back(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for s in mask:
                    learned = unescape(text[s["start"] : s["end"]])
                    loss.update(learned.encode())
                    chars += len(learned)
                size += len(text)
            if len(out) > 4096:
                yield made(out, b.column(key).type)
                out = []
            kind_of = b.column(key).type
        close()
        if out:
            yield made(out, kind_of)

    def made(out: list, kind_of: pa.DataType) -> pa.RecordBatch:
        types = [kind_of, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[name, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return conversations.mapInArrow(run, f"`{name}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chains(rows: DataFrame, conversation: str, turn: str, role: str = "role", text: str = "text") -> DataFrame:
    """tree, id, parent, role, text: rows as trees of one branch, by turn, then role and text, where rows of equal turn follow each other."""
    own = rows.select(F.col(conversation).alias("tree"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    placed = numbered(own, "tree", "turn", "id", [F.col("role"), F.col("text")])
    return placed.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text")
