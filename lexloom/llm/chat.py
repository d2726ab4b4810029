"""Chat formatting as prefix trees.

Conversations that share initial turns are merged: a tree's nodes are turns, a path from the root is a conversation's
beginning. Nodes are laid out depth-first, so shared tokens stand once in the tree's token list. Each node has its
place there, the position id of its first token (the number of tokens of its ancestors), and the intervals of the
list that its tokens may attend to besides itself (its ancestors, neighbouring intervals joined).

Template: `<|turn|>` role `<|text|>` text `<|end|>`. In roles and texts a backslash is doubled, and control strings
(`<|`, `<s>`, `</s>`, `[INST]`, `[/INST]`, `<<SYS>>`, `<</SYS>>`) get backslash and hyphen behind their first
character; unescape() undoes both. Texts of assistants are under the loss mask, their marks are not.

A tree has no bound: its token list is stored in pieces, rows of about `max_tokens` tokens or `max_members` conversations.
All places count from the beginning of the tree, so a piece's nodes attend to tokens of earlier pieces by reference
(`inherited`: the path that was open where the piece begins); no token is stored twice.

Distribution: conversations are range-partitioned and sorted by the digests of their turns, which is depth-first order.
One pass with a stack lays a partition out. Where a tree runs across partitions, the path at the edge is known from the
digests of each partition's first and last conversation (all that the driver gets: two paths a partition); a second,
map-only pass drops what the partition before has already and moves the places behind it. A reader joins the inherited
paths by place, salted, since one root may be inherited by very many pieces.

Cases: rows of a conversation go by turn, then role, then text; null turns come first; null roles and texts are empty;
repeated rows are repeated turns; rows with a null id are one conversation; equal conversations end in one node; a
conversation is a row and has to fit in a task's memory; an empty table gives no tree; other columns, of any name,
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import materialise, ship_package

MAX_TOKENS = 65_536
MAX_MEMBERS = 4096
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LOSS_ROLE = "assistant"
#: Hexadecimal digits of a turn's digest.
_KEY = 32
_SALTS = 16
# First characters of control strings, and what must follow for one.
_CONTROL = re.compile(r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])")
_ESCAPED = re.compile(r"\\([\\-])")


def escape(text: str) -> str:
    """Text without control strings; unescape() gives it back."""
    return _CONTROL.sub(lambda m: m[0] + "\\-", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """Undoes escape()."""
    return _ESCAPED.sub(lambda m: "\\" if m[1] == "\\" else "", text)


def default_tokenizer() -> str:
    """The installed byte-level vocabulary; a path is a parameter everywhere."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("lexloom", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns) of rows by turn."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.groupBy(F.col(id_col).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


# Pieces as a partition's pass writes them: places count from where the partition's own part (run) of the tree begins.
_SPAN = "struct<start:long,end:long>"
_LAID = f"part int, run int, seq long, tree_id string, start long, token_ids array<int>, inherited array<{_SPAN}>, nodes array<struct<depth:int,start:long,end:long,loss_start:long,loss_end:long>>, members array<struct<leaf:long,conv_id:long>>, edge struct<runs:int,first_total:long,last_total:long,first:array<struct<key:string,start:long,end:long>>,last:array<struct<key:string,start:long,end:long>>>"
_PA_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_PA_PATH = pa.list_(pa.struct([("key", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_LAID_TYPES = pa.schema(
    [
        ("part", pa.int32()), ("run", pa.int32()), ("seq", pa.int64()), ("tree_id", pa.string()), ("start", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("inherited", pa.list_(_PA_SPAN)),
        ("nodes", pa.list_(pa.struct([("depth", pa.int32()), *((n, pa.int64()) for n in ("start", "end", "loss_start", "loss_end"))]))),
        ("members", pa.list_(pa.struct([("leaf", pa.int64()), ("conv_id", pa.int64())]))),
        ("edge", pa.struct([("runs", pa.int32()), ("first_total", pa.int64()), ("last_total", pa.int64()), ("first", _PA_PATH), ("last", _PA_PATH)])),
    ]
)


class Builder:
    """Lays conversations out that come in depth-first order."""

    def __init__(self, encode, part: int = 0, max_tokens: int = MAX_TOKENS, max_members: int = MAX_MEMBERS):
        self.encode, self.part, self.max_tokens, self.max_members = encode, part, max_tokens, max_members
        self.stack: list[tuple[tuple[str, str], str, int, int]] = []  # turn, key, start, end
        self.run, self.seq, self.total = 0, 0, 0
        self.first: list[dict] = []
        self.first_total = 0
        self._new()

    def _new(self) -> None:
        self.start, self.tokens, self.nodes, self.members = self.total, [], [], []
        self.inherited: list[dict] | None = None

    def add(self, conv_id: int | None, key: str, turns: list[tuple[str, str]]) -> dict | None:
        """Takes the next conversation (key: its turns' digests); the piece before it, if that ended."""
        shared = 0
        while shared < min(len(self.stack), len(turns)) and self.stack[shared][0] == turns[shared]:
            shared += 1
        done = None
        if self.stack and not shared:
            done = self._piece()
            if not self.run:
                self.first_total = self.total
            self.run, self.total = self.run + 1, 0
            self._new()
        elif len(self.tokens) >= self.max_tokens or len(self.members) >= self.max_members:
            done = self._piece()
            self._new()
        del self.stack[shared:]
        if self.inherited is None:
            self.inherited = [{"start": a, "end": b} for _, _, a, b in self.stack]
        for k in range(shared, len(turns)):
            self._node(turns[k], key[k * _KEY : (k + 1) * _KEY])
        self.members.append({"leaf": self.stack[-1][2], "conv_id": conv_id})
        if not self.first:
            self.first = self._path()
        return done

    def _node(self, turn: tuple[str, str], key: str) -> None:
        head, body, tail = (self.encode(s) for s in (TURN + escape(turn[0]) + TEXT, escape(turn[1]), END))
        start, at = self.total, self.total + len(head)
        self.tokens += head + body + tail
        self.total = at + len(body) + len(tail)
        loss = (at, at + len(body)) if turn[0] == LOSS_ROLE else (start, start)
        self.nodes.append({"depth": len(self.stack), "start": start, "end": self.total, "loss_start": loss[0], "loss_end": loss[1]})
        self.stack.append((turn, key, start, self.total))

    def _path(self) -> list[dict]:
        return [{"key": k, "start": a, "end": b} for _, k, a, b in self.stack]

    def _piece(self) -> dict:
        row = {"part": self.part, "run": self.run, "seq": self.seq, "tree_id": self.stack[0][1], "start": self.start, "token_ids": self.tokens, "inherited": self.inherited, "nodes": self.nodes, "members": self.members, "edge": None}
        self.seq += 1
        return row

    def close(self) -> list[dict]:
        """The open piece, and the partition's edges."""
        if not self.stack:
            return []
        edge = {"runs": self.run + 1, "first_total": self.first_total if self.run else self.total, "last_total": self.total, "first": self.first, "last": self._path()}
        last = self._piece()
        return [last, last | {"seq": -1, "token_ids": [], "inherited": [], "nodes": [], "members": [], "edge": edge}]


def resolve(edges: list[tuple[int, dict]]) -> dict[int, tuple[int, int, list[tuple[int, int]]]]:
    """How each partition's first run moves, where it goes on with a tree: (tokens that stand already, by how much the rest moves, where the former are).

    edges: in the order of the partitions; those without rows are left out.
    """
    moves: dict[int, tuple[int, int, list[tuple[int, int]]]] = {}
    open_path: list[dict] = []
    total = 0
    for part, e in edges:
        first, shared = e["first"], 0
        while shared < min(len(first), len(open_path)) and first[shared]["key"] == open_path[shared]["key"]:
            shared += 1
        move = (0, 0, [])
        if shared:
            there = first[shared - 1]["end"]
            move = moves[part] = (there, total - there, [(x["start"], x["end"]) for x in open_path[:shared]])
        if e["runs"] > 1:
            open_path, total = e["last"], e["last_total"]
        else:
            last = [x | dict(zip(("start", "end"), moved(move, x["start"], x["end"], d), strict=True)) for d, x in enumerate(e["last"])]
            open_path, total = last, e["first_total"] + move[1]
    return moves


def moved(move: tuple[int, int, list[tuple[int, int]]], start: int, end: int, depth: int) -> tuple[int, int]:
    """The place of a node of this depth after the move."""
    there, by, places = move
    return places[depth] if start < there else (start + by, end + by)


NODE = f"struct<parent:long,depth:int,start:long,end:long,position:long,loss_start:long,loss_end:long,attends:array<{_SPAN}>>"
TREE = f"piece_id long, tree_id string, start long, token_ids array<int>, inherited array<{_SPAN}>, nodes array<{NODE}>, members array<struct<leaf:long,conv_id:long>>"
_PA_NODE = pa.struct([("parent", pa.int64()), ("depth", pa.int32()), *((n, pa.int64()) for n in ("start", "end", "position", "loss_start", "loss_end")), ("attends", pa.list_(_PA_SPAN))])
_TREE = pa.schema([("piece_id", pa.int64()), ("tree_id", pa.string()), ("start", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("inherited", pa.list_(_PA_SPAN)), ("nodes", pa.list_(_PA_NODE)), ("members", _LAID_TYPES.field("members").type)])


def settle(row: dict, moves: dict[int, tuple[int, int, list[tuple[int, int]]]]) -> dict:
    """A piece (TREE) with places that count from the tree's beginning, positions and attention intervals."""
    move = moves.get(row["part"]) if row["run"] == 0 else None
    there, by, places = move or (0, 0, [])
    path = [(x["start"], x["end"]) for x in row["inherited"]]
    path = [moved(move, a, b, d) for d, (a, b) in enumerate(path)] if move else path
    cut = max(0, there - row["start"]) if row["nodes"] and row["start"] < there else 0
    if cut:  # the tree's first piece here: the path that stands already comes first
        path = list(places)
    inherited, nodes = list(path), []
    where = {a: b for a, b in zip((x["start"] for x in row["inherited"]), (p[0] for p in path), strict=False)}
    for x in row["nodes"]:
        if move and x["start"] < there:
            where[x["start"]] = places[x["depth"]][0]
            continue
        start, end = x["start"] + by, x["end"] + by
        where[x["start"]] = start
        del path[x["depth"] :]
        attends: list[dict] = []
        for a, b in path:
            if attends and attends[-1]["end"] == a:
                attends[-1]["end"] = b
            else:
                attends.append({"start": a, "end": b})
        nodes.append({"parent": path[-1][0] if path else -1, "depth": x["depth"], "start": start, "end": end, "position": sum(b - a for a, b in path), "loss_start": x["loss_start"] + by, "loss_end": x["loss_end"] + by, "attends": attends})
        path.append((start, end))
    return {
        "piece_id": row["part"] << 32 | row["seq"], "tree_id": row["tree_id"], "start": row["start"] + by + cut, "token_ids": row["token_ids"][cut:], "inherited": [{"start": a, "end": b} for a, b in inherited],
        "nodes": nodes, "members": [{"leaf": where[m["leaf"]], "conv_id": m["conv_id"]} for m in row["members"]],
    }


def format_trees(rows: DataFrame, tokenizer: str | None = None, max_tokens: int = MAX_TOKENS, max_members: int = MAX_MEMBERS, **columns: str) -> DataFrame:
    """The trees of conversation rows, in pieces (TREE). One grouping and one range exchange."""
    spark = rows.sparkSession
    ship_package(spark)
    path = tokenizer or default_tokenizer()
    digests = F.transform("turns", lambda t: F.substring(F.sha2(F.concat(F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]), 256), 1, _KEY))
    keyed = conversations(rows, **columns).withColumn("key", F.array_join(digests, ""))
    ordered = keyed.repartitionByRange(F.col("key"), F.col("conv_id")).sortWithinPartitions("key", "conv_id").select("conv_id", "key", "turns")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        builder = Builder(_encoding(path).encode_ordinary, context.partitionId() if context else 0, max_tokens, max_members)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                some = batch.slice(first, 256)
                done = [builder.add(c, k, [(t["role"], t["text"]) for t in turns]) for c, k, turns in zip(*(x.to_pylist() for x in some.columns), strict=True)]
                yield pa.RecordBatch.from_pylist([d for d in done if d], _LAID_TYPES)
        yield pa.RecordBatch.from_pylist(builder.close(), _LAID_TYPES)

    laid, _ = materialise(ordered.mapInArrow(lay, _LAID), "laid")
    edges = sorted((r["part"], r["edge"].asDict(recursive=True)) for r in laid.where("edge IS NOT NULL").select("part", "edge").toLocalIterator())
    moves = spark.sparkContext.broadcast(resolve(edges))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 16):
                yield pa.RecordBatch.from_pylist([settle(r, moves.value) for r in batch.slice(first, 16).to_pylist()], _TREE)

    return laid.where("edge IS NULL").drop("edge").mapInArrow(finish, TREE)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"
_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64())])
_PARSE = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)


def read_piece(piece: dict, path: list[dict], decode) -> Iterator[dict]:
    """A row of READ for each conversation of a piece, from tokens, places and masks alone. path: the inherited nodes with their tokens and loss tokens."""
    spans = [(x["start"], x["end"]) for x in piece["inherited"]]
    if [x["start"] for x in path] != [a for a, _ in spans]:
        raise ValueError("inherited nodes are missing")
    stack = [(x["start"], x["tokens"], x["loss"]) for x in path]
    at, base, nodes = piece["token_ids"], piece["start"], iter(piece["nodes"])
    leaves: dict[int, list] = {}
    for m in piece["members"]:
        leaves.setdefault(m["leaf"], []).append(m["conv_id"])
    if stack:
        yield from _rows(leaves.pop(stack[-1][0], ()), stack, decode)
    for x in nodes:
        del stack[x["depth"] :]
        if x["position"] != sum(len(t) for _, t, _ in stack) or x["position"] != sum(s["end"] - s["start"] for s in x["attends"]):
            raise ValueError("position ids and attention intervals differ")
        stack.append((x["start"], at[x["start"] - base : x["end"] - base], at[x["loss_start"] - base : x["loss_end"] - base]))
        yield from _rows(leaves.pop(x["start"], ()), stack, decode)
    if leaves:
        raise ValueError("conversations end in no node")


def _rows(conv_ids, stack: list[tuple[int, list[int], list[int]]], decode) -> Iterator[dict]:
    if not conv_ids:
        return
    text = decode([i for _, ids, _ in stack for i in ids]).decode()
    turns = [(unescape(m[1]), unescape(m[2])) for m in _PARSE.finditer(text)]
    masked = "".join(unescape(decode(loss).decode()) for _, _, loss in stack)
    row = {
        "n_turns": len(turns), "turns_sha256": hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
        "loss_chars": len(masked), "loss_sha256": hashlib.sha256(masked.encode()).hexdigest(), "formatted_chars": len(text), "n_tokens": sum(len(ids) for _, ids, _ in stack),
    }
    for conv_id in conv_ids:
        yield {"conv_id": conv_id} | row


def _inherited(trees: DataFrame) -> DataFrame:
    """(piece_id, path) of the pieces that go on with a tree: the nodes they inherit, with tokens and loss tokens."""
    refs = trees.where(F.size("inherited") > 0).select("piece_id", "tree_id", F.posexplode("inherited").alias("depth", "s")).select("piece_id", "tree_id", "depth", F.col("s.start").alias("at"))
    wanted = refs.groupBy("tree_id", "at").agg(F.count("*").alias("_n")).drop("_n")
    there = trees.select(F.col("piece_id").alias("home"), "tree_id", F.explode("nodes").alias("n")).select("home", "tree_id", F.col("n.start").alias("at"), "n").join(wanted, ["tree_id", "at"], "left_semi")
    held = there.drop("tree_id").join(trees.select(F.col("piece_id").alias("home"), "tree_id", F.col("start").alias("base"), "token_ids"), "home")

    def part(a: str, b: str) -> F.Column:
        return F.slice("token_ids", (F.col(a) - F.col("base") + 1).cast("int"), (F.col(b) - F.col(a)).cast("int"))

    held = held.select("tree_id", "at", part("n.start", "n.end").alias("tokens"), part("n.loss_start", "n.loss_end").alias("loss"), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    salted = refs.withColumn("salt", F.pmod(F.xxhash64("piece_id"), F.lit(_SALTS)).cast("int"))
    node = F.struct("depth", F.col("at").alias("start"), "tokens", "loss")
    return salted.join(held, ["tree_id", "at", "salt"]).groupBy("piece_id").agg(F.sort_array(F.collect_list(node)).alias("path"))


def read_trees(trees: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """A row of READ for each conversation in the trees. trees is read several times: give it a written table."""
    ship_package(trees.sparkSession)
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _encoding(path).decode_bytes
        for batch in batches:
            for first in range(0, batch.num_rows, 16):
                part = batch.slice(first, 16).to_pylist()
                yield pa.RecordBatch.from_pylist([r for t in part for r in read_piece(t, t["path"] or [], decode)], _READ)

    begun = trees.where(F.size("inherited") > 0).join(_inherited(trees), "piece_id", "left")
    names = ["start", "token_ids", "inherited", "nodes", "members", "path"]
    whole = trees.where(F.size("inherited") == 0).withColumn("path", F.lit(None).cast(begun.schema["path"].dataType))
    return whole.select(*names).mapInArrow(run, READ).unionByName(begun.select(*names).mapInArrow(run, READ))
