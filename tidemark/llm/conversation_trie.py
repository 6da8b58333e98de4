"""Prefix trie of conversations through vertical bitmaps.

Conversations of a range of ids are a shard. Its index maps (position, turn) to the set of the shard's conversations that have the turn there, as a
bitset; a depth-first walk intersects a node's bitset with the postings of the next position, which yields its children, their popcounts and the
lists of conversations that end there. What shards share is merged by the digest of the sequence, so that a first turn of a third of all
conversations is one row a shard. Sums over subtrees need no walk over the whole trie: a node is owned by its smallest
conversation, so that each shard adds up the nodes that it owns, bottom-up, and the shards' sums are added by node.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.operators.provenance import hash_blocks
from tidemark.session import cut, ship

#: Ids of a base and those that may borrow its turns; most borrowed turns, plus one.
HUNDRED, BORROWED = 100, 6
#: Conversation ids in a shard: the width of its bitsets. A multiple of HUNDRED.
WIDTH = 500
#: Positions that the index holds. What follows in a longer conversation streams by as a chain of nodes with one member.
DEEP = 1024
ROOT = bytes(16)
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
NODES = "shard long, owner long, depth long, key binary, parent_owner long, n long, points long, turn binary, more boolean, ends string"
PARTS = "key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, turn binary"


def borrowed(conv: int) -> int:
    """How many first turns conversation ``conv`` takes from its base."""
    return zlib.crc32(str(conv).encode()) % BORROWED


def child_key(parent: bytes, turn: bytes) -> bytes:
    """Digest of a sequence of turns from that of all but the last."""
    return hashlib.blake2b(parent + turn, digest_size=16).digest()


class Shard:
    """Index and walk of the conversations of one range of ids, fed turn by turn in order of conversation."""

    def __init__(self, number: int, deep: int = DEEP):
        self.number, self.deep = number, deep
        self.ids: list[int] = []
        self.paths: list[list[bytes]] = []
        self.postings: dict[tuple[int, bytes], int] = {}
        self.ends: dict[int, int] = {}
        self.points: dict[bytes, int] = {}
        self.base: int | None = None
        self.base_turns: list[tuple[bytes, int]] = []
        self.conv: int | None = None
        self.first_tails: list[tuple[int, tuple]] = []

    def feed(self, conv: int, turn: bytes, points: int) -> Iterator[tuple]:
        if conv != self.conv:
            yield from self._begin(conv)
        at, self.seen = self.seen, self.seen + 1
        if conv == self.base and at < BORROWED - 1:
            self.base_turns.append((turn, points))
        if at >= self.skipped:
            yield from self._push(turn, points)

    def _begin(self, conv: int) -> Iterator[tuple]:
        yield from self._end()
        self.conv, self.seen, self.length, self.key, self.held = conv, 0, 0, ROOT, None
        self.ids.append(conv)
        self.paths.append([])
        base = conv // HUNDRED * HUNDRED
        if base != self.base:
            self.base, self.base_turns = base, []
        self.skipped = 0 if conv == base else borrowed(conv)
        for turn, points in self.base_turns[: self.skipped] if conv != base else []:
            yield from self._push(turn, points)

    def _push(self, turn: bytes, points: int) -> Iterator[tuple]:
        at, self.length = self.length, self.length + 1
        k = len(self.ids) - 1
        if at < self.deep:
            self.paths[k].append(turn)
            self.points[turn] = points
            self.postings[at, turn] = self.postings.get((at, turn), 0) | 1 << k
            return
        if at == self.deep:
            self.key = ROOT
            for t in self.paths[k]:
                self.key = child_key(self.key, t)
        yield from self._release(True)
        self.key = child_key(self.key, turn)
        self.held = (at + 1, self.key, points, turn)

    def _release(self, more: bool) -> Iterator[tuple]:
        """The last node of a chain, once it is known whether another follows."""
        if self.held is None:
            return
        depth, key, points, turn = self.held
        row = (self.number, self.conv, depth, key, self.conv, 1, points, turn, more, None if more else str(self.conv))
        self.held = None
        if depth == self.deep + 1:  # hangs on a node that the walk will find
            self.first_tails.append((len(self.ids) - 1, row))
        else:
            yield row

    def _end(self) -> Iterator[tuple]:
        if self.conv is not None:
            yield from self._release(False)
            self.ends[self.length] = self.ends.get(self.length, 0) | 1 << (len(self.ids) - 1)

    def walk(self) -> Iterator[tuple]:
        """All nodes of the shard, depth first: members, children and ends by intersection of bitsets."""
        yield from self._end()
        tails = dict(self.first_tails)
        stack = [(0, (1 << len(self.ids)) - 1, ROOT, None, None)]
        while stack:
            depth, bits, key, parent_owner, turn = stack.pop()
            owner = self.ids[(bits & -bits).bit_length() - 1]
            ending = bits & self.ends.get(depth, 0)
            rest = going = bits & ~ending
            while rest:
                k = (rest & -rest).bit_length() - 1
                if depth == self.deep:
                    yield (*tails[k][:4], owner, *tails[k][5:])
                    rest &= rest - 1
                    continue
                following = self.paths[k][depth]
                members = bits & self.postings[depth, following]
                rest &= ~members
                stack.append((depth + 1, members, child_key(key, following), owner, following))
            points = self.points[turn] if turn is not None else 0
            yield self.number, owner, depth, key, parent_owner, bits.bit_count(), points, turn, bool(going), self._listed(ending)

    def _listed(self, bits: int) -> str | None:
        out = []
        while bits:
            out.append(str(self.ids[(bits & -bits).bit_length() - 1]))
            bits &= bits - 1
        return ",".join(out) or None


class Sums:
    """Sums over subtrees of one shard, from nodes in descending order of (owner, depth): children come before their parents."""

    def __init__(self):
        self.open: dict[tuple[int, int], list] = {}

    def feed(self, owner: int, depth: int, key: bytes, parent_owner: int | None, n: int, points: int, turn: bytes, conv: int, more: bool) -> Iterator[tuple]:
        total, distinct, leaves, children, held = self.open.pop((owner, depth), (0, 0, 0, 0, ()))
        for row in held:
            yield (*row[:3], conv, *row[4:])
        own = owner == conv  # no smaller conversation of another shard has the node
        total, distinct, leaves = total + n * points, distinct + points * own, leaves + (own and not more)
        row = (key, depth, conv, None, n, children, leaves, total - distinct, turn)
        if parent_owner is None:
            yield row
            return
        up = self.open.setdefault((parent_owner, depth - 1), [0, 0, 0, 0, []])
        for k, v in enumerate((total, distinct, leaves, int(own))):
            up[k] += v
        up[4].append(row)


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def _streamed(rows: DataFrame, schema: str, make) -> DataFrame:
    """Run a generator of rows over the tasks' rows in their order."""
    ship(rows.sparkSession)
    kind = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(make(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)), arrow)

    return rows.mapInArrow(run, kind)


def turn_digests(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, at, digest, points, role, text``: each turn with the digest of its role and text (null: empty)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("at"), role.alias("role"), text.alias("text"))
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.select("conv_id", "at", F.substring(F.unhex(F.sha2(whole, 256)), 1, 16).alias("digest"), F.length("text").cast("long").alias("points"), "role", "text")


def conversation_trie(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", width: int = WIDTH, deep: int = DEEP
) -> DataFrame:
    """One row per distinct sequence of first turns of the rebuilt conversations.

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256`` and ``turn`` (digest of the last turn, for ``with_texts``).

    A conversation is rebuilt from the first h turns of the one whose id is the next multiple of 100 at or below its own, and its own turns after its first h
    (h: ``borrowed``). Turns go by ``turn``, null first; ties go by the digest of role and text, and repeated rows are turns of their own. Null roles and
    texts are empty ones; rows without a conversation id belong to no conversation and are left out; an empty table has no nodes, not even a root. Other
    columns are ignored. Shards are id ranges of ``width``; a worker holds the first ``deep`` turns of at most ``width`` conversations and streams over the rest.
    """
    if width % HUNDRED:
        raise ValueError("the width of a shard is a multiple of 100")
    shard = F.expr(f"conv_id div {width} - cast(conv_id < 0 and conv_id % {width} <> 0 as int)")
    rows = turn_digests(turns, id_col, turn_col, role_col, text_col).select(shard.cast("long").alias("shard"), "conv_id", "at", "digest", "points")
    rows = rows.repartition("shard").sortWithinPartitions("shard", "conv_id", F.col("at").asc_nulls_first(), "digest")

    def walks(stream):
        now = None
        for number, conv, turn, points in stream:
            if now is None or now.number != number:
                if now is not None:
                    yield from now.walk()
                now = Shard(number, deep)
            yield from now.feed(conv, turn, points)
        if now is not None:
            yield from now.walk()

    nodes = cut(_streamed(rows.select("shard", "conv_id", "digest", "points"), NODES, walks), "trie-nodes")
    heads = nodes.groupBy("key").agg(F.min("owner").alias("conv_id"), F.max("more").alias("any"))
    both = nodes.drop("more", "ends").join(heads, "key")
    both = both.repartition("shard").sortWithinPartitions("shard", F.desc("owner"), F.desc("depth"))

    def sums(stream):
        now, state = None, None
        for number, *row in stream:
            if number != now:
                now, state = number, Sums()
            yield from state.feed(*row)

    parts = _streamed(both.select("shard", "owner", "depth", "key", "parent_owner", "n", "points", "turn", "conv_id", "any"), PARTS, sums)
    ends = hash_blocks(nodes.filter("ends is not null").select("key", "shard", "ends"), "key", ["shard"], "ends", b",")
    merged = parts.unionByName(ends.withColumnRenamed("sha256", "ends"), allowMissingColumns=True).groupBy("key").agg(
        *[F.max(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id")],
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.coalesce(F.max("ends"), F.lit(EMPTY_SHA256)).alias("ends_sha256"),
        F.max("turn").alias("turn"),
    )
    return merged.drop("key")


def with_texts(nodes: DataFrame, turns: DataFrame, **columns: str) -> DataFrame:
    """Adds ``role`` and ``text`` of each node's last turn (null for the root)."""
    known = turn_digests(turns, **columns).groupBy("digest").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    return nodes.join(known, nodes["turn"] == known["digest"], "left").drop("digest")
