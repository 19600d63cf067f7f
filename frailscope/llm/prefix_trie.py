"""A prefix trie over conversations, from vertical bitmaps.

Conversations are dealt into shards of 320 neighbouring ids. In a shard, a posting is the set of
conversations that have a certain turn at a certain position, kept as the bits of an integer. The
children of a trie node are found by intersecting its bitset with postings of the next position,
depth first: the lowest conversation not yet placed names the posting, and what the posting shares
with the node is a child. Popcounts give members, and the members that have no further turn give
the end list. Nodes carry a digest of their path, under which the shards' parts are added up.

Sums over subtrees need no walk over the trie. Let the smallest member of a node be its head. The
nodes headed by conversation c are the lower end of c's path, so with P(c) the words of c's
path above that end (all its words, if it heads nothing), the words saved below node v are

    sum of P(c) over the members c of v  -  P(head of v)  -  (members - 1) * (words above v),

and the childless nodes below v are the members of v that head a childless node.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frailscope.functions.joins import lookup_join
from frailscope.llm.tokens import WORD
from frailscope.sources.scratch import store

FAMILY = 20
SHARD = 16 * FAMILY
# Turns of a shard are worked on in blocks of this many positions, so a long conversation streams by.
_BLOCK = 64
_KEY = ["key_a", "key_b"]
_ROWS_PER_BATCH = 10_000


def turns_of(conversations: DataFrame) -> DataFrame:
    """(shard, conv_id, turn, role, turn_a, turn_b, words): turns with a digest for role and text."""
    conv_id = F.col("conv_id").cast("long")
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return conversations.filter(conv_id.isNotNull()).select(
        F.expr(f"(cast(conv_id as long) - pmod(cast(conv_id as long), {SHARD})) div {SHARD}").alias("shard"),
        conv_id.alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.xxhash64(role, text).alias("turn_a"),
        F.xxhash64(F.lit(1), text, role).alias("turn_b"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )


def shared_turns(conv_id: int) -> int:
    """How many turns a conversation takes from the first one of its family."""
    return zlib.crc32(str(conv_id).encode()) % 4


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, tuple[int, int, int], bool]]:
    """(shard, conv_id, turn, is the last of its conversation) from sorted rows."""
    before = None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "conv_id", "turn_a", "turn_b", "words"))):
            if before is not None:
                yield before[0], before[1], before[2:], before[1] != row[1]
            before = row
    if before is not None:
        yield before[0], before[1], before[2:], True


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == _ROWS_PER_BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_REBUILT = "shard long, conv_id long, position long, block long, turn_a long, turn_b long, words long, last boolean"
_REBUILT_ARROW = pa.schema(
    [(f.split()[0], pa.bool_() if f.endswith("boolean") else pa.int64()) for f in _REBUILT.split(", ")]
)


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations in the order of ids; only the first turns of a family's first one are kept at hand."""

    def block(position: int) -> int:
        return max(position - 1, 0) // _BLOCK

    def rows() -> Iterator[tuple]:
        family, opening, current, seen, position = None, [], None, 0, 0
        for shard, conv_id, turn, last in _conversations(batches):
            if conv_id - conv_id % FAMILY != family:
                family, opening = conv_id - conv_id % FAMILY, []
            if conv_id != current:
                current, seen, position = conv_id, 0, 0
                taken = shared_turns(conv_id)
            seen += 1
            if conv_id == family:
                if len(opening) < 3:
                    opening.append(turn)
                yield shard, conv_id, seen, block(seen), *turn, last
                continue
            if last and seen <= taken and not opening[:taken]:
                yield shard, conv_id, 0, 0, 0, 0, 0, True
            elif seen == taken + 1 or (last and seen <= taken):
                own = [turn] if seen > taken else []
                whole = [*opening[:taken], *own]
                for position, t in enumerate(whole, 1):
                    yield shard, conv_id, position, 0, *t, last and position == len(whole)
            elif seen > taken:
                position += 1
                yield shard, conv_id, position, block(position), *turn, last

    yield from _batches(rows(), _REBUILT_ARROW)


def rebuilt_conversations(conversations: DataFrame) -> DataFrame:
    """(shard, conv_id, position, block, turn_a, turn_b, words, last): every conversation as rebuilt.

    Conversation c gets the first h turns of the first conversation of its family of 20 (all if
    there are fewer, none if there is none), then its own turns after its first h, with
    h = crc32 of the decimal id modulo 4. One without a turn has a row at position 0.
    """
    order = ["shard", "conv_id", F.asc_nulls_first("turn"), "role", "turn_a", "turn_b"]
    dealt = turns_of(conversations).repartition("shard").sortWithinPartitions(*order)
    return dealt.mapInArrow(_rebuild, _REBUILT)


def _child_key(a: int, b: int, turn: tuple[int, int]) -> tuple[int, int]:
    digest = hashlib.blake2b(np.array([a, b, *turn], np.int64).tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


class _Postings:
    """The vertical bitmaps of one shard for one block of positions."""

    def __init__(self) -> None:
        self.bits: dict[tuple[int, int, int], int] = {}
        self.turn: dict[tuple[int, int], tuple[int, int, int]] = {}
        self.present: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        self.everyone = 0

    def add(self, slot: int, position: int, turn: tuple[int, int, int], last: bool) -> None:
        bit = 1 << slot
        self.everyone |= bit
        if last:
            self.ends[position] = self.ends.get(position, 0) | bit
        if position:
            posting = (position, turn[0], turn[1])
            self.bits[posting] = self.bits.get(posting, 0) | bit
            self.turn[position, slot] = turn
            self.present[position] = self.present.get(position, 0) | bit


def _slots(bits: int) -> list[int]:
    out = []
    while bits:
        low = bits & -bits
        out.append(low.bit_length() - 1)
        bits ^= low
    return out


_PARTS = "shard long, depth long, key_a long, key_b long, parent_a long, parent_b long, words long, above long, members array<long>, ends array<long>"
_PARTS_ARROW = pa.schema(
    [(f.split()[0], pa.list_(pa.int64()) if f.endswith(">") else pa.int64()) for f in _PARTS.split(", ")]
)


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The part of the trie that lies in each shard; rows come sorted by shard and block."""

    def below(shard: int, postings: _Postings, block: int, frontier: list[tuple]) -> Iterator[tuple]:
        """Nodes of the block's positions; ``frontier`` has the nodes above and is replaced by the lowest ones."""
        first_id, upto = shard * SHARD, (block + 1) * _BLOCK
        if not block:
            frontier.append((postings.everyone, 0, 0, 0, 0))
            root = [[first_id + s for s in _slots(bits)] for bits in (postings.everyone, postings.ends.get(0, 0))]
            yield shard, 0, 0, 0, None, None, 0, 0, *root
        stack = frontier[::-1]
        frontier.clear()
        while stack:
            bits, depth, a, b, above = stack.pop()
            rest = bits & postings.present.get(depth + 1, 0)
            children = []
            while rest:
                slot = (rest & -rest).bit_length() - 1
                turn = postings.turn[depth + 1, slot]
                child = rest & postings.bits[depth + 1, turn[0], turn[1]]
                rest ^= child
                key = _child_key(a, b, turn[:2])
                members = [first_id + s for s in _slots(child)]
                ends = [first_id + s for s in _slots(child & postings.ends.get(depth + 1, 0))]
                yield shard, depth + 1, *key, a, b, turn[2], above, members, ends
                children.append((child, depth + 1, *key, above + turn[2]))
            (frontier if depth + 1 == upto else stack).extend(children[::-1])

    def rows() -> Iterator[tuple]:
        at, postings, frontier = None, _Postings(), []
        names = ("shard", "block", "conv_id", "position", "turn_a", "turn_b", "words", "last")
        for batch in batches:
            for shard, block, conv_id, position, *turn, last in zip(*(batch.column(c).to_pylist() for c in names)):
                if (shard, block) != at:
                    if at is not None:
                        yield from below(at[0], postings, at[1], frontier)
                        if shard != at[0]:
                            frontier.clear()
                    at, postings = (shard, block), _Postings()
                postings.add(conv_id - shard * SHARD, position, tuple(turn), last)
        if at is not None:
            yield from below(at[0], postings, at[1], frontier)

    yield from _batches(rows(), _PARTS_ARROW)


def trie_parts(rebuilt: DataFrame) -> DataFrame:
    """Per shard and trie node: path digests of node and parent, members and end list (ids, ascending)."""
    dealt = rebuilt.repartition("shard").sortWithinPartitions("shard", "block", "position", "conv_id")
    return dealt.mapInArrow(_grow, _PARTS)


def _end_digests(parts: DataFrame) -> DataFrame:
    """(key_a, key_b, ends_sha256) of nodes at which a conversation ends; lists stream by, shard after shard."""
    dealt = parts.filter(F.size("ends") > 0).select(*_KEY, "shard", "ends")
    dealt = dealt.repartition(*_KEY).sortWithinPartitions(*_KEY, "shard")
    schema = pa.schema([("key_a", pa.int64()), ("key_b", pa.int64()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            at, digest = None, None
            for batch in batches:
                for a, b, ends in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "ends"))):
                    listed = ",".join(map(str, ends)).encode()
                    if (a, b) == at:
                        digest.update(b"," + listed)
                        continue
                    if at is not None:
                        yield *at, digest.hexdigest()
                    at, digest = (a, b), hashlib.sha256(listed)
            if at is not None:
                yield *at, digest.hexdigest()

        yield from _batches(rows(), schema)

    return dealt.mapInArrow(run, "key_a long, key_b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie over the rebuilt ``conversations`` (conv_id, turn, role, text).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a
    node is a distinct sequence of first turns (role and text), named by its depth and its smallest
    member. ``saved_tokens`` are the words that need not be read again below it and in its last
    turn, ``ends_sha256`` is the digest of the ascending ids that end at it, joined by commas.

    Turns are ordered by turn (null first), then role, then a hash of the text; null roles and texts
    are empty, and repeated rows are turns of their own. Rows without a conv_id belong to no
    conversation and are left out. Families count down to the next multiple of 20, also below zero. An
    empty table has no node, not even a root. Other columns are ignored.
    """
    parts = store(trie_parts(store(rebuilt_conversations(conversations), "rebuilt")), "trie_parts")
    nodes = parts.groupBy(*_KEY).agg(
        *(F.min(c).alias(c) for c in ("depth", "parent_a", "parent_b", "words", "above")),
        F.sum(F.size("members")).cast("long").alias("n_convs"),
        F.min(F.element_at("members", 1)).alias("conv_id"),
    )
    nodes = store(nodes, "trie_nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("parent_a").alias("key_a"), F.col("parent_b").alias("key_b"))
    children = children.agg(F.count(F.lit(1)).alias("n_children"))
    nodes = store(nodes.join(children, _KEY, "left").fillna(0, ["n_children"]), "trie_nodes")

    # What each conversation adds to the sums of the nodes on its path.
    heads = nodes.groupBy("conv_id").agg(
        F.min_by("above", "depth").alias("above_own"), F.count_if(F.col("n_children") == 0).alias("leaves")
    )
    ended = parts.select(F.explode("ends").alias("conv_id"), (F.col("above") + F.col("words")).alias("all_words"))
    added = ended.join(heads, "conv_id", "left").select(
        "conv_id", F.coalesce("above_own", "all_words").alias("added"), F.coalesce("leaves", F.lit(0)).alias("leaves")
    )
    paths = parts.select(*_KEY, F.explode("members").alias("conv_id"))
    sums = lookup_join(paths, added, "conv_id").groupBy(*_KEY).agg(
        F.sum("added").alias("added"),
        F.min(F.struct("conv_id", "added")).alias("head"),
        F.sum("leaves").alias("n_leaves"),
    )
    whole = nodes.join(sums, _KEY).join(_end_digests(parts), _KEY, "left")
    saved = F.col("added") - F.col("head.added") - (F.col("n_convs") - 1) * F.col("above")
    whole = whole.select(
        nodes["conv_id"],
        "depth",
        "parent_a",
        "parent_b",
        "n_convs",
        "n_children",
        "n_leaves",
        saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
    parents = nodes.filter("n_children > 0").select(
        F.col("key_a").alias("parent_a"), F.col("key_b").alias("parent_b"), F.col("conv_id").alias("parent_conv_id")
    )
    return lookup_join(whole, parents, ["parent_a", "parent_b"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
