"""The trie over rebuilt conversations against a plain dictionary of prefixes."""

import hashlib
import zlib

import numpy as np
import pytest

from frailscope.functions.joins import BROADCAST_CONF
from frailscope.llm import prefix_trie
from test_texts import WORD

SCHEMA = "conv_id long, turn long, role string, text string, depth int, words string, shard int, key_a double"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def brute(rows):
    whole = rebuilt(rows)
    members = {}
    for c, turns in sorted(whole.items()):
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, own in members.items():
        under = [p for p in members if p[: len(path)] == path]
        ends = ",".join(str(c) for c in own if len(whole[c]) == len(path))
        out.append(
            (
                own[0],
                len(path),
                members[path[:-1]][0] if path else None,
                len(own),
                sum(len(p) == len(path) + 1 for p in under),
                sum(not any(len(q) == len(p) + 1 and q[:-1] == p for q in under) for p in under),
                sum((len(members[p]) - 1) * len(WORD.findall(p[-1][1])) for p in under if p),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 0.5) for r in rows], SCHEMA)


def random_rows(rng, ids, turns):
    rows = []
    for c in ids:
        for turn in range(int(rng.integers(1, turns))):
            rows.append((int(c), turn, ["user", "bot", None][int(rng.integers(3))] if turn > 3 else "user", f"w{rng.integers(2)} w" if rng.random() < 0.8 else None))
    return rows


@pytest.mark.parametrize("limit", ["", "0"])
def test_trie_is_that_of_a_dictionary(spark, limit):
    rng = np.random.default_rng(8)
    rows = random_rows(rng, [*range(-45, 90), *range(310, 345), 2**53 + 1, 2**53 + 20], 9)
    rows += [(700, None, "user", "w0 w"), (700, 5, None, None), (700, -1, "", ""), (701, 1, "user", "x"), (701, 1, "user", "x")]
    rows += [(None, 1, "user", "nobody"), (None, None, None, None)]
    if limit:
        spark.conf.set(BROADCAST_CONF, limit)
    found = prefix_trie.prefix_trie(frame(spark, rows))
    assert found.columns == COLUMNS
    ours = sorted((tuple(r) for r in found.collect()), key=repr)
    spark.conf.unset(BROADCAST_CONF)
    assert ours == brute(rows)


def test_long_conversations_pass_through_blocks(spark, monkeypatch):
    """More positions than a block has, one conversation a prefix of another, one without a turn left."""
    rows = [(40, k, "user", f"t{k}") for k in range(300)] + [(41, k, "user", f"t{k}") for k in range(170)]
    rows += [(42, k, "user", f"t{k}") for k in range(64)] + [(43, k, "user", f"t{k}") for k in range(65)]
    alone = next(c for c in range(61, 80) if zlib.crc32(str(c).encode()) % 4 > 1)
    rows.append((alone, 0, "user", "gone"))
    assert rebuilt(rows)[alone] == []
    ours = sorted((tuple(r) for r in prefix_trie.prefix_trie(frame(spark, rows)).collect()), key=repr)
    assert ours == brute(rows)


def test_many_copies_over_shards(spark):
    rows = [(20 * c, k, "user", f"t{k}") for c in range(120) for k in range(3)]
    found = {r["depth"]: r for r in prefix_trie.prefix_trie(frame(spark, rows)).collect()}
    assert [found[d]["n_convs"] for d in range(4)] == [120] * 4 and found[0]["saved_tokens"] == 3 * 119
    assert found[3]["ends_sha256"] == hashlib.sha256(",".join(str(20 * c) for c in range(120)).encode()).hexdigest()
    assert prefix_trie.prefix_trie(frame(spark, rows).limit(0)).count() == 0
