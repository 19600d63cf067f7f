"""Tokens of two tokenizers over the same bytes, against a plain loop over all token pairs."""

import hashlib
import json
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from conftest import DATA
from frailscope.functions.joins import BROADCAST_CONF
from frailscope.llm import alignment
from test_texts import HARD, frame

SHOWN = alignment.byte_level_bytes()


def tokenizers():
    a = Tokenizer.from_file(alignment.BYTE_LEVEL)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)


def spans(tokens):
    end, out = 0, []
    for t in tokens:
        out.append((end, end + len(t)))
        end += len(t)
    return out


def brute(rows):
    a, b = tokenizers()
    counts, documents = Counter(), []
    for i, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(SHOWN[c] for c in a.id_to_token(t)) for t in ids_a]
        bytes_b = [
            bytes([int(b.id_to_piece(t)[3:5], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode()
            for t in ids_b
        ]
        whole = b" " + (text or "").encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            documents.append((i, [], [], [], []))
            continue
        at_a, at_b = spans(bytes_a), spans(bytes_b)
        links, low = [], 0
        for x, (s, e) in zip(ids_a, at_a):
            while at_b[low][1] <= s:
                low += 1
            k = low
            while k < len(at_b) and at_b[k][0] < e:
                links.append((x, ids_b[k]))
                k += 1
        shared = {e for _, e in at_a} & {e for _, e in at_b}
        groups, left, right = [], iter(zip(ids_a, at_a)), iter(zip(ids_b, at_b))
        for end in sorted(shared):
            sides = []
            for tokens in (left, right):
                own = []
                for t, (_, e) in tokens:
                    own.append(str(t))
                    if e == end:
                        break
                sides.append(",".join(own))
            groups.append("|".join(sides))
        counts.update(links)
        documents.append((i, ids_a, ids_b, groups, links))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [
        (
            i,
            len(ids_a),
            len(ids_b),
            len(groups),
            len(links),
            sum(counts[x, y] == most[y] for x, y in links),
            sum(counts[pair] for pair in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
        )
        for i, ids_a, ids_b, groups, links in documents
    ]


def ordered(found):
    return sorted((tuple(r) for r in found), key=repr)


ODD = [
    (1, " leading"),
    (2, "trailing  "),
    (3, "a▁b"),
    (4, "<|endoftext|> <s>x</s><unk> <0x41>"),
    (5, "tab\tline\n\n  two   three\r\n\x0b"),
    (6, "漢字かな交じり文 without spaces漢字 ﬁ é é 👩‍👩‍👧"),
    (7, "\x00 \x1c 　x"),
    (8, " "),
    (9, "x" * 5000 + " " + "漢" * 3000),
]


@pytest.mark.parametrize("limit", ["", "0"])
def test_alignment_is_that_of_all_token_pairs(spark, limit):
    if limit:
        spark.conf.set(BROADCAST_CONF, limit)
    rows = ODD + HARD
    found = alignment.cross_tokenizer_alignment(frame(spark, rows)).collect()
    spark.conf.unset(BROADCAST_CONF)
    assert ordered(found) == ordered(brute(rows))
    empty = frame(spark, rows).limit(0)
    assert alignment.cross_tokenizer_alignment(empty).count() == 0


def test_alignment_of_the_small_table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert ordered(alignment.cross_tokenizer_alignment(docs).collect()) == ordered(brute(rows))


def test_groups_are_written_out_and_links_counted(spark):
    found = alignment.align(frame(spark, [(1, "Some unusual wording, twice: unusual wording.")])).first()
    sides = [g.split("|") for g in found["groups"].split(";")]
    assert sum(len(s.split(",")) for s, _ in sides) == found["n_a"]
    assert sum(len(s.split(",")) for _, s in sides) == found["n_b"]
    assert hashlib.sha256(found["groups"].encode()).hexdigest() == found["groups_sha256"]
    assert sum(found["times"]) == found["n_links"]


def test_long_texts_in_parts_and_forgotten_windows(monkeypatch):
    rng = np.random.default_rng(4)
    words = ["".join(chr(int(c)) for c in rng.integers(97, 400, rng.integers(1, 9))) for _ in range(300)]
    text = "".join(words[int(k)] + ["  ", " ", " ", "\n", " "][int(j)] for k, j in rng.integers(0, [300, 5], (2000, 2)))
    coder = alignment.Encoders(*(open(p, "rb").read() for p in (alignment.BYTE_LEVEL, alignment.PIECES)))

    def align():
        return alignment.align_texts([text, "", text], coder, alignment.Windows(coder.a, coder.b))

    whole = align()
    monkeypatch.setattr(alignment, "PART_CHARS", 50)
    monkeypatch.setattr(alignment, "_MOST_WINDOWS", 10)
    monkeypatch.setattr(alignment, "_LONG_WINDOW", 2)
    parts = align()
    assert whole["n_a"][0] > 4000 and whole["n_a"][1] == 0
    for name, value in whole.items():
        assert np.array_equal(value, parts[name])


def test_encoding_by_rank_is_that_of_the_file():
    """All characters, alone and after spaces, and odd runs; and a file that cannot be encoded by rank."""
    file, pieces = open(alignment.BYTE_LEVEL, "rb").read(), open(alignment.PIECES, "rb").read()
    coder = alignment.Encoders(file, pieces)
    assert alignment._ranked(json.loads(file)) is not None
    a, _ = tokenizers()
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = [j.join(every[i : i + 400]) for j in ("", " a", "\n ") for i in range(0, len(every), 4000)]
    texts += [" " * 5000, "\n" * 5000 + "x", "x" * 5000, "!" * 5000, "it's we'll '", "<|endoftext|>"]
    ids, counts, _, _ = coder.encode(texts)
    expected = [a.encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(x) for x in expected]
    assert ids.tolist() == [i for x in expected for i in x]
    other = json.loads(file)
    other["model"]["merges"][:2] = other["model"]["merges"][1::-1]
    assert alignment._ranked(other) is None
    slow = alignment.Encoders(json.dumps(other).encode(), pieces)
    assert slow.encode(["then there"])[1].tolist() == [len(Tokenizer.from_str(json.dumps(other)).encode(" then there").ids)]
