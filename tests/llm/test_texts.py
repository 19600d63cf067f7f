"""Words, links, near copies, benchmark passages and pieces against brute force on small texts."""

import hashlib
import re
import tracemalloc
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from frailscope.llm import decontamination, minhash, pieces, queries, tokens
from frailscope.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, n_shingles long, a long, key string, row int"


def folded_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def frame(spark, rows):
    """Documents with columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, t, f"s{k % 3}", 1, 2, "x", 3) for k, (i, t) in enumerate(rows)], DOCS)


def mutated(rng, words, n):
    words = list(words)
    for i in rng.choice(len(words), n, replace=False):
        words[i] = f"x{rng.integers(1000)}"
    return " ".join(words)


HARD = [
    (900, None),
    (901, ""),
    (902, " \t\n\x0b\r "),
    (903, "One"),
    (904, "one"),
    (905, "é\x00 ü\tß 漢字 \x1c mark"),
    (906, "repeated row of five words"),
    (906, "repeated row of five words"),
    (None, "repeated row of five words"),
    (None, None),
    (907, "long " * 30000),
]


def test_words_and_shingles_are_those_of_the_pattern():
    texts = [t for _, t in HARD] + ["a  B c\nd e f", "A b\tc d e f"]
    words = tokens.words_of(tokens.text_bytes(pa.array(texts)))
    seen = {}
    for i, text in enumerate(texts):
        expected = folded_words(text)
        own = words.hashes[words.first[i] : words.first[i + 1]]
        assert len(own) == len(expected)
        for word, value in zip(expected, own, strict=True):
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)
    hashes, first = tokens.grams(words, 5)
    assert list(np.diff(first)) == [max(len(folded_words(t)) - 4, 1 if folded_words(t) else 0) for t in texts]
    assert list(hashes[first[-3] : first[-2]]) == list(hashes[first[-2] : first[-1]])


def test_components_of_random_links(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(100, 130)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    found = connected_components(spark.createDataFrame([*links, (None, 1)], "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == {x: find(x) for x in parent}


def near_duplicate_rows():
    rng = np.random.default_rng(5)
    rows = []
    for group in range(6):
        base = [f"w{rng.integers(400)}" for _ in range(int(rng.integers(8, 120)))]
        for _ in range(9):
            rows.append((len(rows), mutated(rng, base, int(rng.integers(0, 1 + len(base) // 12)))))
        rows.append((len(rows), " ".join(base).upper()))
    return rows + HARD


def test_near_duplicates_are_those_of_brute_force(spark):
    rows = near_duplicate_rows()
    sets = []
    for i, text in rows:
        words = folded_words(text)
        sets.append((i, {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()))
    component = {i: i for i, _ in sets}
    for (i, a), (j, b) in product(sets, sets):
        if None not in (i, j) and i != j and a and b and 100 * len(a & b) >= 75 * len(a | b):
            old, new = max(component[i], component[j]), min(component[i], component[j])
            component = {k: new if c == old else c for k, c in component.items()}
    found = minhash.near_duplicates(frame(spark, rows)).collect()
    expected = [(i, len(s), None if i is None else component[i], i is None or component[i] == i) for i, s in sets]
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    assert minhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def brute_components(rows):
    sets = [(i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) for i, w in ((i, folded_words(t)) for i, t in rows) if w]
    component = {i: i for i, _ in sets}
    index = {}
    for i, own in sets:
        for j in {j for gram in own for j in index.get(gram, ())}:
            other = sets[j][1]
            if 100 * len(own & other) >= 75 * len(own | other):
                old, new = component[i], component[sets[j][0]]
                component = {k: min(old, new) if c in (old, new) else c for k, c in component.items()}
        for gram in own:
            index.setdefault(gram, []).append([k for k, (x, _) in enumerate(sets) if x == i][0])
    return component


def template_rows(rng, n, copies):
    """Documents that share a template, each with own words in it, and ``copies`` near copies of some of them."""
    base = [f"t{k}" for k in range(200)]
    rows = []
    for i in range(n):
        own = list(base)
        for k in rng.choice(200, 8, replace=False):
            own[k] = f"own{i}x{k}"
        rows.append((len(rows), " ".join(own)))
        if i < copies:
            for _ in range(2):
                rows.append((len(rows), mutated(rng, own, 2)))
    return rows


def test_copies_inside_a_group_that_shares_a_template(spark):
    rng = np.random.default_rng(21)
    rows = template_rows(rng, 300, 60)
    expected = brute_components(rows)
    assert len(set(expected.values())) == 300
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert found == expected
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, rows), every_pair=True).collect()}
    assert found == expected


def test_pairs_grow_with_a_group_and_not_with_its_square(spark, monkeypatch):
    made = []
    fresh = minhash._fresh

    def counted(pairs, compared):
        made.append(pairs.count())
        return fresh(pairs, compared)

    monkeypatch.setattr(minhash, "_fresh", counted)
    sizes = []
    for n in (150, 300, 600):
        made.clear()
        rows = template_rows(np.random.default_rng(22), n, 0)
        minhash.near_duplicates(frame(spark, rows)).collect()
        sizes.append(sum(made))
    assert sizes[2] < 600 * minhash._BANDS and sizes[2] < 2.5 * sizes[1] < 6 * sizes[0]


def test_the_join_of_differences_leaves_out_what_cannot_be_similar(spark, monkeypatch):
    """Members of a group that are not similar to each other are left out in the join, not after it."""
    joined = []
    store = minhash.store

    def counted(rows, name):
        out = store(rows, name)
        if name == "spokes" and "hub" in out.columns:
            joined.append(out.count())
        return out

    monkeypatch.setattr(minhash, "store", counted)
    rows = template_rows(np.random.default_rng(23), 150, 0)
    found = minhash.near_duplicates(frame(spark, rows)).collect()
    assert all(r["kept"] for r in found)
    assert len(joined) == len(minhash.ROUNDS) and sum(joined) < 10 * len(rows)


def test_repeated_ids_and_rows_without_ids(spark):
    a, b = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (None, a), (None, b), (4, "alone here"), (4, "alone here"), (None, None), (None, None)]
    found = sorted(((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, rows)).collect()), key=repr)
    assert found == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4)] + [(None, None)] * 4, key=repr)
    docs = frame(spark, rows)
    kept = minhash.without_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(
        [(1, a), (1, b), (4, "alone here"), (None, None), (None, None)], key=repr
    )
    nameless = frame(spark, [(None, a), (None, a), (None, a + " x"), (None, b)])
    assert sorted(r["text"][:2] for r in minhash.without_copies(nameless).collect()) == ["a0", "b0"]


def test_bound_on_common_parts_holds():
    """The SQL bound, evaluated in Python, is never below the true common part."""
    rng = np.random.default_rng(8)
    pivot = np.unique(rng.integers(0, 1 << 62, 60, dtype=np.uint64))
    pool = np.unique(rng.integers(0, 1 << 62, 40, dtype=np.uint64))
    for _ in range(50):
        sides = [
            np.unique(np.concatenate([rng.choice(pivot, 45, replace=False), rng.choice(pool, 20, replace=False)]))
            for _ in "ab"
        ]
        row = {}
        for name, own in zip(("", "_a"), sides, strict=True):
            extra, lack = np.setdiff1d(own, pivot), np.setdiff1d(pivot, own)
            row |= {f"n{name}": len(own), f"common{name}": len(own) - len(extra), f"lacking{name}": len(lack)}
            for side, part in (("extra", extra), ("lack", lack)):
                more, bits = minhash._occupied(part)
                row[f"{side}_more{name}"] = more
                row |= {f"{side}_{k}{name}": int(bits[k]) & (2**64 - 1) for k in range(minhash._LONGS)}
        names = {"least": min, "greatest": max, "bit_count": int.bit_count}
        assert eval(minhash._MOST_COMMON, names, row) >= len(np.intersect1d(*sides))


def test_rough_bound_is_never_below_the_other():
    """So the join of differences leaves out no pair that the bound after it would keep."""
    rng = np.random.default_rng(9)
    names = {"least": min, "greatest": max, "bit_count": int.bit_count}
    for _ in range(300):
        pivot = np.unique(rng.integers(0, 1 << 62, int(rng.integers(1, 400)), dtype=np.uint64))
        pool = np.unique(rng.integers(0, 1 << 62, int(rng.integers(1, 300)), dtype=np.uint64))
        row = {}
        for name in ("", "_a"):
            own = [rng.choice(part, int(rng.integers(0, len(part) + 1)), replace=False) for part in (pivot, pool)]
            lack = np.setdiff1d(pivot, own[0])
            row |= {f"n{name}": len(own[0]) + len(own[1]), f"common{name}": len(own[0]), f"lacking{name}": len(lack)}
            for side, part in (("extra", own[1]), ("lack", lack)):
                more, bits = minhash._occupied(part)
                longs = [int(b) & (2**64 - 1) for b in bits]
                row |= {f"{side}_more{name}": more} | {f"{side}_{k}{name}": b for k, b in enumerate(longs)}
            for column, folded in minhash._ROUGH_BITS.items():
                row[f"{column}{name}"] = int(np.bitwise_or.reduce([np.uint64(row[f"{c}{name}"]) for c in folded]))
        assert eval(minhash._ROUGHLY_COMMON, names, row) >= eval(minhash._MOST_COMMON, names, row)


def brute_tiles(document, item, least):
    """Greedy string tiling by its definition: the longest unmarked match, again and again."""
    used_d, used_i, covered = [False] * len(document), [False] * len(item), 0
    while True:
        best = (least - 1, 0, 0)
        for i, d in product(range(len(item)), range(len(document))):
            n = 0
            while (
                i + n < len(item)
                and d + n < len(document)
                and item[i + n] == document[d + n]
                and not used_i[i + n]
                and not used_d[d + n]
            ):
                n += 1
            best = max(best, (n, -i, -d))
        if best[0] < least:
            return covered
        n, i, d = best[0], -best[1], -best[2]
        used_i[i : i + n], used_d[d : d + n] = [True] * n, [True] * n
        covered += n


@pytest.mark.parametrize("pairs_at_once", [1 << 20, 1, 7])
def test_tiling_covers_what_brute_force_covers(monkeypatch, pairs_at_once):
    monkeypatch.setattr(decontamination, "_PAIRS_AT_ONCE", pairs_at_once)
    rng = np.random.default_rng(2)
    for _ in range(40):
        item = rng.integers(0, 4, 24)
        document = np.concatenate([rng.integers(0, 4, 10), item[12:], rng.integers(0, 4, 5), item[:12]])
        marks, seeds = (np.array([int(x @ [1, 4, 16]) for x in np.lib.stride_tricks.sliding_window_view(t, 3)]) for t in (document, item))
        order = np.argsort(seeds, kind="stable")
        runs = decontamination.seed_runs(np.arange(len(marks)), marks, seeds[order], np.arange(len(seeds))[order])
        tiles = decontamination.tile(len(document), len(item), runs, 3)
        assert sum(n for _, _, n in tiles) == brute_tiles(list(document), list(item), 3)
        assert all(list(document[d : d + n]) == list(item[i : i + n]) for d, i, n in tiles)


def test_texts_that_repeat_a_word_take_bounded_memory():
    """One word 16,000 times against an item of 2,000: 32 million pairs of equal seeds."""
    block = decontamination.index_benchmark(["same", "two"], ["again " * 2000, "again and " * 1000])
    batch = pa.RecordBatch.from_arrays([pa.array(["again " * 16_000, "again and " * 8000, "other words here"])], ["text"])
    tracemalloc.start()
    _, found = decontamination.matches(batch, block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == {0: [("same", 1.0, [(0, 0, 2000)])], 1: [("two", 1.0, [(0, 0, 2000)])]}
    assert peak < 300 << 20


def test_the_query_against_brute_force(spark):
    """Random texts of few words: long and short, reordered, repeated and none at all."""
    rng = np.random.default_rng(31)
    pool = [f"w{k}" for k in range(9)]
    items = [(k, [str(x) for x in rng.choice(pool, int(n))]) for k, n in enumerate(rng.integers(5, 22, 12))]
    documents = []
    for i in range(60):
        own = list(items[int(rng.integers(12))][1])
        cut = int(rng.integers(0, len(own)))
        words = [*rng.choice(pool, 5), *own[cut:], *rng.choice(pool, 3), *own[: cut - int(rng.integers(0, 4))]]
        documents.append((i, [str(w) for w in words][: int(rng.integers(3, 45))]))
    docs = frame(spark, [(i, " ".join(t).upper()) for i, t in documents])
    benchmark = spark.createDataFrame([(i, ", ".join(t)) for i, t in items], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontamination.contamination(docs, benchmark).collect()}
    for i, text in documents:
        covered = {str(k): brute_tiles(text, item, 5) / len(item) for k, item in items}
        hits = {k: c for k, c in covered.items() if c >= decontamination.MIN_COVERAGE}
        assert set(filter(None, found[i]["items"].split(","))) == set(hits) and found[i]["n_items"] == len(hits)
        assert found[i]["coverage"] == pytest.approx(max(hits.values(), default=0.0))
    assert 5 < sum(r["contaminated"] for r in found.values()) < 60


@pytest.mark.parametrize("block_words", [decontamination.BLOCK_WORDS, 5])
def test_contaminated_documents(spark, monkeypatch, block_words):
    monkeypatch.setattr(decontamination.benchmark_blocks, "__defaults__", (block_words,))
    first = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    words = first.split()
    rows = [
        (1, f"before {first} after"),
        (2, " ".join(["x", *words[6:], "and", *words[:6], "y"])),  # the halves changed places
        (3, first.upper().replace(" ", ", ")),
        (4, " ".join(words[:5])),  # less than half
        (5, "alpha beta"),
        (6, "two words"),
        *HARD,
    ]
    items = [(10, first), (11, None), (12, ""), (13, "Two words!"), (14, "..."), (15, first)]
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    found = {r["doc_id"]: r for r in decontamination.contamination(frame(spark, rows), benchmark).collect()}
    assert {i for i, r in found.items() if r["contaminated"]} == {1, 2, 3, 6}
    assert sorted(found[1]["items"].split(",")) == ["10", "15"] and found[6]["items"] == "13"
    assert found[2]["coverage"] == 1.0 and "10:1:7" in found[2]["tiles"]
    docs = frame(spark, rows)
    kept = decontamination.without_contaminated(docs, benchmark)
    assert kept.schema == docs.schema and kept.count() == len(rows) - 4
    assert decontamination.contamination(docs, benchmark.limit(0)).filter("contaminated").count() == 0
    assert decontamination.contamination(docs.limit(0), benchmark).count() == 0


@pytest.fixture(scope="module")
def toy():
    """A few pieces over the letters a, b, c and a space, with all bytes as fallback."""
    entries = [(f"<0x{i:02X}>", 0.0, "byte") for i in range(256)]
    scores = {"a": -6, "b": -7, "c": -9, "▁": -8, "ab": -4, "bc": -5, "abc": -8, "▁a": -3, "ca": -6, "aa": -7, "▁▁": -9}
    return pieces.make_vocabulary([("<unk>", 0.0, ""), *entries, *((p, float(s), "piece") for p, s in scores.items())])


def brute_paths(vocabulary, raw):
    if not raw:
        return [(0.0, [])]
    found = [(vocabulary.fallback + s, [int(vocabulary.byte_ids[raw[0]]), *p]) for s, p in brute_paths(vocabulary, raw[1:])]
    for n in range(1, len(raw) + 1):
        if raw[:n] in vocabulary.pieces:
            piece, score = vocabulary.pieces[raw[:n]]
            found += [(score + s, [piece, *p]) for s, p in brute_paths(vocabulary, raw[n:])]
    return found


def test_n_best_segmentations_are_those_of_brute_force(toy):
    rng = np.random.default_rng(4)
    coder = pieces.Pieces(toy, 5)
    texts = ["".join(rng.choice(list("abc d"), rng.integers(1, 9))) for _ in range(80)]
    text = tokens.text_bytes(pa.array(texts))
    ids, first, scores = coder.encode(text)
    for i, raw in enumerate(texts):
        expected = sorted(brute_paths(toy, b" " + raw.encode()), key=lambda p: -p[0])[:5]
        assert scores[i] == [s for s, _ in expected]
        assert (expected[0][0], list(ids[first[i] : first[i + 1]])) in brute_paths(toy, b" " + raw.encode())
        assert [s for s, _ in coder.n_best_ids(raw)] == scores[i]
    assert pieces.same_texts(coder.decode(ids, first), text).all()


def test_n_best_segmentations_in_full(toy):
    rng = np.random.default_rng(5)
    coder = pieces.Pieces(toy, 5)
    texts = ["", "aaaaaaaa", *("".join(rng.choice(list("abc d"), rng.integers(1, 9))) for _ in range(60))]
    ids, first, scores, paths = coder.encode_n_best(tokens.text_bytes(pa.array(texts)), with_paths=True)
    for i, raw in enumerate(texts):
        every = brute_paths(toy, b" " + raw.encode()) if raw else [(0.0, [])]
        own = [p.tolist() for p in paths[i]]
        assert own[0] == ids[first[i] : first[i + 1]].tolist()
        assert len(own) == len(scores[i]) == min(5, len(every)) and len(set(map(tuple, own))) == len(own)
        assert all((s, p) in every for s, p in zip(scores[i], own))


def test_the_query_has_every_id_of_the_n_best(spark):
    path = f"{DATA}/sf0.001"
    found = queries.queries()["op10_sentencepiece_n_best"](spark, path)
    assert {"ids_sha256", "nbest_hashes"} <= set(found.columns)
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(5)
    full = pieces.encode(docs, with_paths=True).withColumn("hashes", F.transform("nbest_ids", lambda x: F.xxhash64(x)))
    full = {r["doc_id"]: r for r in full.collect()}
    for r in found.filter(found.doc_id.isin(*full)).collect():
        own = full[r["doc_id"]]
        assert len(own["nbest_ids"]) == len(own["nbest_scores"]) and own["nbest_ids"][0] == own["ids"]
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, own["ids"])).encode()).hexdigest()
        assert r["nbest_hashes"] == ",".join(map(str, own["hashes"])) and len(set(own["hashes"])) == len(own["hashes"])


def test_encoded_texts_decode_to_themselves(spark):
    rows = [*HARD, (950, "▁ literal mark"), (951, "x" * 3000 + "ab" * 700)]
    docs = frame(spark, rows)
    encoded = pieces.encode(docs)
    found = encoded.collect()
    assert len(found) == len(rows) and all(r["round_trip"] for r in found)
    assert all(r["n_pieces"] == len(r["ids"]) for r in found)
    assert all(r["nbest_scores"] == [0.0] for r in found if r["n_pieces"] == 0)
    texts = sorted((str(r["doc_id"]), r["text"]) for r in pieces.decode(encoded).collect())
    assert texts == sorted((str(i), t or "") for i, t in rows)
    assert pieces.encode(docs.limit(0)).count() == 0
