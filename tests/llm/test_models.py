"""The trained models: exact counts, held-out accuracy, and rows without text, id or label."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from conftest import DATA
from frailscope.llm import language_model, quality_classifier, toxicity
from test_texts import HARD, folded_words, frame


def held(i, modulus, remainder):
    return i is not None and zlib.crc32(str(i).encode()) % modulus == remainder


def test_language_model_counts_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.geometric(0.1, 20))) for i in range(60)] + HARD
    counts = Counter()
    for i, text in rows:
        if not held(i, 7, 2):
            counts.update([*folded_words(text), None])
    total, distinct = sum(counts.values()), len(counts)
    expected = []
    for i, text in rows:
        own = [*folded_words(text), None]
        base = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in own)
        expected.append((i, held(i, 7, 2), len(own), sum(counts[t] > 0 for t in own), total, base))
    # Only three words are frequent, so most counts come from the join.
    found = language_model.language_model_scores(frame(spark, rows), frequent=3).collect()
    for ours, theirs in zip(sorted(map(tuple, found), key=repr), sorted(expected, key=repr), strict=True):
        assert ours[:5] == theirs[:5]
        assert ours[5] == pytest.approx(theirs[5], rel=1e-9)
        assert ours[6] < 0
    assert language_model.language_model_scores(frame(spark, rows).limit(0)).count() == 0


def test_class_probabilities_are_normalised():
    model = language_model._start()
    codes = np.concatenate([(c << 8) | np.arange(language_model.CLASSES) for c in (0, 5 << 8 | 7, 255 << 8 | 255)])
    chances = 10 ** language_model.class_log10(model, codes)
    assert chances.reshape(3, -1).sum(axis=1) == pytest.approx([1, 1, 1], abs=1e-5)


def test_contrastive_training_learns_what_follows():
    """Class 2 follows 1, and 3 follows 2, nine times of ten."""
    codes = np.array([(0 << 16) | (1 << 8) | 2, (1 << 16) | (2 << 8) | 3, (0 << 16) | (1 << 8) | 4])
    noise = np.ones(language_model.CLASSES) / language_model.CLASSES
    weight = np.array([9.0, 10.0, 1.0])
    start = language_model._start()
    trained = language_model.contrast(start, codes, weight, noise, 1, batches=150)
    before, after = (language_model.class_log10(m, codes) for m in (start, trained))
    assert (after > before).all() and after[0] > after[2]


def test_contrastive_training_visits_every_sequence():
    """Far more sequences than the fewest steps could draw: each context must still be met."""
    pairs = np.arange(256 * 256)
    codes = (pairs[:, None] << 8 | np.arange(1, 4)).ravel()
    weight = np.where(np.arange(len(codes)) % 1000, 1.0, 1e3)
    noise = np.ones(language_model.CLASSES) / language_model.CLASSES
    start = language_model._start()
    trained = language_model.contrast(start, codes, weight, noise, 1, batches=1)
    assert (np.abs(trained.context - start.context).max(axis=1) > 0.1).all()
    before, after = (language_model.class_log10(m, codes) for m in (start, trained))
    assert (after > before).mean() > 0.99


def tables(spark):
    return (spark.read.parquet(f"{DATA}/sf0.01/{name}.parquet") for name in ("documents", "labels"))


def test_quality_of_held_out_documents(spark):
    docs, labels = tables(spark)
    found = quality_classifier.score(docs, quality_classifier.fit(docs, labels))
    unseen = found.filter("held_out").join(labels, "doc_id").collect()
    right = sum(r["predicted"] == r["quality"] for r in unseen)
    assert len(unseen) > 100 and right >= 0.97 * len(unseen)


def test_toxicity_of_held_out_documents(spark):
    docs, labels = tables(spark)
    found = toxicity.score(docs, toxicity.fit(docs, labels))
    unseen = found.filter("held_out").join(labels, "doc_id").collect()
    # Thirty toxic documents are all there is to learn from here.
    pairs = [(a["score"], b["score"]) for a in unseen for b in unseen if a["toxic"] > b["toxic"]]
    assert sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs) > 0.7
    assert sum(r["predicted"] for r in unseen if not r["toxic"]) <= 0.05 * len(unseen)


def test_rare_byte_sequences_count(spark):
    """More sequences than a million, nearly all seen once, in few long documents."""
    rng = np.random.default_rng(8)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz0123456789"))
    rows = [(i, " ".join("".join(x) for x in rng.choice(letters, (3000, 10)))) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, rows), labels)
    trained = [w for i, t in rows if not held(i, 4, 2) for w in t.split()]
    grams = {(" " + w)[max(0, k - n) : k] for w in trained for k in range(1, len(w) + 2) for n in range(1, 7)}
    assert len(grams) > 1_000_000
    assert len(model.kneser_ney.grams) == len(grams)


def words(good, i):
    return f"the {'kind' if good else 'vile'} word number {i} of this text" + ("" if good else " $$$ ### vile vile")


@pytest.mark.parametrize("module, column", [(quality_classifier, "quality"), (toxicity, "toxic")])
def test_models_on_hard_rows(spark, module, column):
    rows = [(i, words(i % 3 > 0, i)) for i in range(90)]
    docs = frame(spark, rows + HARD)
    labels = [(i, int((i % 3 > 0) == (column == "quality")), "en") for i, _ in rows]
    labels += [(None, 1, "x"), (901, None, "x"), (5, None, "x"), (7, 0, "x"), (12345, 1, "x")]
    labels = spark.createDataFrame(labels, f"doc_id long, {column} int, text string")
    model = module.fit(docs, labels)
    found = module.score(docs, model).collect()
    assert len(found) == len(rows) + len(HARD)
    assert all(0 <= r["score"] <= 1 for r in found)
    assert len({r["score"] for r in found if r["doc_id"] in (900, 901)}) == 1
    clear = [r for r in found if r["doc_id"] is not None and r["doc_id"] < 90 and r["doc_id"] != 7]
    assert sum(r["predicted"] == int((r["doc_id"] % 3 > 0) == (column == "quality")) for r in clear) >= 85
    assert module.score(docs.limit(0), model).count() == 0
    unlabelled = module.fit(docs, labels.limit(0))
    assert {r["predicted"] for r in module.score(docs, unlabelled).collect()} == {1 if column == "quality" else 0}


def test_accepted_rows_keep_their_columns(spark):
    docs = frame(spark, HARD)
    assert quality_classifier.accepted(docs, 1.0).schema == docs.schema
    assert quality_classifier.accepted(docs, 1.0).count() == len(HARD)
    assert quality_classifier.accepted(docs, 0.0).count() == 0


def test_features_of_a_text():
    import pyarrow as pa

    from frailscope.llm.tokens import text_bytes

    row = dict(zip(quality_classifier.FEATURES, quality_classifier.features(text_bytes(pa.array(["Ab ab!\nx 12 #\n\nx 12 #"])))[0], strict=True))
    assert row["log_words"] == pytest.approx(math.log1p(8))
    assert row["distinct_words"] == pytest.approx(5 / 8)
    assert row["repeated_lines"] == pytest.approx(1 / 3)
    assert row["words_per_line"] == pytest.approx(8 / 3)
    assert row["bare_symbol_words"] == pytest.approx(2 / 8)
    assert re.sub(r"\s", "", "Ab ab!\nx 12 #\n\nx 12 #").count("#") / 13 == pytest.approx(row["symbols"])
