"""Language-model scores from a log-bilinear model trained with noise-contrastive estimation.

The corpus is counted first: every token of the training documents, in Spark. The most frequent
words are classes of their own; all others fall into classes by their last two bytes, which tell
languages and word forms apart. A second pass counts the sequences of three classes. They are the
training data of the log-bilinear model, which meets every one of them in each round: the vector of the next class is predicted as a sum of the
vectors of the two before it, each scaled by its position. Training runs on the executors, each
part of the sequences by itself, and the parameters are averaged between rounds. Noise-contrastive
estimation needs no sums over all classes; scoring does them as matrix products over the distinct
contexts of a batch, so the probabilities are exactly normalised.

The probability of a word is that of its class times its share of the class, from the counts with one
added, where one more part is kept for words never seen. The counts of the ``frequent`` most frequent
words are sent to all executors; the tokens beyond are joined to the count table.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frailscope.llm.tokens import (
    Text,
    Words,
    crc_remainder,
    map_text,
    mix,
    segments,
    signed,
    text_bytes,
    words_of,
)
from frailscope.sources.scratch import store

CLASSES = 256
SINGLE = 160  # class 0 is the end of a text, 1 to 159 are the most frequent words
SIZE = 32
NOISE = 10
PARTS = 8
ROUNDS = 3
BATCHES = 200
BATCH = 512
PART_ROWS = 100_000
RATE = 0.15
FREQUENT = 1 << 18


class Lexicon(NamedTuple):
    """What scoring must know of the counts; its size is bounded by the parameters above."""

    tokens: np.ndarray  # sorted hashes of the frequent words
    counts: np.ndarray
    singles: np.ndarray  # sorted hashes of the words that are a class, and the class of each
    single_class: np.ndarray
    end_count: int
    total: int
    distinct: int
    class_size: np.ndarray  # per class: occurrences and different words, 1 and 0 for single words
    class_words: np.ndarray


class Model(NamedTuple):
    """Log-bilinear parameters: context and target vectors, position scales, biases."""

    context: np.ndarray
    target: np.ndarray
    scale: np.ndarray
    bias: np.ndarray


def _buckets(text: Text, words: Words) -> np.ndarray:
    """The class of each word by its last two bytes, A-Z as a-z."""
    last = text.data[words.end - 1].astype(np.uint64)
    before = text.data[np.maximum(words.end - 2, words.start)].astype(np.uint64)
    pair = [np.where((b >= 65) & (b <= 90), b + np.uint64(32), b) for b in (last, before)]
    return (mix(pair[0] * np.uint64(256) + pair[1]) % np.uint64(CLASSES - SINGLE)).astype(np.int64) + SINGLE


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in sorted ``keys``, -1 where missing."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _classes(lexicon: Lexicon, text: Text, words: Words) -> np.ndarray:
    found = _find(lexicon.singles, words.hashes)
    out = _buckets(text, words)
    out[found >= 0] = lexicon.single_class[found[found >= 0]]
    return out


def _sequences(classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each class with the two before it, first code of each text), an end behind each text."""
    texts = len(first) - 1
    starts = first + 3 * np.arange(texts + 1)  # two starts before and one end behind each text
    padded = np.zeros(int(starts[-1]), np.int64)
    owner = np.repeat(np.arange(texts), np.diff(first))
    padded[np.arange(len(classes)) + 3 * owner + 2] = classes
    codes = (padded[:-2] << 16) | (padded[1:-1] << 8) | padded[2:] if len(padded) else np.zeros(0, np.int64)
    keep = np.ones(len(codes), bool)
    for back in (1, 2):
        inner = starts[1:-1] - back
        keep[inner[inner < len(codes)]] = False
    return codes[keep], first + np.arange(texts + 1)


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, bucket, n) of all words of ``docs``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = text_bytes(batch.column("text"))
        words = words_of(text)
        token, lead, n = np.unique(words.hashes, return_index=True, return_counts=True)
        bucket = _buckets(text, words)[lead]
        return pa.RecordBatch.from_arrays([signed(token), pa.array(bucket), pa.array(n)], ["token", "bucket", "n"])

    counted = map_text(docs, run, "token long, bucket long, n long")
    return counted.groupBy("token", "bucket").agg(F.sum("n").alias("n"))


def make_lexicon(counts: DataFrame, texts: int, frequent: int = FREQUENT) -> Lexicon:
    top = counts.orderBy(F.desc("n"), "token").limit(frequent).toArrow()
    token, bucket, n = (top.column(c).to_numpy() for c in ("token", "bucket", "n"))
    ranked = np.lexsort((token, -n))
    token, n, bucket = token[ranked].view(np.uint64), n[ranked], bucket[ranked]
    single = min(SINGLE - 1, len(token))
    size, different = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for row in counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():
        size[row["bucket"]], different[row["bucket"]] = row["n"], row["words"]
    total, distinct = int(size.sum()) + texts, int(different.sum()) + (texts > 0)
    np.subtract.at(size, bucket[:single], n[:single])
    np.subtract.at(different, bucket[:single], 1)
    order, lead = np.argsort(token), np.argsort(token[:single])
    return Lexicon(
        token[order], n[order], token[:single][lead], lead + 1, texts, total, distinct, size, different
    )


def count_sequences(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(code, n) of the sequences of three classes; at most CLASSES ** 3 rows."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = text_bytes(batch.column("text"))
        words = words_of(text)
        codes, _ = _sequences(_classes(shared.value, text, words), words.first)
        code, n = np.unique(codes, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

    return map_text(docs, run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _summed(classes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` by class."""
    order = np.argsort(classes, kind="stable")
    ranked = classes[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    out = np.zeros((CLASSES, values.shape[1]))
    out[ranked[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


def contrast(model: Model, codes: np.ndarray, weight: np.ndarray, noise: np.ndarray, seed: int, batches: int = BATCHES) -> Model:
    """Noise-contrastive steps in full passes over the class sequences, at least ``batches`` of them.

    A pass visits every sequence, heavy ones in as many equal shares as keep a visit at the mean
    weight or below, so there are at most two visits a sequence and each counts by its ``weight``.
    Each visited class is told apart from NOISE classes drawn from ``noise``; steps are scaled by the
    root of the summed squared gradients.
    """
    rng = np.random.default_rng(seed)
    parameters = [p.copy() for p in model]
    context, target, scale, bias = parameters
    squares = [np.full(p.shape, 1e-3) for p in parameters]
    times = weight * (len(codes) / weight.sum())
    visits = np.ceil(times).astype(np.int64)
    spot, part = np.repeat(np.arange(len(codes)), visits), np.repeat(times / visits, visits)
    order = rng.permutation(np.tile(np.arange(len(spot)), max(1, -(-batches * BATCH // len(spot)))))
    ladder = np.cumsum(noise)
    offset = np.log(NOISE * noise)
    for start in range(0, len(order), BATCH):
        visit = order[start : start + BATCH]
        code, size = codes[spot[visit]], len(visit)
        before = np.stack([code >> 16, (code >> 8) & 255])
        drawn = np.minimum(np.searchsorted(ladder, rng.random((size, NOISE))), CLASSES - 1)
        guess = np.concatenate([(code & 255)[:, None], drawn], axis=1)
        predicted = scale[0] * context[before[0]] + scale[1] * context[before[1]]
        vectors = target[guess]
        line = np.einsum("bkd,bd->bk", vectors, predicted) + bias[guess] - offset[guess]
        error = -1 / (1 + np.exp(-np.clip(line, -30, 30)))
        error[:, 0] += 1
        error *= part[visit][:, None] / BATCH
        back = np.einsum("bk,bkd->bd", error, vectors)
        gradients = [np.zeros_like(p) for p in parameters]
        for i in (0, 1):
            gradients[0] += _summed(before[i], back * scale[i])
            gradients[2][i] = (back * context[before[i]]).sum(axis=0)
        rows = np.repeat(np.arange(size), NOISE + 1)
        weights = np.bincount(guess.ravel() * size + rows, error.ravel(), CLASSES * size).reshape(CLASSES, size)
        gradients[1] = weights @ predicted
        gradients[3] = weights.sum(axis=1)
        for p, s, g in zip(parameters, squares, gradients, strict=True):
            s += g * g
            p += RATE * g / np.sqrt(s)
    return Model(*parameters)


def _start() -> Model:
    rng = np.random.default_rng(11)
    vectors = [rng.normal(0, 0.1, (CLASSES, SIZE)) for _ in range(2)]
    return Model(*vectors, np.array([np.full(SIZE, 0.5), np.ones(SIZE)]), np.zeros(CLASSES))


def _improving(shared, noise: np.ndarray, seed: int):
    """One round of training on one part of the sequences, of about PART_ROWS rows at most."""

    def improve(table):
        codes, n = table.column("code").to_numpy(), table.column("n").to_numpy()
        order = np.argsort(codes)
        part = int(table.column("part")[0].as_py())
        found = contrast(shared.value, codes[order], n[order].astype(float), noise, seed + part)
        flat = pa.array([np.concatenate([p.ravel() for p in found])], pa.list_(pa.float64()))
        return pa.table({"part": pa.array([part], pa.int32()), "weight": [float(n.sum())], "flat": flat})

    return improve


def train(sequences: DataFrame) -> Model:
    """The model of counted sequences (code, n), averaged over the parts after each round.

    There are as many parts as the sequences need at PART_ROWS each, PARTS at least.
    """
    spark = sequences.sparkSession
    model = _start()
    target = F.col("code").bitwiseAND(F.lit(CLASSES - 1))
    noise = np.ones(CLASSES)  # one more for each class, so that none has probability 0
    for row in sequences.groupBy(target.alias("c")).agg(F.sum("n").alias("n")).collect():
        noise[row["c"]] += row["n"]
    noise /= noise.sum()
    model = model._replace(bias=np.log(noise))
    n_parts = max(PARTS, -(-sequences.count() // PART_ROWS))
    parts = sequences.select(F.pmod(F.xxhash64("code"), F.lit(n_parts)).cast("int").alias("part"), "code", "n")
    parts = store(parts.repartition(n_parts, "part").sortWithinPartitions("part", "code"), "parts")
    shapes = [p.shape for p in model]
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        improve = _improving(shared, noise, 1000 * turn)
        rows = parts.groupBy("part").applyInArrow(improve, "part int, weight double, flat array<double>").collect()
        if not rows:
            break
        rows = sorted(rows, key=lambda r: r["part"])
        flat = np.average([r["flat"] for r in rows], axis=0, weights=[r["weight"] for r in rows])
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        model = Model(*(p.reshape(s) for p, s in zip(np.split(flat, ends[:-1]), shapes, strict=True)))
    return model


def class_log10(model: Model, codes: np.ndarray) -> np.ndarray:
    """Normalised log10 probabilities of the last class of each code, given the first two."""
    pair, which = np.unique(codes >> 8, return_inverse=True)
    predicted = model.scale[0] * model.context[pair >> 8] + model.scale[1] * model.context[pair & 255]
    predicted = predicted.astype(np.float32)
    out = np.zeros(len(codes))
    order = np.argsort(which, kind="stable")
    bounds = np.searchsorted(which[order], np.arange(0, len(pair) + 4096, 4096))
    for i, (b, e) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        some = predicted[4096 * i : 4096 * (i + 1)]
        line = some @ model.target.T.astype(np.float32) + model.bias.astype(np.float32)
        line -= line.max(axis=1, keepdims=True)
        norm = np.log(np.exp(line).sum(axis=1, dtype=np.float64))
        rows = order[b:e]
        own = which[rows] - 4096 * i
        out[rows] = line[own, codes[rows] & 255] - norm[own]
    return out / np.log(10)


def _scored(batch: pa.RecordBatch, lexicon: Lexicon, model: Model) -> pa.RecordBatch:
    text = text_bytes(batch.column("text"))
    words = words_of(text)
    classes = _classes(lexicon, text, words)
    codes, first = _sequences(classes, words.first)
    sequence = segments(class_log10(model, codes), first)
    found = _find(lexicon.tokens, words.hashes)
    frequent = found >= 0
    added = np.zeros(len(found))
    added[frequent] = np.log10(lexicon.counts[found[frequent]] + 1.0)
    share = np.where(classes >= SINGLE, added, 0.0)
    norm = np.log10(lexicon.class_size + lexicon.class_words + 1.0)
    share -= np.where(classes >= SINGLE, norm[classes], 0.0)
    rare = np.flatnonzero(~frequent)
    bounds = np.searchsorted(rare, words.first).astype(np.int32)
    ends = np.log10(lexicon.end_count + 1.0)
    known_end = int(lexicon.end_count > 0)
    n = words.counts + 1
    base = segments(added, words.first) + ends - n * np.log10(lexicon.total + lexicon.distinct + 1.0)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            pa.array(n),
            pa.array(segments(frequent.astype(np.int64), words.first) + known_end),
            pa.array(base),
            pa.array(sequence + segments(share, words.first)),
            pa.ListArray.from_arrays(pa.array(bounds), signed(words.hashes[rare])),
        ],
        ["doc_id", "n_tokens", "n_known", "base_score", "score", "rare"],
    )


def language_model_scores(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row (doc_id, text).

    A seventh of the documents, by crc32 of the id, is held out of counting and training; a row
    without an id is not. ``base_score`` is the log10 probability under the counts with one added,
    ``score`` under the model. A null text is an empty one and has its end as only token. Rows
    are scored one by one; rows that repeat an id all count.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held_out = F.coalesce(crc_remainder("doc_id", 7) == 2, F.lit(False))
    training = plain.filter(~held_out)
    counts = store(count_tokens(training), "counts")
    lexicon = make_lexicon(counts, training.count(), frequent)
    model = train(store(count_sequences(training, lexicon), "sequences"))
    shared = spark.sparkContext.broadcast((lexicon, model))
    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double, rare array<long>"
    scored = map_text(plain, lambda batch: _scored(batch, *shared.value), schema)
    scored = store(scored.withColumn("row", F.monotonically_increasing_id()), "scored")

    # Tokens beyond the frequent ones get their counts by a join. The frequent ones of the table are
    # left out by their rank, so the join meets no token that many documents share.
    least = int(lexicon.counts.min()) if len(lexicon.counts) else 0
    rest = counts.filter(F.col("n") <= least) if len(lexicon.tokens) >= frequent else counts.limit(0)
    pairs = scored.select("row", F.explode("rare").alias("token"))
    pairs = pairs.groupBy("row", "token").agg(F.count(F.lit(1)).alias("times"))
    more = (
        pairs.join(rest.select("token", "n"), "token")
        .groupBy("row")
        .agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("more"))
    )
    result = scored.drop("rare").join(store(more, "more"), "row", "left")
    extra = F.coalesce("more", F.lit(0.0))
    return result.select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(lexicon.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + extra).alias("base_score"),
        (F.col("score") + extra).alias("score"),
    )
