"""Rule-based quality by divergence from language references, in Spark SQL functions only.

Every document is counted once: words, symbols, repeated lines and repeated five-word windows, its
characters by class and its words: each common word of four languages, and all others in one bin.
The references are the same two histograms summed over all documents of each language. A document is
rejected if its nearest reference is too far away in Jensen-Shannon distance (base 2, so between 0
and 1), by either histogram. Short documents are too uneven to be judged, so each histogram asks for a
least number of words.

The bounds were measured on 10,000 documents. Of 3,200 labelled good ones long enough, the farthest had
0.267 by classes and 0.323 by words; tables of numbers, base64, capitals, source code and Cyrillic start at 0.53 by
classes, and a text without any common word has 0.344 by words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frailscope.llm.tokens import SPACE
from frailscope.sources.scratch import store

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
# Character classes as the characters that do not belong to them; the rest is "other".
CLASSES = {
    "lower": "[^a-z]+",
    "upper": "[^A-Z]+",
    "digit": "[^0-9]+",
    "stop": "[^.,;:?'\"()-]+",
    "non_ascii": "[\\x00-\\x7F]+",
}
# Common function words of four languages.
COMMON_WORDS = {
    "en": "the of and to a in is that for it with as was on are by this from at or an be".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como".split(),
}
CLASS_DISTANCE = 0.3
WORD_DISTANCE = 0.335
CLASS_WORDS = 50
COMMON_WORDS_FROM = 100

_SYMBOLS = "[#*$%&|<>]"


def _counted(docs: DataFrame) -> DataFrame:
    common = ", ".join(f"'{w}'" for w in sorted({w for words in COMMON_WORDS.values() for w in words}))
    space = SPACE.replace("\\", "\\\\")
    rows = docs.select(
        F.col("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("words", F.expr(f"filter(split(text, '{space}'), w -> w <> '')"))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    window = ", ".join(f"words[i + {k}]" for k in range(5))
    rows = rows.withColumn(
        "windows",
        F.expr(f"if(size(words) >= 5, transform(sequence(0, size(words) - 5), i -> xxhash64({window})), array())"),
    )
    # Only texts in which some window occurs twice are sorted to find where.
    rows = rows.withColumn(
        "sorted",
        F.expr(
            "if(size(array_distinct(windows)) < size(windows),"
            " array_sort(transform(windows, (x, i) -> struct(x as x, i as i))), array())"
        ),
    )
    rows = rows.withColumn(
        "again",
        F.expr(
            "array_sort(transform(filter(transform(sorted, (s, k) -> struct(s.i as i,"
            " coalesce(s.x = get(sorted, k - 1).x, false) or coalesce(s.x = get(sorted, k + 1).x, false) as twice)),"
            " s -> s.twice), s -> s.i))"
        ),
    )
    rows = rows.withColumn("hits", F.expr(f"array_sort(filter(transform(words, w -> lower(w)), w -> w in ({common})))"))
    rows = rows.withColumn("common", F.expr("array_distinct(hits)"))
    rows = rows.withColumn("places", F.expr("transform(common, w -> array_position(hits, w))"))
    characters = F.length(F.array_join("words", "")).cast("long")
    classes = [
        F.length(F.regexp_replace("text", pattern, "")).cast("long").alias(name) for name, pattern in CLASSES.items()
    ]
    return rows.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        characters.alias("word_chars"),
        F.regexp_count("text", F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "aggregate(transform(again, (p, k) -> least(5, coalesce(get(again, k + 1) - p, 5))), 0L, (a, x) -> a + x)"
        ).alias("n_repeat_words"),
        *classes,
        "common",
        F.expr(
            "transform(places, (p, k) -> coalesce(get(places, k + 1), size(hits) + 1L) - p)"
        ).alias("times"),
        F.size("hits").cast("long").alias("n_common"),
    )


def _references(counted: DataFrame) -> tuple[dict[str, dict[str, float]], dict[str, dict[str, float]]]:
    """Shares of character classes and of common words among all words by language, from all documents.

    The collected rows are bounded by the fixed lists above.
    """
    known = counted.filter(F.col("lang").isin(list(COMMON_WORDS)))
    sums = known.groupBy("lang").agg(*(F.sum(c).alias(c) for c in ("n_words", "word_chars", *CLASSES))).collect()
    classes, words = {}, {}
    for row in sums:
        if row["word_chars"]:
            shares = {c: row[c] / row["word_chars"] for c in CLASSES}
            classes[row["lang"]] = shares | {"other": 1 - sum(shares.values())}
            words[row["lang"]] = {}
    totals = {row["lang"]: row["n_words"] for row in sums}
    pairs = known.select("lang", F.explode(F.arrays_zip("common", "times")).alias("pair"))
    found = pairs.groupBy("lang", "pair.common").agg(F.sum("pair.times").alias("times")).collect()
    for row in found:
        words[row["lang"]][row["common"]] = row["times"] / totals[row["lang"]]
    return classes, words


def _halved(p: Column, q: Column) -> Column:
    """The part of a Jensen-Shannon divergence that one entry adds, 0 log 0 being 0."""
    middle = (p + q) / 2

    def part(x: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / middle)).otherwise(0.0) / 2

    return part(p) + part(q)


def _distance(divergence: Column) -> Column:
    return F.round(F.sqrt(F.greatest(divergence, F.lit(0.0))), 6)


def _class_distance(reference: dict[str, float]) -> Column:
    total = F.col("word_chars")
    other = total - sum(F.col(c) for c in CLASSES)
    shares = {c: F.col(c) / total for c in CLASSES} | {"other": other / total}
    return _distance(sum(_halved(shares[c], F.lit(q)) for c, q in reference.items()))


def _word_distance(reference: dict[str, float]) -> Column:
    pairs = [F.lit(x) for pair in sorted(reference.items()) for x in pair]
    shares = F.create_map(*pairs).cast("map<string,double>")

    def own(word: Column, times: Column) -> Column:
        q = F.coalesce(F.try_element_at(shares, word), F.lit(0.0))
        return _halved(times / F.col("n_words"), q) - q / 2

    # Common words the document lacks add half their share, which the constant counts for all of them.
    common = sum(reference.values())
    others = _halved(1 - F.col("n_common") / F.col("n_words"), F.lit(1 - common))
    return _distance(F.aggregate(F.zip_with("common", "times", own), others + F.lit(common / 2), lambda a, x: a + x))


def _nearest(distances: list[Column]) -> Column:
    if not distances:
        return F.lit(None).cast("double")
    return F.least(*distances) if len(distances) > 1 else distances[0]


def quality_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance,
    word_distance, base_failed, kept) for every row of ``docs`` (doc_id, text, lang).

    A null text counts as empty; an empty one fails by its length. A distance is null if the
    document has too few words for it (50 for classes, 100 for common words), or if no document has one of
    the four languages; it then rejects nothing. ``lang`` only says which references a document
    adds to; it is not needed to judge one. Rows are judged one by one.
    """
    counted = store(_counted(docs), "counted")
    classes, words = _references(counted)
    class_distance = F.when(
        F.col("n_words") >= CLASS_WORDS, _nearest([_class_distance(r) for _, r in sorted(classes.items())])
    )
    word_distance = F.when(
        F.col("n_words") >= COMMON_WORDS_FROM, _nearest([_word_distance(r) for _, r in sorted(words.items())])
    )
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    judged = counted.withColumns(
        {"class_distance": class_distance, "word_distance": word_distance, "base_failed": base_failed}
    )
    far = F.coalesce(F.col("class_distance") > CLASS_DISTANCE, F.lit(False)) | F.coalesce(
        F.col("word_distance") > WORD_DISTANCE, F.lit(False)
    )
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "class_distance",
        "word_distance",
        "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"),
    )
