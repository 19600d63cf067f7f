"""Repeated runs of lines, by prefix doubling over line ids, in Spark SQL functions only.

Every line with a word has an id. Lines that occur once cannot be part of a repeated run and end
one; the others are ranked, and prefix doubling ranks the suffixes of the line sequences by their
first 2, 4, 8, ... lines: the rank of a suffix is the place in the suffix array where its interval
of equal prefixes begins. Suffixes with one rank at length k are an interval of the suffix array
with common prefixes of k lines or more.

A run counts if it has at least ``MIN_WORDS`` words. Every line of such a run lies in a shortest
stretch of that many words which begins at the run's start or ends at the line, so it is enough to compare
shortest stretches. A stretch of m lines is named by the ranks of the two overlapping power-of-two stretches it is made
of; stretches of one name are the copies of one run, and all but the first in corpus order are later
copies, whose lines are deleted. As a line has a word or more, lengths up to ``MIN_WORDS`` lines are
enough, however long the repeated runs are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frailscope.functions.joins import lookup_join
from frailscope.llm.tokens import WORD
from frailscope.sources.scratch import store

MIN_WORDS = 10
_RANGE_BITS = 12
_DOCUMENT = ["doc", "doc_print"]
_PLACE = [*_DOCUMENT, "line_no"]


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with (doc, doc_print): rows equal in id and text are one document; null ids are alike."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns(
        {
            "doc": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)),
            "doc_print": F.xxhash64(F.col("doc_id").isNull(), text),
        }
    )


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, doc_print, line_no, at, words, id_a, id_b): lines with a word, counted from 0; ``at`` counts all lines."""
    rows = _named(docs.select("doc_id", "text")).withColumn("lines", F.split(F.col("text").cast("string"), "\n"))
    marked = F.filter(
        F.transform("lines", lambda x, i: F.struct(x.alias("line"), i.alias("at"))),
        lambda s: s["line"].rlike(WORD),
    )
    line = F.col("s.line")
    return rows.select(*_DOCUMENT, F.posexplode(marked).alias("line_no", "s")).select(
        *_PLACE,
        F.col("s.at").alias("at"),
        F.regexp_count(line, F.lit(WORD)).cast("long").alias("words"),
        F.xxhash64(line).alias("id_a"),
        F.xxhash64(F.lit(1), line).alias("id_b"),
    )


def _running(amount: str, within: list[str], order: list[str]) -> Column:
    """The sum over the rows before."""
    frame = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(amount).over(frame), F.lit(0))


def _rows_before(counted: DataFrame, order: list[str]) -> DataFrame:
    """``counted`` (range, n, ...) with ``rank``: the sum of ``n`` before each row in the order of range, then ``order``.

    Running sums go over the 4096 ranges at most, and within each, so no task holds all rows.
    """
    before = counted.groupBy("range").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1))
    before = before.select("range", _running("n", ["one"], ["range"]).alias("before"))
    inside = counted.withColumn("inside", _running("n", ["range"], order))
    ranked = lookup_join(inside, before, "range").withColumn("rank", F.col("before") + F.col("inside"))
    return ranked.drop("range", "n", "before", "inside")


def _first_ranks(lines: DataFrame) -> DataFrame:
    """(id_a, id_b, rank): the lines before each repeated line in the order of ids, cut into ranges by their leading bits."""
    ids = lines.groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    ids = store(ids.withColumn("range", F.shiftright("id_a", 64 - _RANGE_BITS)), "ids")
    return _rows_before(ids, ["id_a", "id_b"])


def _doubled(ranks: DataFrame, k: int) -> DataFrame:
    """``ranks`` with the rank by 2k lines beside that by k; a suffix of fewer lines comes first.

    Pairs of ranks are counted first, so an interval of many suffixes is ordered as its few different pairs. A
    rank that very many different ones follow is cut into ranges like all others: ranges are about equal shares of the suffixes, and
    such a rank, which has many of them, takes many ranges.
    """
    along = Window.partitionBy(*_DOCUMENT).orderBy("line_no")
    here, there = f"rank_{k}", F.lead(f"rank_{k}", k).over(along)
    follows = F.lead("line_no", k).over(along) == F.col("line_no") + k
    pairs = store(ranks.withColumn("next", F.when(follows, there).otherwise(F.lit(-1))), "pairs")
    order = store(pairs.groupBy(here, "next").agg(F.count(F.lit(1)).alias("n")), "order")
    sizes = store(order.groupBy(here).agg(F.sum("n").alias("size")), "sizes")
    end = sizes.agg(F.max(F.col(here) + F.col("size"))).first()[0] or 1
    # Grows with (here, next): the next rank has more than ``size`` suffixes before it.
    place = F.col(here) + F.col("size") * ((F.col("next") + 1) / F.lit(end + 1.0))
    range_ = F.floor(place * F.lit((1 << _RANGE_BITS) / float(end))).cast("int")
    order = lookup_join(order, sizes, here).select(here, "next", "n", range_.alias("range"))
    order = _rows_before(order, [here, "next"]).withColumnRenamed("rank", f"rank_{2 * k}")
    return lookup_join(pairs, order, [here, "next"]).drop("next")


def _stretches(ranks: DataFrame, min_words: int) -> DataFrame:
    """(doc, doc_print, line_no, m): shortest stretches of enough words, from each line on and up to each line."""
    chain = F.col("line_no") - F.row_number().over(Window.partitionBy(*_DOCUMENT).orderBy("line_no"))
    rows = ranks.select(*_PLACE, "words", chain.alias("chain"))
    within = [*_DOCUMENT, "chain"]
    rows = rows.withColumn("start", _running("words", within, ["line_no"])).withColumn(
        "stop", F.col("start") + F.col("words")
    )
    whole = Window.partitionBy(*within)
    by_start = whole.orderBy("start").rangeBetween(min_words, Window.unboundedFollowing)
    by_stop = whole.orderBy("stop").rangeBetween(Window.unboundedPreceding, -min_words)
    rows = rows.withColumns(
        {
            "after": F.min("line_no").over(by_start),
            "before": F.max("line_no").over(by_stop),
            "chain_first": F.min("line_no").over(whole),
            "chain_last": F.max("line_no").over(whole),
            "chain_words": F.sum("words").over(whole),
        }
    )
    ahead = F.when(F.col("after").isNotNull(), F.col("after") - F.col("line_no")).when(
        F.col("chain_words") - F.col("start") >= min_words, F.col("chain_last") + 1 - F.col("line_no")
    )
    behind = F.when(F.col("before").isNotNull(), F.col("before") + 1).when(
        F.col("stop") >= min_words, F.col("chain_first")
    )
    forward = rows.select(*_PLACE, ahead.alias("m")).filter("m is not null")
    backward = rows.select(*_DOCUMENT, behind.alias("line_no"), (F.col("line_no") + 1 - behind).alias("m")).filter("m is not null")
    return forward.union(backward).distinct()


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, doc_print, deleted): per document the places of the lines that belong to later copies."""
    lines = store(_lines(docs), "lines")
    ranks = lookup_join(lines, _first_ranks(lines), ["id_a", "id_b"])
    ranks = ranks.select(*_PLACE, "at", "words", F.col("rank").alias("rank_1")).dropDuplicates(_PLACE)
    ranks = store(ranks, "ranked")
    k = 1
    while 2 * k <= min_words:
        ranks = store(_doubled(ranks, k), "ranked")
        k *= 2
    powers = [2**i for i in range(k.bit_length())]

    def rank_for(m: Column, prefix: str) -> Column:
        out = F.lit(None).cast("long")
        for p in powers:
            out = F.when(m >= p, F.col(f"{prefix}rank_{p}")).otherwise(out)
        return out

    def power_for(m: Column) -> Column:
        out = F.lit(1)
        for p in powers:
            out = F.when(m >= p, F.lit(p)).otherwise(out)
        return out

    stretches = store(_stretches(ranks, min_words), "stretches")
    m = F.col("m")
    plain = ranks.select(*_PLACE, *(f"rank_{p}" for p in powers))
    named = stretches.join(plain, _PLACE).select(*_PLACE, "m", rank_for(m, "").alias("left"))
    named = named.withColumn("tail_no", F.col("line_no") + m - power_for(m))
    tails = plain.withColumnRenamed("line_no", "tail_no")
    named = named.join(tails, [*_DOCUMENT, "tail_no"]).select(*_PLACE, "m", "left", rank_for(m, "").alias("right"))
    named = store(named, "named")
    name = ["m", "left", "right"]
    first = named.groupBy(*name).agg(F.min(F.struct(*_PLACE)).alias("first"), F.count(F.lit(1)).alias("copies"))
    first = first.filter("copies > 1").select(*name, "first")
    later = lookup_join(named, first, name).filter(F.struct(*_PLACE) != F.col("first"))
    covered = later.select(*_DOCUMENT, F.explode(F.sequence("line_no", F.col("line_no") + m - 1)).alias("line_no")).distinct()
    gone = covered.join(ranks.select(*_PLACE, "at"), _PLACE)
    return store(gone.groupBy(*_DOCUMENT).agg(F.sort_array(F.collect_list("at")).alias("deleted")), "deleted")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text, ...) with its columns, the later copies of repeated runs of lines taken out of the text.

    A run is a sequence of lines with words, compared exactly; lines without a word are passed over
    and stay. It is repeated if the same lines follow each other at an earlier place, by doc_id
    (null last), then line; places in one document count too and may overlap. Null texts stay null.
    Rows equal in id and text are one document and all get the same text; rows with the same id and
    other texts are ordered by a hash of the text. Adds ``n_lines`` (lines with a word) and ``n_deleted``.
    """
    gone = repeated_lines(docs, min_words)
    columns = docs.columns
    fresh = {c: f"__{c}" for c in columns}
    renamed = docs.select(F.col("doc_id"), F.col("text"), F.struct("*").alias("__row"))
    joined = lookup_join(_named(renamed), gone, _DOCUMENT, "left")
    lines = F.split(F.col("text").cast("string"), "\n")
    kept = F.filter(lines, lambda x, i: ~F.array_contains("deleted", i))
    text = F.when(F.col("deleted").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.coalesce(F.size(F.filter(lines, lambda x: x.rlike(WORD))), F.lit(0))
    out = [text.alias(fresh[c]) if c == "text" else F.col("__row")[c].alias(fresh[c]) for c in columns]
    counted = joined.select(
        *out,
        F.greatest(n_lines, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("deleted"), F.lit(0)).cast("long").alias("n_deleted"),
    )
    counted = counted.withColumn("n_deleted", F.greatest("n_deleted", F.lit(0)))
    return counted.select(*(F.col(fresh[c]).alias(c) for c in columns), "n_lines", "n_deleted")
