"""Near-duplicate documents by one-permutation hashing, banded buckets and star-shaped candidates.

One pass sketches every document: its distinct 5-word shingles fall into 128 bins, each bin keeps
its smallest hash, and an empty bin borrows from the first filled bin of its own random order
(optimal densification). Four bins make a band, 32 bands make the bucket keys. Two documents with a
Jaccard similarity of 0.75 share no bucket with a probability of about 5 in a million.

Documents with equal shingle sets are one class, named by a hash of the set and compared once. Every
bucket is a star: its centre is its class with the most company over all buckets, and each class is
compared with the centre of its buckets that has the most company, its pivot; so a group has nearly always one
pivot, and most of the group is joined to it. In buckets that still hold several components, the members are
compared with the bucket's own centre too. Two sets that are similar to each other but not to their common
centre must differ from it in the same way, so the differences from a centre are sketched like the sets
themselves, and classes that agree in a bin of those sketches are a star again, around the class nearest
to the old centre. Later rounds ask for two and for four agreeing bins, which splits what one bin left together.
Every round makes at most as many pairs as there are bucket entries, whatever the size of a group, and a pair
is left out only if the sizes of the sets, or how both differ from the centre, prove it not similar. All links are
confirmed on the full sets. ``every_pair`` compares all components of a bucket instead, which grows with the square of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frailscope.functions.joins import lookup_join
from frailscope.llm.components import connected_components, merged_components
from frailscope.llm.tokens import give_back, grams, map_text, mix, pieces_of, segments, short_batches, signed, text_bytes, words_of
from frailscope.sources.scratch import scratch_scope, store

SHINGLE_WORDS = 5
BINS = 128
ROWS_PER_BAND = 4
SIMILAR_PERCENT = 75
_MEMBERS_PER_COPY = 64
# Bins of the sketches of differences, and how many neighbouring ones must agree, round by round.
_DIFFERENCE_BINS = 64
ROUNDS = (1, 2, 4)

# How a set differs from its pivot: the common part, what the pivot has beyond it, and for the two
# differences the occupied ones of 1024 bins (16 longs each) and the elements beyond one per bin.
_LONGS = 16
_BITS = [f"{side}_{i}" for side in ("extra", "lack") for i in range(_LONGS)]
_BOUND_COLUMNS = ["common", "lacking", "extra_more", "lack_more", *_BITS]

_rng = np.random.default_rng(7)
_PROBES = np.array([_rng.permutation(BINS) for _ in range(BINS)])
_BANDS = BINS // ROWS_PER_BAND
_ROW_FACTORS = _rng.integers(1 << 62, 1 << 64, (_BANDS, ROWS_PER_BAND), dtype=np.uint64) | np.uint64(1)


def _at_most(longs: Sequence[object], extra_more: str, lack_more: str) -> str:
    """How much two sets with the same pivot have in common at most.

    Of the pivot what neither lacks, and of their own elements one per bin that both occupy and those beyond one per bin.
    """

    def of_both(how: str, more: str) -> str:
        return f"{how}({more.format('')}, {more.format('_a')})"

    shared = " + ".join(f"bit_count(extra_{i} & extra_{i}_a)" for i in longs)
    lacked = " + ".join(f"bit_count(lack_{i} | lack_{i}_a)" for i in longs)
    return (
        f"least(common, common_a) + least(n - common, n_a - common_a, {of_both('least', extra_more)} + {shared})"
        f" - greatest(0, {of_both('greatest', lack_more)} + {lacked} - greatest(lacking, lacking_a))"
    )


_MOST_COMMON = _at_most(range(_LONGS), "extra_more{0}", "lack_more{0}")
# The same with one of 128 bins for 8 of the others: never less, and few enough columns to go through a join with every key.
_ROUGH_BITS = {f"{side}_any_{k}": [f"{side}_{i}" for i in range(k, _LONGS, 2)] for side in ("extra", "lack") for k in (0, 1)}
_ROUGHLY_COMMON = _at_most(
    ["any_0", "any_1"],
    "n{0} - common{0} - bit_count(extra_any_0{0}) - bit_count(extra_any_1{0})",
    "lacking{0} - bit_count(lack_any_0{0}) - bit_count(lack_any_1{0})",
)
_ROUGH_COLUMNS = ["n", "common", "lacking", *_ROUGH_BITS]


def shingle_sets(batch: pa.RecordBatch, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and where each text begins."""
    hashes, first = grams(words_of(text_bytes(batch.column("text"))), size)
    for i in range(len(first) - 1):
        hashes[first[i] : first[i + 1]].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[first[:-1][first[:-1] < len(hashes)]] = True
    return hashes[new], np.concatenate([[0], np.cumsum(new)])[first]


def one_permutation(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Densified bins, one row per non-empty set."""
    counts = np.diff(first)
    filled = np.flatnonzero(counts)
    row = np.repeat(np.arange(len(filled)), counts[filled])
    cell = row * BINS + (hashes >> np.uint64(64 - 7)).astype(np.int64)
    lead = np.ones(len(cell), bool)
    lead[1:] = cell[1:] != cell[:-1]
    bins = np.zeros(len(filled) * BINS, np.uint64)
    has = np.zeros(len(filled) * BINS, bool)
    bins[cell[lead]] = hashes[lead]
    has[cell[lead]] = True
    bins, has = bins.reshape(-1, BINS), has.reshape(-1, BINS)
    rows, columns = np.nonzero(~has)
    out = bins.copy()
    for attempt in range(BINS):
        if not len(rows):
            break
        donor = _PROBES[columns, attempt]
        good = has[rows, donor]
        out[rows[good], columns[good]] = bins[rows[good], donor[good]]
        rows, columns = rows[~good], columns[~good]
    return out


def set_prints(hashes: np.ndarray, first: np.ndarray, salt: int) -> np.ndarray:
    """A fingerprint of each text's set."""
    marks = mix(hashes ^ (_ROW_FACTORS[0, salt] << np.uint64(1)))
    return mix(segments(marks, first))


def _sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
    hashes, first = shingle_sets(batch)
    counts = np.diff(first)
    rows = one_permutation(hashes, first).reshape(-1, _BANDS, ROWS_PER_BAND)
    keys = mix((rows * _ROW_FACTORS).sum(axis=2, dtype=np.uint64))
    bounds = np.concatenate([[0], np.cumsum((counts > 0) * _BANDS)]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            pa.array(counts),
            signed(set_prints(hashes, first, 1)),
            signed(set_prints(hashes, first, 2)),
            pa.ListArray.from_arrays(pa.array(bounds), signed(keys.ravel())),
        ],
        ["doc_id", "n_shingles", "print_a", "print_b", "keys"],
    )


def _occupied(hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """(elements beyond one per bin, occupied bins as longs)."""
    bins = np.zeros(64 * _LONGS, bool)
    bins[(hashes & np.uint64(64 * _LONGS - 1)).astype(np.int64)] = True
    return len(hashes) - int(bins.sum()), np.packbits(bins, bitorder="little").view(np.int64)


def near_duplicates(docs: DataFrame, every_pair: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for the rows of ``docs`` (doc_id, text, ...).

    Words are lower-cased (A-Z) and split at ASCII white space. Two documents are linked if 100
    times the common shingles are at least 75 times all shingles of both; a text of one to four
    words has its whole sequence as its only shingle. ``component_id`` is the smallest doc_id that
    can be reached over links, and ``kept`` marks that document.

    Null and empty texts have no shingles and are linked with nothing. Classes are named by their sets, so rows
    that repeat a doc_id are judged by the text of each, and those of one id may be in several components. A
    row without a doc_id cannot be named in a link: its component_id is null and it is kept.
    """
    found = _judged(docs, named=True, every_pair=every_pair)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every component: that of the smallest doc_id (null last), then by a digest of the row.

    Rows with the same id and text count as one document, of which one row stays; rows without an id are linked like any
    other. Rows without shingles all stay.
    """
    key = ["row_a", "row_b"]
    digest = [F.xxhash64("doc_id", "text").alias("row_a"), F.xxhash64(F.lit(1), "doc_id", "text").alias("row_b")]
    judged = store(_judged(docs.select("doc_id", "text"), named=False, more=digest).filter("n_shingles > 0"), "judged")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *key)
    first = judged.groupBy("component").agg(F.min(order).alias("first"))
    gone = lookup_join(judged, first, "component").filter(~order.eqNullSafe(F.col("first")))
    keyed = docs.select(F.struct("*").alias("row"), *digest)
    stay = lookup_join(keyed, gone.select(*key).distinct(), key, "left_anti")
    # Repeated rows are told from the rest by their counts, so no other text is moved for them.
    several = store(judged.groupBy(*key).count().filter("count > 1").select(*key), "several")
    if not several.isEmpty():
        once = lookup_join(stay, several, key, "left_semi").dropDuplicates(key)
        stay = lookup_join(stay, several, key, "left_anti").unionByName(once)
    return stay.select("row.*")


def _judged(docs: DataFrame, named: bool, every_pair: bool = False, more: Sequence[Column] = ()) -> DataFrame:
    """(doc_id, n_shingles, component, component_id[, more]) per row; ``component`` is null without shingles.

    With ``named``, rows without a doc_id are in no component.
    """
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more
    )
    names = plain.columns[2:]
    extra = "".join(f", {n} long" for n in names)

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = _sketch(batch)
        for name in names:
            out = out.append_column(name, batch.column(name))
        return out

    schema = f"doc_id long, n_shingles long, print_a long, print_b long, keys array<long>{extra}"
    sketches = map_text(plain, sketch, schema).withColumn("class", F.xxhash64("print_a", "print_b", "n_shingles"))
    sketches = store(sketches, "sketches")
    linked = (F.col("n_shingles") > 0) & (F.col("doc_id").isNotNull() if named else F.lit(True))
    classes = sketches.filter(linked).groupBy("class").agg(
        F.min("doc_id").alias("least_id"),
        F.min("print_a").alias("print_a"),
        F.min("n_shingles").alias("n"),
        F.min_by("keys", "doc_id").alias("keys"),
        F.first("keys").alias("any_keys"),
    )
    classes = store(classes.withColumn("keys", F.coalesce("keys", "any_keys")).drop("any_keys"), "classes")
    components = connected_components(_links(plain, classes, every_pair))
    labels = classes.select("class", "least_id").join(components.withColumnRenamed("node", "class"), "class", "left")
    labels = store(labels.withColumn("component", F.coalesce("component", "class")), "labels")
    smallest = labels.groupBy("component").agg(F.min("least_id").alias("component_id"))
    labels = lookup_join(labels.drop("least_id"), smallest, "component")
    full = lookup_join(sketches.drop("keys").withColumn("class", F.when(linked, F.col("class"))), labels, "class", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return full.select("doc_id", "n_shingles", "component", own.alias("component_id"), *names)


def _links(docs: DataFrame, classes: DataFrame, every_pair: bool) -> DataFrame:
    """Confirmed links (a, b) between classes, enough to connect all that are linked."""
    entries = classes.select("class", "n", F.explode("keys").alias("key"))
    shared = (
        entries.groupBy("key")
        .agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count(F.lit(1)).alias("size"))
        .filter("lo < hi")
        .select("key", "size")
    )
    live = store(entries.join(shared, "key"), "live")
    company = store(live.groupBy("class", "n").agg(F.sum("size").alias("company")), "company")
    texts = _texts(docs, classes.join(company.select("class"), "class", "left_semi"))
    live = store(live.drop("n", "size").join(company, "class"), "known")
    most = F.max(F.struct("company", (-F.col("class").cast("decimal(20,0)")).alias("minus"), "class", "n"))
    centres = live.groupBy("key").agg(most.alias("centre"))
    centres = centres.select("key", F.col("centre.class").alias("a"), F.col("centre.n").alias("n_a"), F.col("centre.company").alias("of"))
    centres = store(centres, "centres")
    stars = store(live.join(centres, "key").filter((F.col("a") != F.col("class")) & _near("n", "n_a")), "spokes")
    pivots = stars.groupBy(F.col("class").alias("b")).agg(F.max_by("a", F.struct("of", "a")).alias("a"))
    compared = [store(_compare(texts, store(pivots.select("a", "b"), "pivots")), "compared")]

    def links() -> DataFrame:
        found = compared[0]
        for more in compared[1:]:
            found = found.union(more)
        return found.filter("linked").select("a", "b")

    def placed(rows: DataFrame, name: str = "class") -> DataFrame:
        """``rows`` with the component that the class ``name`` is in so far."""
        known = components.select(F.col("node").alias(name), "component")
        return lookup_join(rows, known, name, "left").withColumn("component", F.coalesce("component", name))

    def compare_more(fresh: DataFrame) -> DataFrame:
        """Compare the pairs, and return the components with the new links."""
        if fresh.isEmpty():
            return components
        with scratch_scope(docs.sparkSession) as keep:
            compared.append(keep(_compare(texts, fresh), "compared"))
        new = compared[-1].filter("linked")
        return components if new.isEmpty() else merged_components(components, new)

    components = connected_components(links())
    members = store(placed(live.select("key", "class", "n")), "placed")
    mixed = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    mixed = store(lookup_join(members, mixed.select("key"), "key", "left_semi"), "mixed")
    if mixed.isEmpty():
        return links()
    if every_pair:
        compared.append(_compare(texts, store(_apart(mixed, compared[0]), "fresh")))
        return links()

    # Members of mixed buckets and the bucket's own centre.
    spokes = stars.select("key", "class", "a").join(mixed.select("key", "class", "component"), ["key", "class"])
    spokes = placed(spokes.withColumnRenamed("component", "own").drop("key"), "a").filter("own <> component")
    fresh = _fresh(spokes.select("a", F.col("class").alias("b")), compared)
    components = compare_more(fresh)

    # Members of mixed buckets that differ from one centre in the same way.
    alive = store(mixed.select("class").distinct(), "alive")
    for agreeing in ROUNDS:
        fresh = _alike(compared, alive, agreeing, placed)
        if fresh is None:
            break
        components = compare_more(fresh)
    return links()


def _fresh(pairs: DataFrame, compared: list[DataFrame]) -> DataFrame:
    """``pairs`` (a, b), each in one direction only, without those compared before in either direction."""
    ends = [F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")]
    pairs = store(pairs.groupBy(*ends).agg(F.min(F.struct("a", "b")).alias("pair")), "pairs")
    for done in compared:
        pairs = pairs.join(done.select(*ends), ["lo", "hi"], "left_anti")
    return store(pairs.select("pair.*"), "fresh")


def _alike(compared: list[DataFrame], alive: DataFrame, agreeing: int, placed: Callable[..., DataFrame]) -> DataFrame | None:
    """Pairs (a, b) of one star per bucket of equal differences from a centre; None if no bucket is left.

    A bucket has the classes whose differences from one centre agree in ``agreeing`` neighbouring bins. Its star's
    centre is the class that differs least.
    """
    with scratch_scope(alive.sparkSession) as keep:
        fresh = _alike_inside(compared, alive, agreeing, placed)
        return None if fresh is None else keep(fresh, "fresh")


def _alike_inside(
    compared: list[DataFrame], alive: DataFrame, agreeing: int, placed: Callable[..., DataFrame]
) -> DataFrame | None:
    known = compared[0]
    for more in compared[1:]:
        known = known.union(more)
    known = known.withColumnRenamed("a", "hub").withColumnRenamed("b", "class")
    known = store(lookup_join(known, alive, "class", "left_semi"), "known")
    bins = F.col("bins")
    key = F.transform(
        F.sequence(F.lit(0), F.lit(_DIFFERENCE_BINS - 1)),
        lambda i: F.xxhash64("hub", i, *(bins[(i + k) % F.lit(_DIFFERENCE_BINS)] for k in range(agreeing))),
    )
    rough = ["n", "common", "lacking", *(F.expr(" | ".join(bits)).alias(name) for name, bits in _ROUGH_BITS.items())]
    entries = known.filter(F.size("bins") > 0).select("hub", "class", *rough, F.explode(key).alias("key"))
    entries = store(placed(entries), "entries")
    differs = F.col("lacking") + F.col("n") - F.col("common")
    stars = entries.groupBy("key").agg(
        F.min(F.struct(differs, "class", "component", *_ROUGH_COLUMNS)).alias("centre"),
        F.min("component").alias("lo"),
        F.max("component").alias("hi"),
    )
    centre = [F.col(f"centre.{c}").alias(f"{c}_a") for c in ("component", *_ROUGH_COLUMNS)]
    stars = store(stars.filter("lo < hi").select("key", F.col("centre.class").alias("a"), *centre), "stars_of_differences")
    if stars.isEmpty():
        return None
    spokes = lookup_join(entries, stars, "key").filter(F.col("component") != F.col("component_a"))
    spokes = spokes.filter(_near("n", "n_a") & _similar(F.expr(_ROUGHLY_COMMON), "n", "n_a"))
    pairs = store(spokes.select("hub", F.col("class").alias("b"), "a").distinct(), "spokes")
    bounds = known.select("hub", "class", "n", *_BOUND_COLUMNS)
    both = pairs.join(bounds.withColumnRenamed("class", "b"), ["hub", "b"])
    both = both.join(bounds.select("hub", F.col("class").alias("a"), *(F.col(c).alias(f"{c}_a") for c in ("n", *_BOUND_COLUMNS))), ["hub", "a"])
    return _fresh(both.filter(_similar(F.expr(_MOST_COMMON), "n", "n_a")).select("a", "b"), compared)


def _apart(mixed: DataFrame, first: DataFrame) -> DataFrame:
    """Pairs (a, b) of all classes of a bucket that are in different components, but for those proved not similar."""
    pivoted = first.select(F.col("b").alias("class"), F.col("a").alias("pivot"), *_BOUND_COLUMNS)
    placed = store(mixed.join(pivoted, "class", "left"), "pivoted")
    largest = (
        placed.groupBy("key", "component")
        .agg(F.count(F.lit(1)).alias("size"))
        .groupBy("key")
        .agg(F.max(F.struct("size", "component"))["component"].alias("largest"))
    )
    mixed = store(placed.join(largest, "key"), "mixed")
    apart = mixed.filter("component <> largest").select(
        "key", *(F.col(c).alias(f"{c}_a") for c in ("class", "n", "component", "pivot", *_BOUND_COLUMNS))
    )
    new = F.expr(
        "component <> component_a and (component = largest or class < class_a)"
        " and not (class <=> pivot_a) and not (class_a <=> pivot)"
    )
    possible = F.coalesce((F.col("pivot") != F.col("pivot_a")) | _similar(F.expr(_MOST_COMMON), "n", "n_a"), F.lit(True))
    fresh = mixed.join(apart, "key").filter(new & _near("n", "n_a") & possible)
    return fresh.select(F.col("class_a").alias("a"), F.col("class").alias("b")).distinct()


def _similar(common: Column, n_a: str, n_b: str) -> Column:
    return F.lit(100) * common >= F.lit(SIMILAR_PERCENT) * (F.col(n_a) + F.col(n_b) - common)


def _near(n_a: str, n_b: str) -> Column:
    """The set sizes alone do not rule the similarity out."""
    return F.lit(100) * F.least(n_a, n_b) >= F.lit(SIMILAR_PERCENT) * F.greatest(n_a, n_b)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, print_a, text) of the classes ``wanted`` (class, print_a, least_id), from one document of each.

    Ids are broadcast only if they are few enough; otherwise the texts are shuffled once. An id may have other texts too;
    whoever reads the texts passes over those with another print. Classes without any id are found by their texts.
    """
    ids = store(wanted.select(F.col("least_id").alias("doc_id"), "class", "print_a"), "ids")
    named = docs.filter("doc_id is not null").select("doc_id", "text")
    found = lookup_join(named, ids.filter("doc_id is not null"), "doc_id")
    if not ids.filter("doc_id is null").isEmpty():
        prints = map_text(docs.filter("doc_id is null").select("text"), _printed, "print_a long, text string")
        nameless = prints.dropDuplicates(["print_a"])
        found = found.unionByName(lookup_join(nameless, ids.filter("doc_id is null"), "print_a").select(found.columns))
    return store(found.select("class", "print_a", "text"), "texts")


def _printed(batch: pa.RecordBatch) -> pa.RecordBatch:
    hashes, first = shingle_sets(batch)
    return pa.RecordBatch.from_arrays([signed(set_prints(hashes, first, 1)), batch.column("text")], ["print_a", "text"])


def _difference_bins(extra: np.ndarray, lacked: np.ndarray) -> list[int]:
    """Densified least hashes of how a set differs from its centre; what it lacks counts unlike what it has beyond it."""
    marks = np.concatenate([mix(extra), mix(~lacked)])
    if not len(marks):
        return []
    marks.sort()
    cell = (marks >> np.uint64(64 - 6)).astype(np.int64)
    lead = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    out = np.zeros(_DIFFERENCE_BINS, np.uint64)
    has = np.zeros(_DIFFERENCE_BINS, bool)
    out[cell[lead]], has[cell[lead]] = marks[lead], True
    filled = out.copy()
    for i in np.flatnonzero(~has):
        probes = _PROBES[i] % _DIFFERENCE_BINS
        filled[i] = out[probes[np.argmax(has[probes])]]
    return filled.view(np.int64).tolist()


def _compare(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, n, linked, how b differs from a) for the pairs (a, b), from the full shingle sets.

    The pairs of one ``a`` are dealt over as many blocks as they need at 64 members each. A block
    gets one copy of the text of ``a``, and sorting puts it before the members, which then stream by.
    """
    load = store(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("load")), "load")
    blocks = F.ceil(F.col("load") / F.lit(_MEMBERS_PER_COPY)).cast("int")
    members = lookup_join(pairs, load, "a").select(
        F.col("b").alias("class"), "a", F.pmod(F.xxhash64("b"), blocks).cast("int").alias("block"), F.lit(1).alias("role")
    )
    copies = load.select(
        F.col("a").alias("class"), "a", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(0).alias("role")
    )
    wanted = texts.join(store(members.union(copies), "parts"), "class")
    wanted = wanted.repartition("a", "block").sortWithinPartitions("a", "block", "role", "class")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, centre, last = None, None, None
        for batch in batches:
            for part in pieces_of(batch):
                hashes, first = shingle_sets(part)
                prints = set_prints(hashes, first, 1).view(np.int64)
                a, number, role, b, wanted_print = (
                    part.column(c).to_numpy() for c in ("a", "block", "role", "class", "print_a")
                )
                rows, linked, sizes, bounds, bins = [], [], [], [], []
                for i in range(part.num_rows):
                    if prints[i] != wanted_print[i]:
                        continue  # another text under the same id
                    own = hashes[first[i] : first[i + 1]]
                    if role[i] == 0:
                        block, centre, last = (a[i], number[i]), own, None
                    elif (a[i], number[i]) == block and b[i] != last:
                        last = b[i]  # a repeated row would follow at once
                        at = np.minimum(np.searchsorted(centre, own), len(centre) - 1)
                        shared = centre[at] == own
                        lacked = np.ones(len(centre), bool)
                        lacked[at[shared]] = False
                        same = int(np.count_nonzero(shared))
                        extra, lack = _occupied(own[~shared]), _occupied(centre[lacked])
                        rows.append(i)
                        linked.append(100 * same >= SIMILAR_PERCENT * (len(own) + len(centre) - same))
                        sizes.append(len(own))
                        bounds.append([same, len(centre) - same, extra[0], lack[0], *extra[1], *lack[1]])
                        bins.append(_difference_bins(own[~shared], centre[lacked]))
                values = np.array(bounds, np.int64).reshape(len(rows), len(_BOUND_COLUMNS))
                arrays = [pa.array(x[rows], pa.int64()) for x in (a, b)]
                arrays += [pa.array(sizes, pa.int64()), pa.array(linked, pa.bool_()), pa.array(bins, pa.list_(pa.int64()))]
                arrays += [pa.array(values[:, j]) for j in range(values.shape[1])]
                yield pa.RecordBatch.from_arrays(arrays, ["a", "b", "n", "linked", "bins", *_BOUND_COLUMNS])
        give_back()

    bounds_schema = ", ".join(f"{c} long" for c in _BOUND_COLUMNS)
    return short_batches(wanted).mapInArrow(compare, f"a long, b long, n long, linked boolean, bins array<long>, {bounds_schema}")
