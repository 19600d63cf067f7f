"""Joins chosen by the measured size of their smaller side.

A side is broadcast only after it has been measured and found small. Otherwise the join is asked to
shuffle, whatever Spark estimates the side to be, and the facts of people who own a large share of
them are spread over several tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from frailscope.sources.scratch import store, store_and_measure

BROADCAST_CONF = "frailscope.broadcast.maxBytes"
SALT_CONF = "frailscope.salts"
_DEFAULT_BROADCAST = 64 * 1024 * 1024
_DEFAULT_SALTS = 16
# A person with more than this part of all facts is hot; there can be no more than its inverse of them.
_HOT_SHARE = 1 / 1000
# Fewer facts than this are no load for one task.
HOT_ROWS_CONF = "frailscope.hotRows"
_DEFAULT_HOT_ROWS = 100_000


def _measures(df: DataFrame, more_bytes_per_row: int = 0) -> dict[str, Column]:
    octets = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t == "string"]
    text = F.coalesce(F.sum(sum(octets[1:], octets[0])), F.lit(0)) if octets else F.lit(0)
    rows = F.count(F.lit(1))
    fixed = rows * (32 + 8 * len(df.columns) + more_bytes_per_row)
    return {"rows": rows, "bytes": (fixed + text).cast("long")}


def measure(df: DataFrame, *extra: Column, more_bytes_per_row: int = 0) -> Row:
    """Rows and in-memory bytes of ``df`` (plus any ``extra`` aggregates) in one aggregation.

    Call it on stored tables or cheap plans: it runs a job over ``df``. ``more_bytes_per_row``
    allows for columns that ``df`` will gain before it is broadcast.
    """
    measures = _measures(df, more_bytes_per_row)
    return df.agg(*(c.alias(k) for k, c in measures.items()), *extra).first()


def broadcast_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(BROADCAST_CONF, str(_DEFAULT_BROADCAST)))


def fits_broadcast(df: DataFrame, measured: Row | None = None) -> bool:
    limit = broadcast_limit(df)
    return limit > 0 and (measured or measure(df))["bytes"] <= limit


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    measured: Row | None = None,
) -> DataFrame:
    """Join a fact table to a lookup on equal keys.

    The lookup is stored and measured in one job, so that its plan runs once; one for which the
    caller has ``measured`` an upper bound is stored only if it is large. A small lookup is
    broadcast, so the facts are not shuffled. With a large one both sides enter the join straight from
    a shuffle, which is what lets adaptive execution split the partitions of hot keys (it leaves joins
    alone whose side is the output of an aggregation or another join on the same key).
    """
    keys = [on] if isinstance(on, str) else list(on)
    if measured is None:
        lookup, measured = store_and_measure(lookup, "lookup", **_measures(lookup))
        small = fits_broadcast(lookup, measured)
    elif not (small := fits_broadcast(lookup, measured)):
        lookup = store(lookup, "lookup")
    joined = facts.join(F.broadcast(lookup) if small else lookup.hint("merge"), keys, how)
    return joined.select(*facts.columns) if how in ("left_semi", "left_anti") else joined


def _hot_people(facts: DataFrame, on: str) -> DataFrame:
    """The keys with a large share of the facts, at most a thousand of them."""
    counts = store(facts.groupBy(on).agg(F.count(F.lit(1)).alias("_n")), "loads")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    least = max(int(facts.sparkSession.conf.get(HOT_ROWS_CONF, str(_DEFAULT_HOT_ROWS))), int(total * _HOT_SHARE) + 1)
    return counts.filter((F.col("_n") >= least) & F.col(on).isNotNull()).select(on, F.lit(True).alias("_hot"))


def people_join(
    facts: DataFrame,
    people: DataFrame,
    spread_by: Sequence[str],
    on: str = "person_id",
    measured: Row | None = None,
) -> DataFrame:
    """Inner join of person-level facts to a table of people.

    A small people table is broadcast. With a large one, the facts per person are counted first; the
    facts of hot persons are spread over salts by the columns ``spread_by`` and only those persons'
    rows are copied, once per salt. Each fact row meets each of its people rows exactly once either
    way. Without hot persons, or with a setting of one salt, it is a plain join, which reads fact
    tables bucketed by person without shuffling them. Of facts that lie by person already, only those of hot persons
    are salted and shuffled; the others are joined where they lie, in a second pass over the facts.
    """
    if fits_broadcast(people, measured):
        return facts.join(F.broadcast(people), on)
    salts = int(facts.sparkSession.conf.get(SALT_CONF, str(_DEFAULT_SALTS)))
    hot = _hot_people(facts, on) if salts > 1 else None
    if hot is None or hot.isEmpty():
        return facts.join(people.hint("merge"), on)
    hot = F.broadcast(store(hot, "hot"))
    if _lies_by(facts, on):
        cold = facts.join(hot, on, "left_anti").join(people.hint("merge"), on)
        rest = _salted_join(facts.join(hot, on, "left_semi"), people.join(hot, on, "left_semi"), hot, spread_by, on, salts)
        return cold.unionByName(rest)
    return _salted_join(facts, people, hot, spread_by, on, salts)


def _lies_by(facts: DataFrame, on: str) -> bool:
    """Rows with one ``on`` are in one partition already, as in a table bucketed by it."""
    dealt = facts._jdf.queryExecution().sparkPlan().outputPartitioning().toString()
    return dealt.startswith(f"hashpartitioning({on}#")


def _salted_join(
    facts: DataFrame, people: DataFrame, hot: DataFrame, spread_by: Sequence[str], on: str, salts: int
) -> DataFrame:
    """Join by ``on``, the rows of ``hot`` keys dealt over ``salts`` tasks each."""
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    salted = facts.join(hot, on, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(F.lit(0)))
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copies = people.join(hot, on, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return salted.drop("_hot").join(copies.hint("merge"), [on, "_salt"]).drop("_salt")


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join that treats NULL keys as equal; ``right`` has one row per key.

    The null-safe keys make both sides enter the join from a shuffle, so adaptive execution can
    split a hot key of ``left`` although ``right`` was already aggregated by it.
    """
    renamed = right.select([F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for key in on:
        condition = condition & left[key].eqNullSafe(renamed[f"_r_{key}"])
    return left.join(renamed, condition, how).drop(*[f"_r_{key}" for key in on])
