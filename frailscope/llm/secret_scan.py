"""Secret scan with corpus-wide ownership frequency, in Spark SQL functions only.

Three fixed patterns find assignments, access keys and long hexadecimal strings. The method adds
tokens that look random: long runs of letters and digits with upper-case, lower-case and digits.
Whether such a token is a live credential or a widely copied example is not visible in one text, so
the corpus decides: the hashes of all candidates are counted by the distinct repositories and
owners that hold them. A random-looking token is reported unless too many owners have it, or its owners have it
in too many repositories each, as when one site pastes an example into all its pages; of every
found secret the result says whether it looks live or like an example.

Positions come from splitting a text at the matches and adding up lengths. Texts without a trace of
a candidate are passed over by cheap substring tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from frailscope.functions.joins import lookup_join
from frailscope.sources.scratch import store


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


# The kinds in their order, the pattern of each and the least length of its value.
_KEY = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"({_KEY})[\x22']?\x20*[:=]\x20*[\x22']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LONG_HEX = "[0-9a-f]{32,}"
TOKEN = "[A-Za-z0-9_-]{20,}"
LEAST = {"assign": 8, "access": 16, "hex": 32, "token": 20}
KINDS = tuple(LEAST)
MAX_OWNERS = 2
MAX_REPOSITORIES = 10
_BLOCK = 256

_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(text: str, kind: str, pattern: str, value: str, group: int = 0) -> str:
    """SQL for an array of (kind, start, end, value) of the matches whose value is long enough.

    ``value`` is SQL for the secret inside a match ``m``.
    """
    pieces = f"split({text}, {_literal(pattern)}, -1)"
    found = f"regexp_extract_all({text}, {_literal(pattern)}, 0)"
    # Gap k ends where match k begins; both arrays run in step, the last gap being left over.
    steps = f"zip_with({found}, slice({pieces}, 1, size({found})), (m, gap) -> struct(m as m, length(gap) as gap))"
    # Positions are running sums. They go block by block, and blocks are laid end to end at last, so a text with
    # very many matches does not copy its list with every one of them.
    blocks = f"transform(sequence(0, greatest(size(x) - 1, 0) div {_BLOCK}), b -> slice(x, b * {_BLOCK} + 1, {_BLOCK}))"
    begins = (
        "aggregate(transform(y, b -> aggregate(b, 0, (a, s) -> a + s.gap + length(s.m))),"
        " cast(struct(0 as at, array() as out) as struct<at: int, out: array<int>>),"
        " (a, n) -> struct(a.at + n as at, concat(a.out, array(a.at)) as out)).out"
    )
    walked = (
        f"flatten(zip_with(y, {begins}, (b, at) -> aggregate(b, cast(struct(at as at, array() as out) as"
        " struct<at: int, out: array<struct<kind: string, start: int, end: int, value: string>>>),"
        " (a, s) -> struct(a.at + s.gap + length(s.m) as at, concat(a.out, array(struct("
        f"'{kind}' as kind, a.at + s.gap as start, a.at + s.gap + length(s.m) as end,"
        f" {value.replace('{m}', 's.m')} as value))) as out), a -> a.out)))"
    )
    whole = f"transform(transform(array({steps}), x -> {blocks}), y -> {walked})[0]"
    return f"filter({whole}, s -> length(s.value) >= {LEAST[kind]})"


_SPAN = "array<struct<kind: string, start: int, end: int, value: string>>"


def _found(docs: DataFrame, repository: str, owner: str) -> DataFrame:
    """Per row its ids and the base and further spans, each in order of position."""
    rows = docs.select(
        "doc_id",
        F.col(repository).cast("string").alias("repository"),
        F.col(owner).cast("string").alias("owner"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    none = f"cast(array() as {_SPAN})"
    words = " or ".join(f"contains(lower(text), '{w}')" for w in _WORDS)
    assigned = f"regexp_extract({{m}}, {_literal('^(?:' + ASSIGN + ')$')}, 2)"
    spans = {
        "assign": (words, _spans("text", "assign", ASSIGN, assigned)),
        "access": ("contains(text, 'AKIA')", _spans("text", "access", ACCESS, "{m}")),
        # A run of hexadecimal digits is as long as it can be, so asking for 32 of them drops the same runs.
        "hex": (f"text rlike {_literal(LONG_HEX)}", _spans("text", "hex", LONG_HEX, "{m}")),
        "token": (f"text rlike {_literal(TOKEN)}", _spans("text", "token", TOKEN, "{m}")),
    }
    for kind, (trace, sql) in spans.items():
        rows = rows.withColumn(kind, F.expr(f"if({trace}, {sql}, {none})"))
    base = F.concat("assign", "access", "hex")
    random = F.expr("filter(token, s -> s.value rlike '[a-z]' and s.value rlike '[A-Z]' and s.value rlike '[0-9]')")
    return rows.select("doc_id", "repository", "owner", "assign", "access", "hex", base.alias("base"), random.alias("token"))


def _apart(spans: DataFrame) -> DataFrame:
    """``spans`` (row, kind, start, end, ...) without the tokens inside or across a base span of their row.

    Such a token is the same secret, found already. Base spans of a kind do not overlap, so of those that begin before a token
    only the farthest end counts, and of those that begin later only the nearest start.
    """
    along = W.partitionBy("row").orderBy("start", "end")
    base = F.col("kind") != "token"
    ends = F.max(F.when(base, F.col("end"))).over(along.rowsBetween(W.unboundedPreceding, 0))
    starts = F.min(F.when(base, F.col("start"))).over(along.rowsBetween(0, W.unboundedFollowing))
    marked = spans.withColumns({"ends": ends, "starts": starts})
    meets = F.coalesce(F.col("ends") > F.col("start"), F.lit(False)) | F.coalesce(F.col("starts") < F.col("end"), F.lit(False))
    return marked.filter(base | ~meets).drop("ends", "starts")


def _text_of(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start, then in the order of the kinds."""
    order = F.array(*(F.lit(k) for k in KINDS))

    def key(s: Column) -> Column:
        return F.struct(
            s["start"].alias("start"), F.array_position(order, s["kind"]).alias("kind"), s["end"].alias("end")
        )

    keys = F.array_sort(F.transform(spans, key))
    shown = F.transform(
        keys, lambda k: F.concat_ws(":", F.element_at(order, k["kind"].cast("int")), k["start"], k["end"])
    )
    return F.array_join(shown, ",")


def _secret_hash(value: Column) -> Column:
    """64 bits of a secret for counting owners; the secret itself goes no further."""
    return F.conv(F.substring(F.sha2(value, 256), 1, 15), 16, 10).cast("long")


def scan(
    docs: DataFrame,
    repository: str = "doc_id",
    owner: str = "source",
    max_owners: int = MAX_OWNERS,
    max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added, n_live, n_examples, most_owners,
    most_repositories) for every row.

    ``docs`` has doc_id, text and the columns named by ``repository`` and ``owner``. A secret looks
    live if at most ``max_owners`` distinct owners have it, in at most ``max_repositories`` distinct repositories
    an owner on average; else it looks like a copied example. A null owner
    or repository counts as one more. ``n_added`` tokens of the method are among the spans, those
    that look live. ``most_owners`` and ``most_repositories`` are the largest numbers that any secret of the row has. Positions are code points, ends exclusive. A null text counts as empty. Rows
    are judged one by one, so the same row twice gives the same result twice and counts as one
    repository.
    """
    found = store(_found(docs, repository, owner).withColumn("row", F.monotonically_increasing_id()), "found")
    named = found.select(
        "row",
        F.coalesce("repository", F.lit("")).alias("repository"),
        F.coalesce("owner", F.lit("")).alias("owner"),
        "base",
        "token",
    )
    both = (F.size("base") > 0) & (F.size("token") > 0)

    def spans(rows: DataFrame) -> DataFrame:
        exploded = rows.select("row", "repository", "owner", F.explode(F.concat("base", "token")).alias("span"))
        return exploded.select(
            "row", "repository", "owner", "span.kind", "span.start", "span.end", _secret_hash(F.col("span.value")).alias("secret")
        )

    candidates = spans(named.filter(~both)).union(_apart(spans(named.filter(both))))
    candidates = store(candidates, "candidates")
    # Distinct first, then counted: both steps add up on the map side, so a secret that everyone
    # copies sends few rows.
    ownership = (
        candidates.groupBy("secret", "owner", "repository")
        .agg(F.lit(1).alias("one"))
        .groupBy("secret", "owner")
        .agg(F.count(F.lit(1)).alias("repositories"))
        .groupBy("secret")
        .agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
    )
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories * F.col("owners"))
    judged = lookup_join(candidates.drop("owner", "repository"), ownership, "secret").groupBy("row").agg(
        F.count_if(live & (F.col("kind") != "token")).alias("base_live"),
        F.count_if(~live).alias("n_examples"),
        F.collect_list(F.when(live & (F.col("kind") == "token"), F.struct("kind", "start", "end"))).alias("added"),
        F.max("owners").alias("most_owners"),
        F.max("repositories").alias("most_repositories"),
    )
    result = lookup_join(found, judged, "row", "left")
    bare = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    added = F.coalesce("added", F.expr("cast(array() as array<struct<kind: string, start: int, end: int>>)"))
    n_added = F.size(added).cast("long")
    return result.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(_text_of(bare), 256).alias("base_sha256"),
        _text_of(F.concat(bare, added)).alias("spans"),
        n_added.alias("n_added"),
        (F.coalesce("base_live", F.lit(0)) + n_added).cast("long").alias("n_live"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_examples", "most_owners", "most_repositories")),
    )
