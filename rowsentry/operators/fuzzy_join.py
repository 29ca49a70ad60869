"""Similarity self-joins by signatures instead of nested loops. No similar pair is lost.

Values are entries under a key, and entries of both sides that share a key are compared. A key with
too many pairs is refined: a stage replaces its entries by entries under finer keys, of which any similar pair
shares one. Stages follow from the pigeonhole principle:

* Levenshtein: of d + 1 segments of the shorter text, one is left alone by d edits, with no more
  edits before it than segments and the others behind; what is left of both texts is within d edits again.
  Where many share a segment and d is 1, the rest of a pair agrees but for one letter at a known place: no false pair is left.
* Bags (letters for Jaro-Winkler, words for Jaccard): bags that differ in H members agree on one of H + 1 parts
  of the alphabet.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.dataset import ROW
from ..sources.shared import materialize

#: Pairs under one key that are compared without refining it.
PAIRS = 1 << 16
#: Pairs under one key that one task compares, and the most tasks for a key.
TASK_PAIRS, MOST_PARTS = 1 << 24, 1 << 10
#: Rows of a key that stand in one block, and pairs of blocks that a task compares: how all pairs of a key are dealt to tasks.
CELL_ROWS, MOST_TASKS = 1024, 4096
#: How often a text is cut anew where many share its segments; rests of more letters are not keyed by all of them but one.
ROUNDS, ONE_EDIT = 4, 64
#: Tasks that a table is dealt to before its rows grow: what is small on disk would be read by one task.
LEAST_TASKS = 64
#: Common prefixes of Jaro-Winkler: so many first letters are part of the key, and the bonus of so many is granted.
PREFIXES = ((0, 1), (2, 3), (4, 4))
_EPS = 1e-9

Stage = Callable[[DataFrame, bool], DataFrame]


@dataclass(frozen=True)
class Field:
    """A column that both sides must agree on to a degree; ``measure`` is levenshtein, jaro_winkler or token_jaccard."""

    column: str
    measure: str
    threshold: float


def stages_of(field: Field) -> list[Stage]:
    """The refinements by one field; none where its threshold is too low to tell values apart."""
    t = field.threshold
    if field.measure == "levenshtein":
        return [_levenshtein_base(field.column, t), _segments, *[_segments_or_one_edit] * (ROUNDS - 1)] if t >= 0.3 else []
    if field.measure == "token_jaccard":
        return [_words_base(f"w_{field.column}", t), _bag(F.col(f"w_{field.column}"))] if t >= 0.2 else []
    return [_letters_base(field.column, t), _bag(F.split(field.column, ""))] if t > 0.82 else []


def _lengths(own: Column, low: Column, high: Column, left: bool) -> Column:
    """Sizes of partners; a pair's smaller side is the left one, if this is the first field."""
    first = F.col("ordered")
    low = F.when(~first & F.lit(left), F.greatest(low, own)).otherwise(low)
    high = F.when(~first & F.lit(not left), F.least(high, own)).otherwise(high)
    return F.explode(F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>")))


def _based(df: DataFrame, left: bool, tag: str, own: Column, more: Sequence[Column] = ()) -> DataFrame:
    a, b = (own, F.col("partner")) if left else (F.col("partner"), own)
    size = F.when(F.col("ordered"), F.col("size")).otherwise(own)
    return df.withColumns({"key": F.xxhash64("key", F.lit(tag), a, b, *more), "size": size, "ordered": F.lit(True)})


def _levenshtein_base(column: str, t: float) -> Stage:
    def stage(df: DataFrame, left: bool) -> DataFrame:
        n = F.length(column)
        df = df.withColumn("partner", _lengths(n, F.ceil(n * t - _EPS), F.floor(n / t + _EPS), left))
        most = F.floor(F.greatest(n, "partner") * (1 - t) + _EPS).cast("int")
        df = df.withColumns({"d": most, "gap": F.abs(n - F.col("partner")), "cut": (n <= F.col("partner")) if left else (n < F.col("partner")), "rem": F.col(column), "least": F.least(n, "partner")})
        return _based(df.where(F.abs(n - F.col("partner")) <= F.col("d")), left, "levenshtein", n)

    return stage


def _segments(df: DataFrame, left: bool, one_edit: bool = False) -> DataFrame:
    """Cuts the shorter text, or looks for each of its segments in the longer one; what can't be cut stays as it is.

    With ``one_edit`` texts within one edit are not cut: those of one length agree without the letter at one place, and a
    longer one is the shorter one without some letter.
    """
    m, d, rem = F.col("least"), F.col("d"), F.col("rem")
    start = lambda i: F.floor(i * m / (d + 1)).cast("int")
    without = lambda at, n: F.concat(F.substr(rem, F.lit(1), at), F.substr(rem, at + n + 1, F.length(rem)))
    entry = lambda i, at, n: F.struct(F.xxhash64("key", i, F.substr(rem, at + 1, n)).alias("key"), without(at, n).alias("rem"), (m - n).alias("least"))
    own = F.transform(F.sequence(F.lit(0), d), lambda i: entry(i, start(i), start(i + 1) - start(i)))

    def found(i: Column) -> Column:
        p, n, more = start(i), start(i + 1) - start(i), F.length(rem) - m
        low = F.greatest(p - i, p + more - (d - i), F.lit(0))
        high = F.least(p + i, p + more + (d - i), F.length(rem) - n)
        return F.when(low <= high, F.transform(F.sequence(low, high), lambda at: entry(i, at, n))).otherwise(F.array().cast("array<struct<key:bigint,rem:string,least:int>>"))

    other = F.flatten(F.transform(F.sequence(F.lit(0), d), found))
    kept = F.array(F.struct(F.col("key"), rem, m.alias("least")))
    each = F.when(d + 1 > m, kept).when(F.col("cut"), own).otherwise(other)
    if one_edit:
        done = lambda i, text: F.struct(F.xxhash64("key", F.lit("one"), i, text).alias("key"), F.lit("").alias("rem"), F.lit(0).alias("least"))
        at = F.sequence(F.lit(0), F.length(rem) - 1)
        apart = F.when(F.col("gap") == 0, F.transform(at, lambda i: done(i, without(i, F.lit(1))))).when(F.col("cut"), F.array(done(F.lit(-1), rem))).otherwise(F.transform(at, lambda i: done(F.lit(-1), without(i, F.lit(1)))))
        each = F.when((d == 1) & (m > 0) & (m <= ONE_EDIT), apart).otherwise(each)
    rest = [c for c in df.columns if c not in ("key", "rem", "least")]
    return df.select(*rest, F.explode(F.array_distinct(each)).alias("e")).select(*rest, "e.*")


def _segments_or_one_edit(df: DataFrame, left: bool) -> DataFrame:
    return _segments(df, left, True)


def _letters_base(column: str, t: float) -> Stage:
    """Keys by both lengths and the first letters; ``d`` + 1 is the number of parts of the alphabet."""

    def stage(df: DataFrame, left: bool) -> DataFrame:
        n, out = F.length(column), []
        for least, granted in PREFIXES:
            j = (t - 0.1 * granted) / (1 - 0.1 * granted)  # the Jaro similarity that is needed then
            own = df.where(n >= least).withColumn("partner", _lengths(n, F.greatest(F.ceil(n * (3 * j - 2) - _EPS), F.lit(max(1, least))), F.floor(n / (3 * j - 2) + _EPS), left))
            shared = F.ceil((3 * j - 1) * n * F.col("partner") / (n + F.col("partner")) - _EPS)
            own = own.withColumn("d", (n + F.col("partner") - 2 * shared).cast("int")).where(shared <= F.least(n, "partner"))
            out.append(_based(own, left, "letters", n, [F.lit(least), F.substring(column, 1, least)]))
        found = out[0]
        for more in out[1:]:
            found = found.union(more)
        return found

    return stage


def _words_base(column: str, t: float) -> Stage:
    def stage(df: DataFrame, left: bool) -> DataFrame:
        n = F.size(column)
        df = df.withColumn("partner", _lengths(n, F.ceil(n * t - _EPS), F.floor(n / t + _EPS), left))
        shared = F.ceil((n + F.col("partner")) * (t / (1 + t)) - _EPS)
        df = df.withColumn("d", (n + F.col("partner") - 2 * shared).cast("int")).where(shared <= F.least(n, "partner"))
        return _based(df, left, "words", n)

    return stage


def _bag(members: Column) -> Stage:
    """An entry for each of ``d`` + 1 parts of the alphabet: the members that fall in it, sorted."""

    def stage(df: DataFrame, left: bool) -> DataFrame:
        df = df.withColumn("bag", F.array_sort(F.transform(F.filter(members, lambda c: F.length(c) > 0), lambda c: F.xxhash64(c))))
        part = lambda i: F.filter("bag", lambda h: F.pmod(h, F.col("d") + 1) == i)
        each = F.transform(F.sequence(F.lit(0), F.col("d")), lambda i: F.xxhash64("key", i, part(i)))
        return df.withColumn("key", F.explode(each)).drop("bag")

    return stage


def without_shared_beginning(values: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """``values`` with a text column less the beginning that all texts of equal ``by`` share, which changes no distance between them."""
    ends = values.groupBy(*by).agg(F.min(column).alias("a"), F.max(column).alias("b"))  # they share what all share
    a, b = F.split("a", ""), F.split("b", "")
    alike = F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: F.coalesce(p["x"] == p["y"], F.lit(False)))
    shared = F.when(F.col("a") == F.col("b"), F.length("a")).otherwise(F.array_position(alike, False).cast("int") - 1)
    ends = materialize(ends.select(*by, shared.alias("shared")), "beginnings")
    return values.join(ends, list(by)).withColumn(column, F.substr(F.col(column), F.col("shared") + 1)).select(*values.columns)


def pairs_within(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """All pairs of rows of equal ``by``, each once, the smaller ``_row`` under ``l_`` and the other under ``r_``.

    A key's rows are dealt to blocks of some ``CELL_ROWS``, and a task has pairs of blocks, so a large key is spread over many
    tasks and none holds more than blocks. Rows with a null key are in no pair.
    """
    blocks = F.ceil(F.col("n") / CELL_ROWS).cast("long")
    counts = materialize(values.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).select(*by, blocks.alias("blocks")), "blocks")
    cells = counts.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2)).first()[0] or 0
    tasks = int(min(MOST_TASKS, max(1, cells)))
    dealt = values.repartition(min(tasks, LEAST_TASKS)).join(counts, list(by)).withColumn("own", F.pmod(F.xxhash64(ROW), F.col("blocks")))
    sides = []
    for p, others in (("l", F.sequence(F.col("own"), F.col("blocks") - 1)), ("r", F.sequence(F.lit(0).cast("long"), F.col("own")))):
        side = dealt.withColumn("other", F.explode(others))
        i, j = ("own", "other") if p == "l" else ("other", "own")
        cell = [F.col(c).alias(f"k{x}") for x, c in enumerate(by)] + [F.col(i).alias("i"), F.col(j).alias("j")]
        sides.append(side.select(*cell, *[F.col(c).alias(f"{p}_{c}") for c in values.columns]))
    keys = [*(f"k{x}" for x in range(len(by))), "i", "j"]
    left, right = (side.repartition(tasks, *keys) for side in sides)
    pairs = left.hint("shuffle_hash").join(right, keys).where((F.col("i") < F.col("j")) | (F.col(f"l_{ROW}") < F.col(f"r_{ROW}")))
    swap = F.col(f"l_{ROW}") > F.col(f"r_{ROW}")
    a = [F.when(swap, F.col(f"r_{c}")).otherwise(F.col(f"l_{c}")).alias(f"l_{c}") for c in values.columns]
    b = [F.when(swap, F.col(f"l_{c}")).otherwise(F.col(f"r_{c}")).alias(f"r_{c}") for c in values.columns]
    return pairs.select(*a, *b)


def similar_pairs(values: DataFrame, fields: Sequence[Field], accept: Callable[[DataFrame], DataFrame], exact: Sequence[str] = ()) -> DataFrame:
    """Pairs of ``values`` (``_row`` and columns) that agree on ``exact`` and pass ``accept``, each once.

    ``accept`` takes the candidates, both sides' columns under ``l_`` and ``r_``, and returns ``u, v`` and what else
    it finds; it alone decides, so every pair that it accepts has to meet all thresholds of ``fields``. The fields are tried in
    their order, the next one only under keys that the former leave with too many pairs.
    """
    columns = values.columns
    state = {"key": F.xxhash64(*exact) if exact else F.pmod(F.col(ROW), F.lit(1)).cast("long"), "size": F.lit(0), "ordered": F.lit(False), "partner": F.lit(0), "d": F.lit(0), "gap": F.lit(0), "cut": F.lit(False), "rem": F.lit(""), "least": F.lit(0)}
    sides = [values.repartition(LEAST_TASKS).withColumns(state)] * 2
    stages = [s for f in fields for s in stages_of(f)]
    found = []
    if not exact and stages and values.count() ** 2 > PAIRS:  # one key for all rows: refined at once
        sides = [materialize(stages[0](side, left), "entries") for side, left in zip(sides, (True, False), strict=True)]
        stages = stages[1:]
    for k in range(len(stages) + 1):
        n = [side.groupBy("key").agg(F.count(F.lit(1)).alias(f"n{i}")) for i, side in enumerate(sides)]
        many = F.col("n0").cast("double") * F.col("n1")
        # both sides are the same rows at first
        met = n[0].join(n[1], "key") if sides[0] is not sides[1] else n[0].withColumn("n1", F.col("n0"))
        worst = met.agg(F.max(many)).first()[0] or 0
        hot, cold = None, sides
        if k < len(stages) and worst > PAIRS:
            hot = materialize(met.where(many > PAIRS).select("key"), "hot-keys")
            cold = [side.join(hot, "key", "left_anti") for side in sides]
        elif worst > TASK_PAIRS:  # nothing refines these keys any more: their left rows are dealt to several tasks
            parts = F.least(F.floor(many / TASK_PAIRS) + 1, F.lit(MOST_PARTS)).cast("int")
            dealt = materialize(met.where(many > TASK_PAIRS).select("key", parts.alias("parts")), "dealt-keys")
            own, other = (side.join(dealt, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))) for side in sides)
            salted = (own.withColumn("salt", F.pmod(F.xxhash64(ROW), F.col("parts")).cast("int")), other.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
            cold = [side.withColumn("key", F.xxhash64("key", "salt")) for side in salted]
        left, right = (side.select(*[F.col(c).alias(f"{p}_{c}") for c in ("key", "size", *columns)]) for p, side in zip("lr", cold, strict=True))
        once = (F.col("l_size") < F.col("r_size")) | (F.col(f"l_{ROW}") < F.col(f"r_{ROW}"))
        pairs = left.join(right, (F.col("l_key") == F.col("r_key")) & (F.col(f"l_{ROW}") != F.col(f"r_{ROW}")) & once)
        found.append(accept(pairs))
        if hot is None:
            break
        sides = [materialize(stages[k](side.join(hot, "key", "left_semi").select(*columns, *state), left), "entries") for side, left in zip(sides, (True, False), strict=True)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    rest = [c for c in out.columns if c not in ("u", "v")]
    return out.withColumns({"u": F.least("u", "v"), "v": F.greatest("u", "v")}).dropDuplicates(["u", "v"]).select("u", "v", *rest)
