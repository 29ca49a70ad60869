"""Exact Jaccard self-join on word shingles by universe partition and pigeonhole.

Equal sets are one node, so copies cost one row each. Sizes fall into bands; a band fixes how far
two sets may differ (``Band.distance``), and each token belongs by its hash to one of the band's
segments. If a segment of type 0 must match exactly and one of type 1 up to one deletion, a pair
within the distance is detected in segments worth at least ``slack + 1`` of the band's units.
``allocate`` weighs exact segments against one-deletion neighbourhoods by their cost.

A signature that more than ``HOT`` sets share is not paired. A set that loses no more units to
such signatures than the band's slack still meets all its partners elsewhere ("safe"). Pairs of
two unsafe sets share a hot signature; those sets are gathered by hot signature instead and
compared in blocks. Every candidate component is then verified exactly, block against block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from . import kernels as K
from .store import materialize, small_batches, text_volume

U = np.uint64
#: Signatures of more sets than this are hot: their sets are not paired by them.
HOT = 24
#: Sets in a verification block, bytes of signatures in a bucket, bytes of sets in a cell.
BLOCK, BUCKET_BYTES, CELL_BYTES = 256, 4 << 20, 4 << 20
#: A task forgets the nodes that it has emitted after so many.
REMEMBERED = 500_000


@dataclass(frozen=True)
class Band:
    number: int
    low: int
    high: int
    distance: int
    segments: int
    deletions: int
    slack: int


def allocate(size: int, distance: int) -> tuple[int, int, int]:
    """Segments, how many of them get one-deletion neighbourhoods, and the slack.

    The cost of a choice is its rows for each set plus what nearly empty segments would match.
    """
    slack = 0 if distance <= 1 else math.ceil(distance / 5)
    need, best = distance + 1 + slack, None
    for deletions in range(need // 2 + 1):
        segments = need - deletions
        cost = segments + deletions * size / segments + 8 * segments * math.exp(-size / segments)
        if best is None or cost < best[0]:
            best = (cost, segments, deletions)
    return best[1], best[2], slack


@lru_cache(maxsize=8)
def bands(percent: int, largest: int) -> tuple[Band, ...]:
    """Bands up to sets of ``largest``: a set meets partners in its own and in the adjacent bands only."""
    out, low = [], 1
    while low <= largest:
        high = max(low, 100 * low // percent)
        distance = (100 - percent) * high // percent
        if distance:
            out.append(Band(len(out), low, high, distance, *allocate((low + high) // 2, distance)))
        low = high + 1
    return tuple(out)


def signatures(tokens: np.ndarray, band: Band) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of a set in a band, and the units that each stands for."""
    salted = K.mix(tokens + U(0x9E3779B97F4A7C15 * (band.number + 1) & 0xFFFFFFFFFFFFFFFF))
    segment = (salted >> U(33)).astype(np.int64) % band.segments
    total = np.zeros(band.segments, dtype=U)
    np.add.at(total, segment, salted)
    place = K.mix(np.arange(band.segments, dtype=U) + U(band.number << 32))
    exact = K.mix(total + place)
    units = np.ones(band.segments, np.int64)
    units[: band.deletions] = 2
    if not band.deletions:
        return exact, units
    near = segment < band.deletions
    less = K.mix(total[segment[near]] - salted[near] + place[segment[near]])
    return np.concatenate([exact, less]), np.concatenate([units, np.full(less.size, 2)])


def own_bands(size: int, every: tuple[Band, ...], percent: int) -> list[Band]:
    """The band of a set's size, and those below in which it may have a smaller partner."""
    return [b for b in every if b.low <= size and percent * size <= 100 * b.high]


_ENTRY = np.dtype([("sig", "<u4"), ("node", "<i8"), ("tag", "u1")])


def _info(batches):
    for batch in batches:
        ids, n = [], []
        for chunk in K.chunks(batch.column(0)):
            sets, nodes = K.shingle_sets(chunk)
            ids.append(nodes)
            n += [s.size for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(np.concatenate(ids) if ids else [], pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "key", "node", "n"])


def _emit(percent: int, largest: int, buckets: int):
    def run(batches):
        every, seen = bands(percent, largest), set()
        for batch in batches:
            sigs, nodes, tags = [], [], []
            for chunk in K.chunks(batch.column(0)):
                for tokens, node in zip(*K.shingle_sets(chunk), strict=True):
                    if node in seen or not tokens.size:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(node)
                    for band in own_bands(tokens.size, every, percent):
                        s, units = signatures(tokens, band)
                        sigs.append(s)
                        nodes.append(np.full(s.size, node))
                        tags.append((band.number | (units == 2) << 7).astype(np.uint8))
            if not sigs:
                continue
            sig = np.concatenate(sigs)
            bucket = ((sig >> U(32)) % U(buckets)).astype(np.int64)
            entry = np.empty(sig.size, _ENTRY)
            entry["sig"], entry["node"], entry["tag"] = sig & U(0xFFFFFFFF), np.concatenate(nodes), np.concatenate(tags)
            entry = entry[np.argsort(bucket, kind="stable")]
            cut = np.searchsorted(np.sort(bucket), np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cut))
            for k in range(0, full.size, 64):
                some = full[k : k + 64]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([entry[cut[b] : cut[b + 1]].tobytes() for b in some], pa.binary())], names=["bucket", "entries"])

    return run


def _bucket_rows(key, table):
    """Within a bucket: pairs of sets that share a signature that isn't hot, with the units shared; and the entries of hot signatures."""
    entry = np.concatenate([np.frombuffer(x, _ENTRY) for x in table.column("entries").to_pylist()])
    entry = np.unique(entry)
    begin = np.flatnonzero(np.concatenate([[True], entry["sig"][1:] != entry["sig"][:-1]]))
    size = np.diff(np.concatenate([begin, [entry.size]]))
    a, b, tag = [], [], []
    for n in range(2, HOT + 1):
        at = begin[size == n]
        if not at.size:
            continue
        i, j = np.triu_indices(n, 1)
        left, right = entry[at[:, None] + i].ravel(), entry[at[:, None] + j].ravel()
        same = (left["tag"] == right["tag"]) & (left["node"] != right["node"])
        a.append(np.minimum(left["node"], right["node"])[same])
        b.append(np.maximum(left["node"], right["node"])[same])
        tag.append(left["tag"][same])
    pair = np.zeros(0, [("a", "<i8"), ("b", "<i8"), ("tag", "u1")])
    if a:
        pair = np.empty(sum(x.size for x in a), pair.dtype)
        pair["a"], pair["b"], pair["tag"] = np.concatenate(a), np.concatenate(b), np.concatenate(tag)
    pair, times = np.unique(pair, return_counts=True)
    hot = size > HOT
    some = entry[np.repeat(hot, size)]
    sig = (int(key[0].as_py()) << 32) + some["sig"].astype(np.int64)
    return pa.table({
        "sig": pa.array(np.concatenate([np.zeros(pair.size, np.int64), sig])),
        "a": pa.array(np.concatenate([pair["a"], some["node"]])),
        "b": pa.array(np.concatenate([pair["b"], some["node"]])),
        "band": pa.array(np.concatenate([pair["tag"], some["tag"]]) & 127, pa.int32()),
        "units": pa.array(np.concatenate([times * (1 + (pair["tag"] >> 7)), 1 + (some["tag"] >> 7)]), pa.int64()),
    })


def _sets(batches):
    for batch in batches:
        nodes, sets = [], []
        for chunk in K.chunks(batch.column(0)):
            found, ids = K.shingle_sets(chunk)
            nodes += ids.tolist()
            sets += [s.tobytes() for s in found]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "tokens"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of every set at the left with every set at the right, exactly."""
    out = np.zeros((len(left), len(right)), np.float32)
    row = np.repeat(np.arange(len(left)), [x.size for x in left])
    col = np.repeat(np.arange(len(right)), [x.size for x in right])
    lt, rt = np.concatenate([*left, np.zeros(0, U)]), np.concatenate([*right, np.zeros(0, U)])
    both = np.intersect1d(lt, rt)
    for k in range(0, both.size, 4096):
        some = both[k : k + 4096]
        x, y = np.zeros((len(left), some.size), np.float32), np.zeros((len(right), some.size), np.float32)
        for m, who, tokens in ((x, row, lt), (y, col, rt)):
            at = np.searchsorted(some, tokens)
            ok = at < some.size
            ok[ok] = some[at[ok]] == tokens[ok]
            m[who[ok], at[ok]] = 1
        out += x @ y.T
    return out.astype(np.int64)


def _verify(percent: int):
    def run(key, table):
        nodes, weight = table.column("node").to_numpy(), table.column("weight").to_numpy()
        comp, i, j, block = (table.column(c).to_numpy() for c in ("comp", "i", "j", "block"))
        tokens = table.column("tokens").to_pylist()
        order = np.lexsort((block, j, i, comp))
        cuts = np.flatnonzero(np.any([np.diff(x[order]) != 0 for x in (comp, i, j)], axis=0)) + 1
        out: list[tuple[int, int, int]] = []
        for group in np.split(order, cuts):
            if group.size < 2:
                continue
            one = i[group[0]] == j[group[0]]
            left = group if one else group[block[group] == i[group[0]]]
            right = group if one else group[block[group] == j[group[0]]]
            ls, rs = ([np.frombuffer(tokens[k], U) for k in side] for side in (left, right))
            common = overlaps(ls, rs)
            sizes = np.array([x.size for x in ls])[:, None] + np.array([x.size for x in rs])[None, :] - common
            link = 100 * common >= percent * sizes
            if one:
                np.fill_diagonal(link, False)
            degree: dict[int, int] = {}
            for side, w in ((left, link @ weight[right]), (right, weight[left] @ link)):
                for k, x in zip(side.tolist(), w.tolist(), strict=True):
                    degree[k] = x  # within one block both sides are the same sets and sums
            root = {k: k for k in degree}

            def find(x, root=root):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for p, q in zip(*np.nonzero(link), strict=True):
                x, y = find(int(left[p])), find(int(right[q]))
                if x != y:
                    root[max(x, y)] = min(x, y)
            out += [(int(nodes[k]), int(nodes[find(k)]), n) for k, n in degree.items() if n]
        return pa.table({"u": pa.array([x[0] for x in out], pa.int64()), "v": pa.array([x[1] for x in out], pa.int64()), "links": pa.array([x[2] for x in out], pa.int64())})

    return run


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """Link documents whose sets of 5-word shingles have ``100 * intersection >= percent * union``.

    Returns a row for each input row: ``doc_id``, ``n_shingles`` (size of its set), ``component_id``
    (the smallest id reachable by links, its own included) and ``n_links`` (documents that it links
    with, copies counted). Null and empty texts and texts without words have an empty set, link
    with nothing and keep their own id. Repeated rows each get a row. A null id is linked by its
    text but never names a component unless all its ids are null, when the component is null.
    Rows of one id with unlike texts are documents of their own. Texts of any length are taken
    whole. Other columns are ignored; an empty table gives an empty result.
    """
    return _groups(docs, id_col, text_col, percent).drop("key", "label")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all their columns, that stand for their group: those with its smallest id.

    Texts without words stand for themselves, as do rows without an id, which can't be named. Rows
    that share id and text are one document, of which one row stays; of unlike texts under one id
    each is kept or goes with its own group, and of near copies under the kept id one stays.
    """
    groups = _groups(docs, id_col, text_col, percent).where("doc_id = component_id")
    rows = materialize(groups.groupBy("doc_id", "key").agg(F.max("label").alias("label"), F.count(F.lit(1)).alias("rows")), "firsts")
    first = rows.where("label IS NOT NULL").groupBy("doc_id", "label").agg(F.min("key").alias("key")).drop("label").union(rows.where("label IS NULL").select("doc_id", "key"))
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])  # positions, so that no column can clash
    of = {n: F.col(f"c{k}") for k, n in enumerate(names)}
    plain = plain.withColumn("x_key", F.xxhash64(F.coalesce(of[text_col], F.lit(""))))
    kept = materialize(first, "kept").select(F.col("doc_id").alias("y_id"), F.col("key").alias("y_key")).hint("merge")
    named = plain.join(kept, (of[id_col].cast("long") == F.col("y_id")) & (F.col("x_key") == F.col("y_key")), "left_semi")
    if rows.where("rows > 1").limit(1).count():
        named = named.dropDuplicates([f"c{names.index(id_col)}", "x_key"])
    return named.union(plain.where(of[id_col].isNull())).drop("x_key").toDF(*names)


def _groups(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """``jaccard_groups`` with ``key``, a hash of each row's text, and ``label``, which tells groups apart that the same id names."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))
    info = materialize(docs.select("text", "doc_id", "key").mapInArrow(K.tidy(_info), "doc_id long, key long, node long, n long"), "shingle-info")
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("row")
    nodes = info.where("n > 0").groupBy("node").agg(first_row, F.count(F.lit(1)).alias("weight"), F.max("n").alias("n"))
    nodes = materialize(nodes.select("node", F.col("row.doc_id").alias("least"), F.col("row.key").alias("least_key"), "weight", "n"), "nodes")
    largest = nodes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    every = bands(percent, largest)
    volume = text_volume(docs)
    parts = max(1, math.ceil(volume * 1.4 / BUCKET_BYTES))
    rows = (
        docs.select("text").mapInArrow(K.tidy(_emit(percent, largest, parts)), "bucket int, entries binary")
        .groupBy("bucket").applyInArrow(K.tidy_group(_bucket_rows), "sig long, a long, b long, band int, units long")
    )
    rows = materialize(rows, "pigeonhole")
    slack = F.element_at(F.array(*[F.lit(b.slack) for b in every] or [F.lit(0)]), F.col("band") + 1)
    hot = rows.where("a = b").select("sig", F.col("a").alias("node"), "band", "units")
    lost = materialize(hot.groupBy("node", "band").agg(F.sum("units").alias("lost")).withColumn("slack", slack), "lost")
    shared = rows.where("a <> b").groupBy("a", "b", "band").agg(F.sum("units").alias("units"))
    for side in ("a", "b"):
        shared = shared.join(lost.select(F.col("node").alias(side), "band", F.col("lost").alias(f"lost_{side}")), [side, "band"], "left")
    enough = slack + 1 - F.least(F.coalesce("lost_a", F.lit(0)), F.coalesce("lost_b", F.lit(0)))
    pairs = shared.where(F.col("units") >= enough).select(F.col("a").alias("u"), F.col("b").alias("v"))
    risky = materialize(hot.join(lost.where("lost > slack").select("node", "band"), ["node", "band"], "left_semi").select("sig", "node"), "unsafe")
    hub = materialize(risky.groupBy("sig").agg(F.min("node").alias("hub")), "hubs")
    star = risky.join(hub, "sig").where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    comps = connected_components(pairs.union(star).distinct())

    sizes = materialize(comps.groupBy("label").agg(F.count(F.lit(1)).alias("members")), "sizes")
    comps = comps.join(sizes, "label").join(nodes, "node").select("node", F.col("label").alias("comp"), "members", "weight", "least", "least_key")
    members = materialize(comps, "candidates")
    chosen = members.select(F.col("least").alias("chosen"), F.col("least_key").alias("chosen_key")).distinct()
    sets = docs.join(chosen.hint("merge"), docs.doc_id.eqNullSafe(chosen.chosen) & (docs.key == chosen.chosen_key), "left_semi").select("text").mapInArrow(K.tidy(_sets), "node long, tokens binary")
    cells = max(1, math.ceil(volume / CELL_BYTES))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    placed = (
        members.join(sets.dropDuplicates(["node"]), "node")
        .withColumn("block", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
        .withColumn("cell", F.when(F.col("members") <= BLOCK, F.pmod(F.xxhash64("comp"), F.lit(cells))).otherwise(F.xxhash64("comp", "i", "j")))
    )
    links = materialize(placed.select("cell", "node", "comp", "weight", "block", "i", "j", "tokens").groupBy("cell").applyInArrow(K.tidy_group(_verify(percent)), "u long, v long, links long"), "links")
    linked = connected_components(links.select("u", "v"))
    degree = links.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    final = linked.join(nodes, "node").groupBy("label").agg(F.min("least").alias("component"))
    final = linked.join(final, "label").join(degree, "node", "left").select("node", "component", "label", "links")
    known = nodes.join(final, "node", "left").select(F.col("node").alias("of"), F.coalesce("label", "node").alias("label"), F.coalesce("component", "least").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    known = materialize(known, "classes")
    out = info.join(known, info.node == known.of, "left")
    empty = F.col("n") == 0
    return out.select(
        "doc_id", "key", "label", F.col("n").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        F.when(empty, F.lit(0)).otherwise(F.col("links")).cast("long").alias("n_links"),
    )


#: DuckDB SQL for the query's rows; its join grows with the square of a shingle's documents.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS both_have FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * both_have >= 80 * (x.n + y.n - both_have)),
walk(node, label) AS (SELECT DISTINCT u, u FROM e UNION SELECT e.v, walk.label FROM walk JOIN e ON walk.node = e.u),
k AS (SELECT node, min(label) AS label FROM walk GROUP BY 1), d AS (SELECT u, count(*) AS links FROM e GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(k.label, doc_id) AS component_id, coalesce(d.links, 0) AS n_links
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN k ON k.node = doc_id LEFT JOIN d ON d.u = doc_id"""
