"""A Merkle manifest of a dataset: a root over all rows, and for each row a proof that it is under it.

Leaves of a group stand in order; runs of ``arity`` neighbours become their hash, level by level.
A part of the leaves alone settles most of its nodes and leaves some at its two edges: a sparse
forest of nodes keyed by group, level and index. Forests form a monoid: their union, in which each
complete run of siblings (its length follows from the number of leaves) is replaced by its parent.
Tasks build forests of their rows, ``treeReduce`` merges them; a fragment keeps no more than two
runs of each level, so what meets at the driver is bounded by the number of fragments, not of rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import numbered
from . import kernels as K
from .store import materialize

#: Rows whose forest is built at once; rows whose proofs are laid out at once.
FRAGMENT, SLICE = 1 << 19, 1 << 13


def joint(digests: Iterable[bytes]) -> bytes:
    """The hash of a run of nodes: of their digests as lower-case hex, one after the other."""
    return sha256(b"".join(d.hex().encode() for d in digests)).digest()


def level_sizes(leaves: int, arity: int) -> list[int]:
    """How many nodes each level has, from the leaves to the root."""
    sizes = [leaves]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // arity))
    return sizes


@dataclass
class Forest:
    """Unresolved nodes of a part of the leaves, and the nodes that merging has resolved.

    ``loose`` and ``joined`` hold digests by (group, level, index), ``leaves`` the number of each group's leaves.
    """

    arity: int
    loose: dict[tuple, bytes] = field(default_factory=dict)
    joined: dict[tuple, bytes] = field(default_factory=dict)
    leaves: dict = field(default_factory=dict)

    @classmethod
    def of(cls, rows: Iterable, arity: int) -> Forest:
        """The forest of nodes given as (group, leaves of the group, level, index, digest)."""
        nodes = list(rows)
        found = cls(arity, leaves={n[0]: n[1] for n in nodes})
        return found._settle({(n[0], n[2], n[3]): bytes(n[4]) for n in nodes})

    def merge(self, other: Forest) -> Forest:
        if len(self.loose) < len(other.loose):
            self, other = other, self
        merged = Forest(self.arity, dict(self.loose), self.joined | other.joined, self.leaves | other.leaves)
        return merged._settle(other.loose)

    def _settle(self, new: dict[tuple, bytes]) -> Forest:
        """Add nodes; runs of siblings that become complete give way to their parents."""
        self.loose.update(new)
        todo = [*new]
        while todo:
            group, level, at = todo.pop()
            size = self.leaves[group]
            for _ in range(level):
                size = -(-size // self.arity)
            if size == 1:
                continue
            parent = at // self.arity
            run = [(group, level, k) for k in range(parent * self.arity, min(size, (parent + 1) * self.arity))]
            if all(key in self.loose for key in run):
                own = {key: self.loose.pop(key) for key in run}
                self.joined.update(own)
                self.loose[group, level + 1, parent] = joint(own.values())
                todo.append((group, level + 1, parent))
        return self

    def roots(self) -> list[tuple]:
        """(group, root) of all groups that came together; anything else left over is an error."""
        for group, level, at in self.loose:
            if at or level_sizes(self.leaves[group], self.arity)[level] > 1:
                raise ValueError(f"nodes of group {group!r} never met their siblings")
        return [(group, digest) for (group, _, _), digest in self.loose.items()]

    def path(self, group, level: int, at: int) -> bytes:
        """The siblings that a node meets on its way to the root, level by level, each run from left to right."""
        out, sizes = [], level_sizes(self.leaves[group], self.arity)
        for k in range(level, len(sizes) - 1):
            begin = at // self.arity * self.arity
            out += [self.joined[group, k, i] for i in range(begin, min(begin + self.arity, sizes[k])) if i != at]
            at //= self.arity
        return b"".join(out)


def fold(digest: bytes, at: int, leaves: int, siblings: bytes, arity: int) -> bytes:
    """The root that a leaf at a place and its siblings give."""
    taken = 0
    while leaves > 1:
        begin = at // arity * arity
        others = min(arity, leaves - begin) - 1
        run = [siblings[taken + 32 * k : taken + 32 * (k + 1)] for k in range(others)]
        run.insert(at - begin, digest)
        digest, taken = joint(run), taken + 32 * others
        at, leaves = at // arity, -(-leaves // arity)
    if taken != len(siblings):
        raise ValueError("a proof of another length than its leaf needs")
    return digest


def grow_run(leaf: np.ndarray, first: int, leaves: int, arity: int) -> list[tuple[int, np.ndarray]]:
    """All nodes that neighbouring leaves settle: for each level the index of the first node and the digests."""
    levels = [(first, leaf)]
    sizes = level_sizes(leaves, arity)
    for size in sizes[:-1]:
        begin, nodes = levels[-1]
        end = begin + len(nodes)
        lo, hi = -(-begin // arity), -(-end // arity) if end == size else end // arity
        if hi <= lo:
            break
        spelt = nodes.tobytes().hex().encode()
        cut = [(max(0, k * arity - begin) * 64, (min((k + 1) * arity, end) - begin) * 64) for k in range(lo, hi)]
        levels.append((lo, np.frombuffer(b"".join(sha256(spelt[a:b]).digest() for a, b in cut), np.uint8).reshape(-1, 32)))
    return levels


def run_proofs(levels: list[tuple[int, np.ndarray]], leaves: int, arity: int) -> tuple[list[bytes], np.ndarray, np.ndarray, list[bytes]]:
    """For each leaf of a run: the siblings that the run itself knows, and level, index and digest of the node where they end."""
    first, leaf = levels[0]
    n, sizes = len(leaf), level_sizes(leaves, arity)
    proofs: list[bytes] = []
    edge, where = np.zeros(n, np.int32), np.zeros(n, np.int64)
    digests = np.empty((n, 32), np.uint8)
    for lo in range(0, n, SLICE):
        at = first + np.arange(lo, min(n, lo + SLICE))
        blocks, there = [], []
        live, level = np.ones(at.size, bool), np.zeros(at.size, np.int32)
        for k, (begin, nodes) in enumerate(levels[:-1]):
            above = levels[k + 1]
            parent = at // arity
            live = live & (parent >= above[0]) & (parent < above[0] + len(above[1]))
            for j in range(arity):
                other = parent * arity + j
                has = live & (other != at) & (other < sizes[k])
                blocks.append(nodes[np.clip(other - begin, 0, len(nodes) - 1)])
                there.append(has)
            level = np.where(live, k + 1, level)
            at = np.where(live, parent, at)
        if blocks:
            mask = np.stack(there, 1)
            flat = np.stack(blocks, 1)[mask].tobytes()
            ends = np.cumsum(mask.sum(1)).tolist()
            proofs += [flat[32 * a : 32 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        else:
            proofs += [b""] * at.size
        part = slice(lo, lo + at.size)
        edge[part], where[part] = level, at
        for k, (begin, nodes) in enumerate(levels):
            own = np.flatnonzero(level == k)
            digests[lo + own] = nodes[at[own] - begin]
    return proofs, edge, where, [d.tobytes() for d in digests]


_GROWN = "siblings binary, level int, node long, digest binary, whole boolean"


def _sprout(arity: int, fragment: int):
    """Adds to rows of (grp, leaf, _at, _of, …) what the rows of the task settle."""

    def settle(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("grp", "ascending"), ("_at", "ascending")])).combine_chunks()
        at, of = (table.column(c).to_numpy() for c in ("_at", "_of"))
        grp = table.column("grp").combine_chunks().dictionary_encode(null_encoding="encode")
        grp = (grp.chunk(0) if isinstance(grp, pa.ChunkedArray) else grp).indices.to_numpy()
        leaf = np.frombuffer(b"".join(table.column("leaf").to_pylist()), np.uint8).reshape(-1, 32)
        cut = [0, *(np.flatnonzero((np.diff(at) != 1) | (np.diff(grp) != 0)) + 1).tolist(), len(at)]
        proofs, level, node, digest = [], [], [], []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            p, e, w, d = run_proofs(grow_run(leaf[a:b], int(at[a]), int(of[a]), arity), int(of[a]), arity)
            proofs += p
            digest += d
            level.append(e)
            node.append(w)
        level, node = np.concatenate(level), np.concatenate(node)
        tops = {int(n): len(level_sizes(int(n), arity)) - 1 for n in np.unique(of)}
        whole = level == np.array([tops[int(n)] for n in of.tolist()])
        more = {"siblings": pa.array(proofs, pa.binary()), "level": pa.array(level), "node": pa.array(node), "digest": pa.array(digest, pa.binary()), "whole": pa.array(whole)}
        for name, values in more.items():
            table = table.append_column(name, values)
        return table

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= fragment:
                yield from settle(pa.Table.from_batches(held)).to_batches(max_chunksize=SLICE)
                held, rows = [], 0
        if held:
            yield from settle(pa.Table.from_batches(held)).to_batches(max_chunksize=SLICE)

    return run


@dataclass
class Grown:
    """Leaves with what their fragments settle, the merged forest above the fragments, and the groups' roots."""

    rows: DataFrame
    forest: Forest
    roots: DataFrame


def grow(leaves: DataFrame, order: list[Column], arity: int = 2, fragment: int = FRAGMENT) -> Grown:
    """The trees over ``leaves``: ``grp`` (string), ``leaf`` (32 bytes) and other columns, each group in ``order``.

    Rows come with their place ``_at`` among the ``_of`` leaves of their group. Groups that a single
    fragment holds are done there; only those that lie across fragments go through ``treeReduce``.
    """
    spark = leaves.sparkSession
    ranked = numbered(leaves, order, by=["grp"])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)
    rows = materialize(ranked.mapInArrow(K.tidy(_sprout(arity, fragment)), f"{kinds}, {_GROWN}"), "fragments")
    edges = rows.select("grp", "_of", "level", "node", "digest", "whole").distinct()
    loose = edges.where("NOT whole").drop("whole").rdd
    forest = Forest(arity)
    if loose.getNumPartitions():
        forest = loose.mapPartitions(lambda nodes: [Forest.of(nodes, arity)]).treeReduce(Forest.merge)
    across = spark.createDataFrame(forest.roots(), "grp string, root binary")
    roots = edges.where("whole").select("grp", F.col("digest").alias("root")).unionByName(across)
    return Grown(rows, forest, roots)


def _spelt(value: Column) -> Column:
    """A field as it is hashed: its length in bytes, a colon and itself; ``-`` for null."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def document_leaves(docs: DataFrame, every: int = 7) -> DataFrame:
    """``doc_id, lang, leaf, tampered``: the digest of each row, and of the row with n_chars + 1 where ``every`` divides the crc32 of its id."""
    count = F.col("n_chars").cast("decimal(20,0)")
    digest = lambda n: F.unhex(F.sha2(F.concat(*(_spelt(c) for c in (F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), n, F.col("text")))), 256))
    hit = F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.lit(every)) == 0
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), digest(count).alias("leaf"), F.when(hit, digest(count + 1)).alias("tampered"))


def manifest(docs: DataFrame, arity: int = 2, fragment: int = FRAGMENT) -> DataFrame:
    """The manifest of a table of documents, with a check of a tampered copy.

    Returns for each row ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` as hex:
    its digest, the roots of its language and of all, a digest of its siblings up to the root, and the
    root that these give for the row as the tampered copy has it. Rows of a language stand by
    ``doc_id``, nulls first; rows with equal ids by their digests. A null language is a group of its own and
    comes first. Repeated rows are leaves each; a null field isn't an empty one; texts are hashed whole;
    an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    under = grow(document_leaves(docs).withColumnRenamed("lang", "grp"), [F.col("doc_id").asc_nulls_first(), F.col("leaf")], arity, fragment)
    over = grow(under.roots.select(F.lit("all").alias("grp"), F.col("root").alias("leaf"), F.col("grp").alias("lang")), [F.col("lang").asc_nulls_first()], arity, fragment)
    top = over.roots.first()
    if top is None:
        return spark.createDataFrame([], _RESULT)
    root, below, above = top.root, spark.sparkContext.broadcast(under.forest), spark.sparkContext.broadcast(over.forest)

    def close(batches):
        for batch in batches:
            rows = batch.to_pylist()
            proofs = [r["siblings"] + (b"" if r["whole"] else above.value.path(r["grp"], r["level"], r["node"])) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("leaf"), batch.column("_at"), batch.column("_of"), pa.array(proofs, pa.binary())], names=["lang", "subroot", "place", "places", "beyond"])

    langs = materialize(over.rows.mapInArrow(close, "lang string, subroot binary, place long, places long, beyond binary"), "subroots")
    joined = under.rows.join(langs, under.rows["grp"].eqNullSafe(langs["lang"])).drop("lang")

    def prove(batches):
        known: dict[tuple, bytes] = {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                own = r["siblings"]
                if not r["whole"]:
                    key = (r["grp"], r["level"], r["node"])
                    if key not in known:
                        if len(known) > FRAGMENT:
                            known.clear()
                        known[key] = below.value.path(*key)
                    own += known[key]
                leaf = r["leaf"] if r["tampered"] is None else r["tampered"]
                found = fold(fold(leaf, r["_at"], r["_of"], own, arity), r["place"], r["places"], r["beyond"], arity)
                out.append((r["doc_id"], r["leaf"].hex(), r["subroot"].hex(), root.hex(), sha256((own + r["beyond"]).hex().encode()).hexdigest(), found.hex(), found == root))
            kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names=[f.split()[0] for f in _RESULT.split(", ")])

    return joined.mapInArrow(K.tidy(prove), _RESULT)


_RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

#: DuckDB SQL for the rows of ``manifest`` with runs of two.
ORACLE = """
WITH RECURSIVE given AS (
  SELECT row_number() OVER () AS r, doc_id, lang, n_chars,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
      || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord((doc_id::VARCHAR)[i])::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1))))) AS crc
  FROM documents),
spelt AS (
  SELECT r, doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN crc % 7 = 0 THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS tampered
  FROM given),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM spelt),
tree(lang, lvl, pos, n, h) AS (
  SELECT lang, 0, pos, n, leaf FROM leaves
  UNION ALL SELECT lang, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY lang, lvl, n, pos // 2),
subroots AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
crown(lvl, pos, n, h) AS (
  SELECT 0, pos, n, h FROM subroots
  UNION ALL SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM crown WHERE n > 1 GROUP BY lvl, n, pos // 2),
low(r, lang, lvl, pos, n, folded, proof) AS (
  SELECT r, lang, 0, pos, n, coalesce(tampered, leaf), '' FROM leaves
  UNION ALL
  SELECT p.r, p.lang, p.lvl + 1, p.pos // 2, (p.n + 1) // 2, sha256(CASE WHEN p.pos % 2 = 0 THEN p.folded || coalesce(s.h, '') ELSE s.h || p.folded END), p.proof || coalesce(s.h, '')
  FROM low p LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM p.lang AND s.lvl = p.lvl AND s.pos = xor(p.pos, 1) WHERE p.n > 1),
high(r, lvl, pos, n, folded, proof) AS (
  SELECT p.r, 0, s.pos, s.n, p.folded, p.proof FROM low p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang WHERE p.n = 1
  UNION ALL
  SELECT p.r, p.lvl + 1, p.pos // 2, (p.n + 1) // 2, sha256(CASE WHEN p.pos % 2 = 0 THEN p.folded || coalesce(s.h, '') ELSE s.h || p.folded END), p.proof || coalesce(s.h, '')
  FROM high p LEFT JOIN crown s ON s.lvl = p.lvl AND s.pos = xor(p.pos, 1) WHERE p.n > 1)
SELECT l.doc_id, l.leaf, s.h AS subroot, c.h AS root, sha256(p.proof) AS proof_sha256, p.folded AS folded_root, p.folded = c.h AS verified
FROM leaves l JOIN high p ON p.r = l.r AND p.n = 1 JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN (SELECT h FROM crown WHERE n = 1) c
"""
