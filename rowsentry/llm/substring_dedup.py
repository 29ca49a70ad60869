"""Removal of passages that repeat across documents: paragraph MinHash banding.

A document's paragraphs are its lines of ``least_words`` words or more and, of lines longer than
``CUT_FROM`` words, the pieces between content-defined words, so that an insertion moves no other
cut. Their five-word shingles are min-hashed and banded; paragraphs that share a band are compared
by exact Jaccard similarity, in blocks where they are many, and similar ones form components.

A repeat may also stand anywhere within other text. So passages of ``PASSAGE_WORDS`` words begin at
content-defined anchors (the least word hash of as many consecutive words): any 47 repeated words
hold one whole, and equal passages are one component.

Of each component the first paragraph, by document id and place, stays. What goes is extended word
by word as far as the text that keeps it reads the same, and goes if at least ``least_words`` words
in a row repeat one text.

Paragraphs are sorted by content and by band signature, and what belongs together is met in one
pass over the sorted rows, in constant memory. Where texts of one chunk share a content, two rows
stand for it in that shuffle; the others are known to be shared and go past it.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from . import kernels as K
from .jaccard_join import overlaps
from .store import discard, materialize, small_batches

U = np.uint64
PERCENT = 80
#: The shortest run of repeated words that counts, and the words of a passage.
LEAST_WORDS, PASSAGE_WORDS = 25, 24
#: Lines of more words are also cut, at words of the least hash among ``CUT`` on either side.
CUT_FROM, CUT = 96, 24
#: Lines of more words are compared by their pieces alone.
WHOLE_LINE = 4096
#: Hash functions and the recall at the threshold to which the bands are tuned.
HASHES, RECALL = 36, 0.99
#: In a band with this many different contents or fewer, pairs of contents are joined; more are compared in blocks.
PAIRED = 16
#: Contents in a block, and bytes of their shingles in a block or a cell of small bands.
BLOCK, CELL_BYTES = 512, 1 << 20
REMEMBERED = 500_000
#: Kinds of rows that the pass over the texts emits; ``SHARED`` is added to paragraphs whose content is known to be shared.
ROW, PASSAGE, LINE, PIECE, SIGNATURE = range(5)
SHARED = 8
EMITTED = "kind int, a long, b long, at long, length long"
PARAGRAPH = "kind int, content long, node long, at long, length long"


def tune(hashes: int, recall: float, similarity: float = PERCENT / 100) -> tuple[int, int]:
    """Bands and rows: the most rows (the fewest false joins) that find pairs at the similarity with the recall."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = hashes // rows
        if bands and 1 - (1 - similarity**rows) ** bands >= recall:
            best = (bands, rows)
    return best


_SALTS, _ODD = np.random.default_rng(29).integers(1, 2**63, size=(2, HASHES), dtype=np.int64).astype(U)
_ODD |= U(1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    n, size = x.size - width + 1, 1
    if n <= 0:
        return np.zeros(0, x.dtype)
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n])


class Paragraphs:
    """The words of a chunk of texts, its paragraphs and its passages (their rows, first words and lengths)."""

    def __init__(self, chunk: K.Chunk, least: int = LEAST_WORDS):
        low = chunk.lower()
        self.start, self.end, self.first = low.words()
        self.word = low.hashes(self.start, self.end)
        self.least, self.span = least, min(PASSAGE_WORDS, least)
        self.low = low
        n = self.word.size - K.SHINGLE + 1
        self.shingle = np.zeros(max(n, 0), U)
        if n > 0:
            for k in range(K.SHINGLE):
                self.shingle += self.word[k : k + n] * K._SLOT[k]
            self.shingle = K.mix(self.shingle)

    @cached_property
    def key(self) -> np.ndarray:
        """Hashes of words; the place in the low bits picks one of equal ones."""
        return (K.mix(self.word) & ~U(0xFFFFFFFF)) | np.arange(self.word.size, dtype=U)

    def lines(self) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """Rows, first words and lengths of lines and pieces, and which are pieces."""
        ls, le, _ = self.low.lines()
        return self._lines(np.searchsorted(self.start, ls), np.searchsorted(self.start, le))

    def _lines(self, a: np.ndarray, b: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        whole = (b - a >= self.least) & (b - a <= WHOLE_LINE)
        long = b - a > CUT_FROM
        begin, end = [a[whole]], [b[whole]]
        if long.any():
            key = self.key
            at = np.flatnonzero(sliding_min(key, 2 * CUT + 1) == key[CUT : key.size - CUT]) + CUT
            x, y = a[long], b[long]
            own = np.searchsorted(x, at, side="right") - 1
            inside = (own >= 0) & (at - CUT >= x[own]) & (at + CUT < y[own])
            cut = np.sort(np.concatenate([x, at[inside]]))
            stop = np.minimum(np.append(cut[1:], self.word.size), y[np.searchsorted(x, cut, side="right") - 1])
            piece = (stop - cut >= self.least) & ~(np.isin(cut, x) & np.isin(stop, y) & (stop - cut <= WHOLE_LINE))
            begin.append(cut[piece])
            end.append(stop[piece])
        at, end = np.concatenate(begin), np.concatenate(end)
        return (np.searchsorted(self.first, at, side="right") - 1, at, end - at), np.arange(at.size) >= whole.sum()

    def passages(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows and first words of the passages: at the least hash in any ``span`` consecutive words of a text."""
        n = self.word.size - self.span + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        least = (sliding_min(self.key, self.span) & U(0xFFFFFFFF)).astype(np.int64)
        begin = np.arange(n)
        stop = self.first[np.searchsorted(self.first, begin, side="right")]
        at = least[begin + self.span <= stop]
        at = at[np.append(True, np.diff(at) != 0)[: at.size]]  # they never go back
        row = np.searchsorted(self.first, at, side="right") - 1
        keep = at + self.span <= self.first[row + 1]
        return row[keep], at[keep]

    def passage_contents(self, at: np.ndarray) -> np.ndarray:
        """A hash of the word sequence of each passage."""
        h = np.full(at.size, self.span, dtype=U)
        for k in range(self.span):
            h = K.mix(h ^ self.word[at + k])
        return h.view(np.int64)

    def line_contents(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """A hash of the word sequence of each paragraph."""
        raw = memoryview(self.word.tobytes())
        found = [hashlib.blake2b(raw[8 * a : 8 * (a + n)], digest_size=8).digest() for a, n in zip(at.tolist(), length.tolist(), strict=True)]
        return np.frombuffer(b"".join(found), np.int64)

    def signatures(self, at: np.ndarray, length: np.ndarray, bands: int, rows: int) -> np.ndarray:
        """The band signatures of paragraphs, a row for each."""
        out = np.empty((at.size, bands), dtype=U)
        count = length - K.SHINGLE + 1
        # the least of a paragraph is that of runs of ``width`` shingles that cover it
        width = 1 << min(4, int(count.min()).bit_length() - 1)
        runs = -(-count // width)
        first = np.cumsum(runs) - runs
        within = np.arange(runs.sum()) - np.repeat(first, runs)
        cover = np.minimum(np.repeat(at, runs) + within * width, np.repeat(at + count - width, runs))
        for b in range(bands):
            sig = np.full(at.size, b + 1, dtype=U)
            for r in range(rows):
                h = sliding_min((self.shingle ^ _SALTS[b * rows + r]) * _ODD[b * rows + r], width)
                sig = K.mix(sig ^ np.minimum.reduceat(h[cover], first))
            out[:, b] = sig
        return out.view(np.int64)

    def distinct(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """How many different shingles each paragraph has."""
        value = np.sort(self.shingle)
        twice = np.unique(value[1:][value[1:] == value[:-1]])
        count = length - K.SHINGLE + 1
        if twice.size:
            near = np.minimum(np.searchsorted(twice, self.shingle), twice.size - 1)
            places = np.flatnonzero(twice[near] == self.shingle)
            a, b = np.searchsorted(places, at), np.searchsorted(places, at + count)
            for k in np.flatnonzero(b - a > 1).tolist():
                own = self.shingle[places[a[k] : b[k]]]
                count[k] -= own.size - np.unique(own).size
        return count

    def tokens(self, at: int, length: int) -> np.ndarray:
        """The shingles of a paragraph in order."""
        return self.shingle[at : at + length - K.SHINGLE + 1]


def _emit(least: int, bands: int, rows: int):
    """A row for each text; each paragraph and passage as (content, node, place, words); and the paragraphs' signatures with their sizes."""

    def table(kind, a, b, at, length):
        kind = pa.array(kind if isinstance(kind, np.ndarray) else np.full(len(b), kind), pa.int32())
        return pa.RecordBatch.from_arrays([kind, a if isinstance(a, pa.Array) else pa.array(a), *(pa.array(x.astype(np.int64)) for x in (b, at, length))], names=["kind", "a", "b", "at", "length"])

    def common(kind, content, node):
        """The kinds of paragraphs; where texts share a content, ``SHARED`` is added to all but one row for each of two texts."""
        order = np.lexsort((node, content))
        c, n = content[order], node[order]
        new = np.append(True, c[1:] != c[:-1])
        head = np.flatnonzero(new)
        new_text = new | np.append(True, n[1:] != n[:-1])
        place = np.cumsum(new_text)
        size = np.diff(np.append(head, c.size))
        place -= np.repeat(place[head], size)
        shared = np.repeat(np.maximum.reduceat(place, head) > 0, size)
        out = kind.copy()
        out[order] += np.where(shared & ~(new_text & (place < 2)), SHARED, 0)
        return out

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            every = batch.column(1).to_numpy()
            for chunk in K.chunks(batch.column(2)):
                node = every[chunk.first : chunk.first + chunk.n]
                p = Paragraphs(chunk, least)
                n_words = np.diff(p.first)
                yield table(ROW, batch.column(0).slice(chunk.first, chunk.n), node, n_words, n_words)
                if len(seen) > REMEMBERED:
                    seen.clear()
                chosen = np.zeros(chunk.n, bool)
                for i in np.flatnonzero(n_words >= least).tolist():  # a copy in the same task adds nothing
                    if node[i] not in seen:
                        seen.add(int(node[i]))
                        chosen[i] = True
                row, at = p.passages()
                row, at = row[chosen[row]], at[chosen[row]]
                (line, begin, length), is_piece = p.lines()
                some = chosen[line]
                line, begin, length = line[some], begin[some], length[some]
                content = p.line_contents(begin, length)
                if not at.size + begin.size:
                    continue
                kind = np.concatenate([np.full(at.size, PASSAGE), np.where(is_piece[some], PIECE, LINE)])
                whole = np.concatenate([p.passage_contents(at), content])
                owner, place = np.concatenate([row, line]), np.concatenate([at, begin])
                yield table(common(kind, whole, node[owner]), whole, node[owner], place - p.first[owner], np.concatenate([np.full(at.size, p.span), length]))
                content, one = np.unique(content, return_index=True)
                if content.size:
                    sig, n = p.signatures(begin[one], length[one], bands, rows), p.distinct(begin[one], length[one])
                    yield table(SIGNATURE, sig.ravel(), np.repeat(content, bands), np.repeat(n, bands), np.zeros(sig.size))

    return run


def _groups(batches, column: int, hold):
    """Sorted batches cut so that all rows of a value of ``column`` come together, unless ``hold`` lets a part of them go.

    ``hold(rows)`` gets what has come of the last value and says whether it must wait for the rest.
    Yields the rows as arrays, and whether their first value goes on from what has been let go.
    """
    rest: list[np.ndarray] | None = None
    gone = None
    for batch in batches:
        rows = [c.to_numpy() for c in batch.columns]
        if rest is not None:
            rows = [np.concatenate(x) for x in zip(rest, rows, strict=True)]
        key = rows[column]
        if not key.size:
            continue
        cut = int(np.searchsorted(key, key[-1]))
        tail = [x[cut:] for x in rows]
        if gone is not None and key[-1] == gone or not hold(tail):
            yield rows, gone is not None and key[0] == gone
            rest, gone = None, key[-1]
        else:
            if cut:
                yield [x[:cut] for x in rows], gone is not None and key[0] == gone
            rest = tail
    if rest is not None:
        yield rest, gone is not None and rest[column][0] == gone


def _shared(batches):
    """Of rows sorted by content: those of contents that two texts hold."""
    names = [x.split()[0] for x in PARAGRAPH.split(", ")]
    for rows, goes_on in _groups(batches, 1, lambda r: r[2].min() == r[2].max()):
        content, node = rows[1:3]
        head = np.flatnonzero(np.append(True, content[1:] != content[:-1]))
        two = np.minimum.reduceat(node, head) != np.maximum.reduceat(node, head)
        two[0] |= goes_on
        keep = np.repeat(two, np.diff(np.append(head, content.size)))
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in rows], names=names)


MET = "sig long, u long, v long"


def _meet(percent: int):
    """Of rows sorted by signature: pairs of contents whose sizes let them be similar, where few share a signature; else each content with the signature."""

    def run(batches):
        for (sig, content, n), goes_on in _groups(batches, 0, lambda r: np.unique(r[1]).size <= PAIRED):
            # most signatures are of one paragraph
            same = np.append(False, sig[1:] == sig[:-1])
            some = np.flatnonzero(same | np.append(same[1:], False) | (goes_on & (sig == sig[0])))
            some = some[np.lexsort((content[some], sig[some]))]
            sig, content, n = sig[some], content[some], n[some]
            new = np.append(True, (sig[1:] != sig[:-1]) | (content[1:] != content[:-1]))[: sig.size]
            sig, content, n = sig[new], content[new], n[new]
            if not sig.size:
                continue
            head = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
            size = np.diff(np.append(head, sig.size))
            many = size > PAIRED
            many[0] |= goes_on  # the first rows are those that go on: a signature's order is kept
            hot = np.repeat(many, size)
            left, right = [], []
            for k in np.unique(size[~many & (size > 1)]):
                i, j = np.triu_indices(k, 1)
                at = head[(size == k) & ~many][:, None]
                left.append((at + i).ravel())
                right.append((at + j).ravel())
            a, b = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (left, right))
            near = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
            a, b = a[near], b[near]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([sig[hot], np.zeros(a.size, np.int64)]), mask=np.arange(hot.sum() + a.size) >= hot.sum()), pa.array(np.concatenate([content[hot], content[a]])), pa.array(np.concatenate([content[hot], content[b]]))],
                names=["sig", "u", "v"],
            )

    return run


FETCHED = "of long, place long, side int, raw binary"


def _fetch(least: int, words: int):
    """Of each text: the shingles of wanted paragraphs, in order (``side`` -1); and the hashes (32 bits) of the next ``words`` words on a side of wanted places."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            wanted, places, nodes = (batch.column(k).to_pylist() for k in (1, 2, 3))
            before = None
            for chunk in K.chunks(batch.column(0)):
                p = None
                for i in range(chunk.n):
                    k = chunk.first + i
                    if nodes[k] == before:  # a repeated row
                        continue
                    before = nodes[k]
                    p = p or Paragraphs(chunk, least)
                    for w in wanted[k] or ():
                        out.append((w["content"], 0, -1, p.tokens(int(p.first[i]) + w["at"], w["length"]).tobytes()))
                    own = p.word[p.first[i] : p.first[i + 1]]
                    for w in places[k] or ():
                        at = w["place"]
                        near = own[at : at + words] if w["side"] else own[max(at - words, 0) : at][::-1]
                        out.append((nodes[k], at, w["side"], (near >> U(32)).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["of", "place", "side", "raw"])

    return run


def _similar(percent: int):
    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if a == b:
                    keep[i] = True
                    continue
                x, y = np.unique(np.frombuffer(a, U)), np.unique(np.frombuffer(b, U))
                both = np.intersect1d(x, y, assume_unique=True).size
                keep[i] = 100 * both >= percent * (x.size + y.size - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep))

    return run


def _block_links(percent: int):
    """Within a cell: for contents that similar ones connect, a star that connects them too."""

    def run(key, table):
        content, hot, i, j, block = (table.column(c).to_numpy() for c in ("content", "sig", "i", "j", "block"))
        tokens = table.column("tokens").to_pylist()
        order = np.lexsort((block, j, i, hot))
        cuts = np.flatnonzero(np.any([np.diff(x[order]) != 0 for x in (hot, i, j)], axis=0)) + 1
        out: list[tuple[int, int]] = []
        for group in np.split(order, cuts):
            one = i[group[0]] == j[group[0]]
            left = group if one else group[block[group] == i[group[0]]]
            right = group if one else group[block[group] == j[group[0]]]
            if not left.size or not right.size:
                continue
            ls, rs = ([np.unique(np.frombuffer(tokens[k], U)) for k in side] for side in (left, right))
            ln, rn = (np.array([x.size for x in side]) for side in (ls, rs))
            if one:  # a shingle of one content is in no intersection of two
                value, times = np.unique(np.concatenate(ls), return_counts=True)
                value = value[times > 1]
                ls = rs = [np.intersect1d(x, value, assume_unique=True) for x in ls]
            common = overlaps(ls, rs)
            link = 100 * common >= percent * (ln[:, None] + rn[None, :] - common)
            if one:
                np.fill_diagonal(link, False)
            u, v = content[left], content[right]
            free_u, free_v = link.any(1), link.any(0)
            for p in range(left.size):
                if not free_u[p]:
                    continue
                rows, free_u[p] = np.array([p]), False
                while rows.size:
                    cols = np.flatnonzero(link[rows].any(0) & free_v)
                    free_v[cols] = False
                    out += [(u[p], x) for x in v[cols]]
                    rows = np.flatnonzero(link[:, cols].any(1) & free_u)
                    free_u[rows] = False
                    out += [(u[p], x) for x in u[rows]]
        return pa.table({"u": pa.array([x[0] for x in out], pa.int64()), "v": pa.array([x[1] for x in out], pa.int64())})

    return run


def similar_contents(met: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """``content, label`` of the contents of paragraphs that are similar to another one; the label is their component's."""
    left = tokens.select(F.col("content").alias("u"), F.col("tokens").alias("left"))
    right = tokens.select(F.col("content").alias("v"), F.col("tokens").alias("right"))
    pairs = materialize(met.where("sig IS NULL").select("u", "v").distinct(), "pairs")
    links = pairs.join(left, "u").join(right, "v").select("u", "v", "left", "right").mapInArrow(K.tidy(_similar(percent)), "u long, v long")
    many = met.where("sig IS NOT NULL").select("sig", F.col("u").alias("content"))
    width = F.octet_length("tokens")
    held = materialize(many.join(tokens, "content"), "hot-bands")
    sizes = held.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("volume"))
    cells = max(1, held.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0] // CELL_BYTES)
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("volume") / CELL_BYTES)).cast("int")
    placed = (
        held.join(materialize(sizes, "hot-sizes"), "sig").withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("content"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
        .withColumn("cell", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("sig"), F.lit(cells))).otherwise(F.xxhash64("sig", "i", "j")))
    )
    within = placed.select("cell", "sig", "content", "block", "i", "j", "tokens").groupBy("cell").applyInArrow(K.tidy_group(_block_links(percent)), "u long, v long")
    similar = materialize(links.union(within), "similar")
    labels = connected_components(similar).withColumnRenamed("node", "content")
    discard(pairs, held, similar)
    return labels


def _trim(batches):
    """Words at both ends of a paragraph and of the one that keeps it that the two don't share; none where they share no shingle."""
    for batch in batches:
        out = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(a, U), np.frombuffer(b, U)
            both = [np.flatnonzero(np.isin(x, y)), np.flatnonzero(np.isin(y, x))]
            out.append([n for z, at in zip((x, y), both, strict=True) for n in ((int(at[0]), int(z.size - 1 - at[-1])) if at.size else (0, 0))])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in out], pa.int64()) for k in range(4))], names=["content", "first_content", "lead", "trail", "first_lead", "first_trail"])


def trimmed(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """``spans`` whose pieces that are similar to what keeps them, but not equal, begin and end with words that both share."""
    apart = (F.col("kind") == PIECE) & (F.col("content") != F.col("first_content"))
    pairs = spans.where(apart).select("content", "first_content").distinct().join(tokens.withColumnRenamed("tokens", "own"), "content")
    pairs = pairs.join(tokens.select(F.col("content").alias("first_content"), F.col("tokens").alias("theirs")), "first_content")
    trims = pairs.select("content", "first_content", "own", "theirs").mapInArrow(K.tidy(_trim), "content long, first_content long, lead long, trail long, first_lead long, first_trail long")
    out = spans.join(materialize(trims, "trims"), ["content", "first_content"], "left")
    off = lambda n: F.when(apart, F.coalesce(n, F.lit(0))).otherwise(F.lit(0))
    own = [x for x in spans.columns if x not in ("at", "length", "first_at", "first_length", "content", "first_content", "kind")]
    moved = [y for p in ("", "first_") for y in ((F.col(f"{p}at") + off(f"{p}lead")).alias(f"{p}at"), (F.col(f"{p}length") - off(f"{p}lead") - off(f"{p}trail")).alias(f"{p}length"))]
    return out.select(*own, *moved)


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(node, least, ..)`` with the text of each node, from one of its rows; null ids meet null ids."""
    by = docs.select(F.col("doc_id").alias("row_id"), F.col("node").alias("row_node"), "text")
    found = by.join(wanted.hint("merge"), by.row_id.eqNullSafe(wanted.least) & (by.row_node == wanted.node))
    return found.drop("row_id", "row_node")


#: A paragraph of a text, and of whom it repeats: the first one of its component.
SPAN = ("at", "length", "first_doc", "first_node", "first_at", "first_length")


class Repeats:
    """The repeated spans of a batch of texts, as arrays, with runs and segments.

    A segment is a stretch that goes, aligned with one text that keeps it; a run is a stretch of
    overlapping or adjoining segments.
    """

    def __init__(self, spans: pa.ListArray):
        offsets = spans.offsets.to_numpy() - spans.offsets[0].as_py() if len(spans) else np.zeros(1, np.int64)
        flat = spans.flatten()
        row = np.repeat(np.arange(len(spans)), np.diff(offsets))
        at, length, node, first_at, first_length = (flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("at", "length", "first_node", "first_at", "first_length"))
        kept, exact = (flat.field(n).to_numpy(zero_copy_only=False).astype(bool) for n in ("kept", "exact"))
        self.doc = flat.field("first_doc")
        self.kept = _union(row[kept], at[kept], at[kept] + length[kept])
        gone = np.flatnonzero(~kept)
        gone = gone[np.lexsort((at[gone], exact[gone], (at - first_at)[gone], node[gone], row[gone]))]
        row, at, length, node, first_at, first_length, exact = (x[gone] for x in (row, at, length, node, first_at, first_length, exact))
        self.span, end, n = gone, at + length, at.size
        new = np.ones(n, bool)
        if n:
            new[1:] = np.any([np.diff(x) != 0 for x in (row, node, at - first_at, exact.astype(np.int8))], axis=0)
            # a segment ends where no earlier span of its alignment reaches the next one
            lift = (np.cumsum(new) - 1) * (end.max() + 1)
            new[1:] |= at[1:] > np.maximum.accumulate(end + lift)[:-1] - lift[1:]
        head = np.flatnonzero(new)
        last = np.maximum.reduceat(end * n + np.arange(n), head) % n if n else head
        self.row, self.node, self.a, self.b = row[head], node[head], at[head], end[last]
        self.key = {0: first_at[head], 1: first_at[last] + first_length[last]}
        self.head = head
        self.runs = _union(self.row, self.a, self.b)

    def run_of(self) -> np.ndarray:
        """The run of each segment."""
        row, a, _ = self.runs
        width = int(max(a.max(initial=0), self.a.max(initial=0))) + 1
        return np.searchsorted(row * width + a, self.row * width + self.a, side="right") - 1

    def wanted(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Segments and sides (0 left, 1 right) whose neighbourhood matters: those that end within a passage of their run's end, and all in runs without a long segment.

        The outermost one may belong to a similar paragraph that ends some words off.
        """
        run = self.run_of()
        short = np.ones(self.runs[0].size, bool)
        short[run[self.b - self.a >= least]] = False
        out = []
        for side, edge, of in ((0, self.a, self.runs[1]), (1, self.b, self.runs[2])):
            some = np.flatnonzero((abs(edge - of[run]) < PASSAGE_WORDS) | short[run])
            out.append((some, np.full(some.size, side)))
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _union(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and adjoining intervals of each row, joined."""
    if not row.size:
        return row, a, b
    order = np.lexsort((a, row))
    row, a, b = row[order], a[order], b[order]
    lift = row * (int(b.max()) + 2)
    reach = np.maximum.accumulate(b + lift)
    new = np.append(True, (a + lift)[1:] > reach[:-1])
    head = np.flatnonzero(new)
    return row[head], a[head], np.append(reach[head[1:] - 1], reach[-1]) - lift[head]


def _ends(least: int):
    """Where the neighbouring words of a segment and of the paragraph that keeps it are to be compared."""

    def run(batches):
        for batch in batches:
            r = Repeats(batch.column(1))
            some, side = r.wanted(least)
            place = np.where(side == 0, r.a[some], r.b[some])
            key = np.where(side == 0, r.key[0][some], r.key[1][some])
            own = pa.array(r.row[some])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(own), batch.column(2).take(own), pa.array(place), pa.array(side.astype(np.int32)), r.doc.take(pa.array(r.span[r.head[some]])), pa.array(r.node[some]), pa.array(key)],
                names=["node", "least", "place", "side", "key_doc", "key_node", "key_place"],
            )

    return run


def _reach(words: int):
    """How many words beside a segment equal those beside the paragraph that keeps it."""

    def run(batches):
        for batch in batches:
            a, b = (np.zeros((batch.num_rows, words), "<u4") for _ in range(2))
            n = np.full(batch.num_rows, words)
            for x, column in ((a, batch.column(5)), (b, batch.column(6))):
                for i, raw in enumerate(column.to_pylist()):
                    got = np.frombuffer(raw, "<u4")
                    x[i, : got.size] = got
                    n[i] = min(n[i], got.size)
            same = np.where((a != b).any(1), (a != b).argmax(1), words)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(np.minimum(same, n).astype(np.int64))], names=["node", "place", "side", "key_node", "key_place", "reach"])

    return run


def _decide(least: int):
    """The runs that go from each text, by which documents and texts they are kept, and how many repeated passages it keeps."""

    def run(batches):
        for batch in batches:
            r = Repeats(batch.column(1))
            reach: dict[tuple, int] = {}
            for i, found in enumerate(batch.column(2).to_pylist()):
                for x in found or ():
                    reach[i, x["side"], x["place"], x["key_node"], x["key_place"]] = x["reach"]
            a, b = r.a.copy(), r.b.copy()
            if reach:
                for k, (i, node, left, right) in enumerate(zip(r.row.tolist(), r.node.tolist(), r.key[0].tolist(), r.key[1].tolist(), strict=True)):
                    a[k] -= reach.get((i, 0, int(r.a[k]), node, left), 0)
                    b[k] += reach.get((i, 1, int(r.b[k]), node, right), 0)
            run = r.run_of()
            long = np.zeros(r.runs[0].size, bool)
            long[run[b - a >= least]] = True
            some = np.flatnonzero(long[run])
            row, x, y = _union(r.row[some], a[some], b[some])
            doc = r.doc.take(pa.array(r.span[r.head[some]])).to_pylist()
            by: list[set] = [set() for _ in range(batch.num_rows)]
            nodes: list[set] = [set() for _ in range(batch.num_rows)]
            for i, d, n in zip(r.row[some].tolist(), doc, r.node[some].tolist(), strict=True):
                nodes[i].add(n)
                if d is not None:
                    by[i].add(d)
            runs: list[list] = [[] for _ in range(batch.num_rows)]
            for i, p, q in zip(row.tolist(), x.tolist(), y.tolist(), strict=True):
                runs[i].append({"a": p, "b": q})
            held = np.bincount(r.kept[0][r.kept[2] - r.kept[1] >= least], minlength=batch.num_rows)
            kinds = (pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([sorted(z) if isinstance(z, set) else z for z in c], t) for c, t in zip((runs, by, nodes), kinds, strict=True)), pa.array(held.astype(np.int64))], names=["node", "runs", "by", "by_nodes", "held"])

    return run


def repeated_runs(docs: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """Per row of ``docs(doc_id, text, node)``: ``(doc_id, node, n_words, least)``; per text with repeats: what goes.

    The second table holds ``node``, ``runs`` (first word and the word after the last), ``by`` (the
    documents that keep them), ``by_nodes`` (their texts) and ``held`` (its own passages that others repeat).
    """
    if least < K.SHINGLE:
        raise ValueError(f"least_words must be {K.SHINGLE} or more")
    bands, rows = tune(HASHES, RECALL, percent / 100)
    emitted = materialize(docs.select("doc_id", "node", "text").mapInArrow(K.tidy(_emit(least, bands, rows)), EMITTED), "emitted")
    info = materialize(emitted.where(F.col("kind") == ROW).select(F.col("a").alias("doc_id"), F.col("b").alias("node"), F.col("at").alias("n_words")), "texts")
    nodes = materialize(info.where(F.col("n_words") >= least).groupBy("node").agg(F.min("doc_id").alias("least")), "text-nodes")
    kinds = lambda *some: emitted.where(F.col("kind").isin(*some)).select(F.pmod("kind", F.lit(SHARED)).alias("kind"), F.col("a").alias("content"), F.col("b").alias("node"), "at", "length")
    plain = kinds(PASSAGE, LINE, PIECE).repartition("content").sortWithinPartitions("content")
    both = plain.mapInArrow(K.tidy(_shared), PARAGRAPH).union(kinds(*(k + SHARED for k in (PASSAGE, LINE, PIECE))))
    members = materialize(both.join(nodes, "node"), "members")
    signed = emitted.where(F.col("kind") == SIGNATURE).select(F.col("a").alias("sig"), F.col("b").alias("content"), F.col("at").alias("n"))
    met = materialize(signed.repartition("sig").sortWithinPartitions("sig").mapInArrow(K.tidy(_meet(percent)), MET), "met")
    # exact repeats: what keeps them, and the words beside the ends of what goes
    order = F.struct(F.col("least").isNull().alias("last"), F.col("least").alias("doc"), "node", "at", "length", "content")
    firsts = [F.col(f"first.{x}").alias(f"first_{x}") for x in ("doc", "node", "at", "length", "content")]
    keeper = materialize(members.groupBy("content").agg(F.min(order).alias("first")).select("content", *firsts[:-1]), "keepers")
    kept = (F.col("first_node") == F.col("node")).alias("kept")
    exact = members.join(keeper, "content").groupBy("node").agg(F.collect_list(F.struct(*SPAN, kept, F.lit(True).alias("exact"))).alias("spans"), F.min("least").alias("least"))
    exact = materialize(exact.select("node", "spans", "least"), "exact")
    ends = exact.mapInArrow(K.tidy(_ends(least)), "node long, least long, place long, side int, key_doc long, key_node long, key_place long")
    ends = materialize(ends, "ends")
    sides = ends.select("node", "least", "place", "side").union(ends.select("key_node", "key_doc", "key_place", "side")).distinct()
    # near repeats: one text of each content that meets others
    contents = met.select("u").union(met.select("v")).distinct().withColumnRenamed("u", "content")
    some = kinds(LINE, PIECE).join(contents, "content", "left_semi").groupBy("content").agg(F.min(F.struct("node", "at", "length", "kind")).alias("h"))
    heads = materialize(some.select("content", "h.*").join(nodes, "node"), "heads")
    # one look at the texts for both
    no_unit, no_place = F.lit(None).cast("struct<at:long,length:long,content:long>"), F.lit(None).cast("struct<place:long,side:int>")
    wanted = heads.select("node", "least", F.struct("at", "length", "content").alias("unit"), no_place.alias("place")).union(sides.select("node", "least", no_unit, F.struct("place", "side")))
    wanted = materialize(wanted.groupBy("node", "least").agg(F.collect_list("unit").alias("units"), F.collect_list("place").alias("places")), "wanted")
    fetched = materialize(_texts_of(docs, wanted).select("text", "units", "places", "node").mapInArrow(K.tidy(_fetch(least, PASSAGE_WORDS - 1)), FETCHED), "fetched")
    discard(emitted, keeper, wanted)
    tokens = fetched.where("side < 0").select(F.col("of").alias("content"), F.col("raw").alias("tokens"))
    beside = fetched.where("side >= 0").select(F.col("of").alias("node"), "place", "side", F.col("raw").alias("beside"))
    theirs = beside.toDF("key_node", "key_place", "side", "theirs")
    reach = ends.join(theirs, ["key_node", "key_place", "side"]).join(beside, ["node", "place", "side"])
    reach = reach.select("node", "place", "side", "key_node", "key_place", "beside", "theirs").mapInArrow(K.tidy(_reach(PASSAGE_WORDS - 1)), "node long, place long, side int, key_node long, key_place long, reach long").where("reach > 0")
    reach = reach.groupBy("node").agg(F.collect_list(F.struct("place", "side", "key_node", "key_place", "reach")).alias("found"))
    labels = similar_contents(met, tokens, percent)
    columns = ["kind", "content", "node", "at", "length", "least"]
    near = members.where(F.col("kind") != PASSAGE).select(columns).union(heads.select(columns)).distinct().join(labels, "content")
    near = materialize(near, "near")
    first = materialize(near.groupBy("label").agg(F.min(order).alias("first")).select("label", *firsts), "near-keepers")
    spans = trimmed(near.join(first, "label").where("content <> first_content"), tokens)
    spans = materialize(spans.groupBy("node").agg(F.collect_list(F.struct(*SPAN, kept, F.lit(False).alias("exact"))).alias("near")), "near-spans")
    none = F.array().cast(exact.schema["spans"].dataType)
    both = exact.select("node", "spans").join(spans, "node", "full").select("node", F.concat(F.coalesce("spans", none), F.coalesce("near", none)).alias("spans"))
    result = both.join(reach, "node", "left").select("node", "spans", "found").mapInArrow(K.tidy(_decide(least)), "node long, runs array<struct<a:long,b:long>>, by array<long>, by_nodes array<long>, held long")
    result = materialize(result.where("size(runs) > 0 OR held > 0"), "repeats")
    discard(members, met, exact, ends, heads, fetched, near, first, spans)
    return info.join(nodes, "node", "left"), result


def _rows(docs: DataFrame) -> DataFrame:
    """``doc_id, text, node``: a null text is empty, and a node is a text's hash, so copies are one node."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("node"))


def _copy(least: int):
    """Whether a row's whole text stands under a smaller id."""
    return (F.col("n_words") >= least) & F.col("least").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("least"))


def report(docs: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """A row for each row of ``docs``: what repeats across documents and what is removed from it.

    ``n_repeats``: its passages of ``least_words`` words or more that also stand in other documents;
    ``removed_words`` and ``n_removed``: words and passages that go, because an earlier document
    keeps them; ``kept_by``: the ids of those documents; ``component_id``: the smallest id among the
    documents linked by such passages. A whole copy of a text of ``least_words`` words or more goes
    whole; rows that share id and text are one document. Shorter texts and passages are left alone,
    as are null and empty ones and repeats within one document. Null ids come last: a document with
    an id keeps a passage before them. Of equal ids with unlike texts the smaller hash of the text
    comes first. Texts of any length are taken whole. Other columns are ignored; an empty table
    gives an empty result.
    """
    info, result = repeated_runs(_rows(docs), percent, least_words)
    edges = result.select(F.col("node").alias("u"), F.explode("by_nodes").alias("v"))
    classes = connected_components(edges)
    ids = info.select("node", "least").distinct()
    least = classes.join(ids, "node").groupBy("label").agg(F.min("least").alias("class"))
    classes = classes.join(materialize(least, "class-ids"), "label").select("node", "class")
    known = materialize(result.drop("by_nodes").join(classes, "node", "left"), "known")
    out = info.join(known, "node", "left").withColumn("copy", _copy(least_words))
    size = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"])
    none = F.array().cast("array<long>")
    own = F.when(F.col("n_words") >= least_words, F.col("least")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", "n_words",
        (F.coalesce(F.size("runs"), F.lit(0)) + F.coalesce("held", F.lit(0)) + F.col("copy").cast("int")).cast("long").alias("n_repeats"),
        F.when(F.col("copy"), F.lit(1)).otherwise(F.coalesce(F.size("runs"), F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce(size, F.lit(0))).cast("long").alias("removed_words"),
        F.when(F.col("copy"), F.array("least")).otherwise(F.coalesce("by", none)).alias("kept_by"),
        F.least("class", own, "doc_id").alias("component_id"),
    )


def cut_words(chunk: K.Chunk, i: int, runs: list[tuple[int, int]], words) -> str:
    """The text of row i without runs of its words and the white space after them."""
    start, _, first = words
    raw, at, out = chunk.raw, int(chunk.row[i]), []
    for a, b in runs:
        begin = int(start[first[i] + a])
        stop = int(start[first[i] + b]) if first[i] + b < first[i + 1] else int(chunk.row[i + 1])
        out.append(raw[at:begin].tobytes())
        at = stop
    out.append(raw[at : chunk.row[i + 1]].tobytes())
    return b"".join(out).decode("utf-8", "replace").rstrip() if runs else chunk.text(i)


def remove_repeats(docs: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without the passages that an earlier document keeps; documents left without a word go.

    All columns stay, whatever their names; ``n_chars``, where there is one, is counted anew for
    texts that changed. Nulls, ties, repeated rows and long texts are taken as by ``report``.
    """
    info, result = repeated_runs(_rows(docs), percent, least_words)
    changes = info.join(result.select("node", "runs"), "node", "left").withColumn("copy", _copy(least_words)).where("copy OR size(runs) > 0")
    changes = materialize(changes.select("doc_id", "node", F.when(~F.col("copy"), F.col("runs")).alias("runs"), "copy").dropDuplicates(["doc_id", "node"]), "changes")
    names, has_chars = docs.columns, "n_chars" in docs.columns
    # positions instead of names, so that no column of the caller's can clash
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    of = {n: f"c{k}" for k, n in enumerate(names)}
    changes = changes.toDF("x_id", "x_node", "x_runs", "x_copy").hint("merge")
    same = F.col(of["doc_id"]).cast("long").eqNullSafe(F.col("x_id")) & (F.xxhash64(F.coalesce(F.col(of["text"]), F.lit(""))) == F.col("x_node"))
    joined = plain.join(changes, same, "left").drop("x_id", "x_node")

    def cut(batches):
        for batch in batches:
            text, change, copies = batch.column(of["text"]), batch.column("x_runs").to_pylist(), batch.column("x_copy").to_pylist()
            new, keep = text.to_pylist(), [True] * batch.num_rows
            if any(c is not None for c in copies):
                for chunk in K.chunks(text):
                    words = chunk.words()
                    for i in range(chunk.n):
                        k = chunk.first + i
                        if copies[k]:
                            keep[k] = False
                        elif copies[k] is not None:
                            new[k] = cut_words(chunk, i, [(r["a"], r["b"]) for r in change[k]], words)
                            keep[k] = bool(new[k].strip())
            columns = [batch.column(k) for k in range(len(names))]
            if has_chars:
                at = names.index("n_chars")
                old, was = columns[at].to_pylist(), text.to_pylist()
                columns[at] = pa.array([len(b or "") if a != b else o for a, b, o in zip(was, new, old, strict=True)], columns[at].type)
            columns[names.index("text")] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return joined.mapInArrow(K.tidy(cut), docs.schema)
