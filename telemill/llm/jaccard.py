"""N-gram Jaccard self-join by universe partition and the pigeonhole principle.

Documents are sets of word shingles; two link when intersection / union is at least PERCENT / 100. Sets are sorted into
bands by size, so that linked ones share a band: a set is in the band of its size and in the next lower one, as the
larger partner. In each band the universe of shingles is dealt to m segments by hash, m exceeding the most elements in
which linked sets of the band can differ (their distance). By the pigeonhole principle linked sets agree in at least one
whole segment. Segments that aren't empty are ordered, those with most elements first; linked sets have the first ones in
which they agree among the first of either, one more than their distance, and as many more as may be skipped. The index
holds the hash of each set's content in these (its leading segments).

Which segments serve is allocated by cost:
1. Every segment hash held by several sets is a bucket. All its members are compared with one of them (star pairs);
   what links becomes one class, and buckets within one class are done.
   Stars round a few other members follow while they still join classes.
2. Buckets across classes of at most LIGHT sets are compared in full. Larger ones are skipped: a set may skip any of its
   leading segments as long as more of them remain than its distance bound.
3. Of sets that skip more, a row a shingle: those stay that have enough shingles in common with other classes' sets, as
   links need. These are indexed again, with all one-deletion neighbourhoods of their segments: then a segment that
   serves is worth two (linked sets agree in it but for one element) unless a neighbourhood's bucket is large too.
4. Sets for which that is not enough either (nearly all their content is common, but links are missing) are indexed
   by their rarest shingles, as many as a linked partner cannot lack all of. Sets of one size with a shingle at one place
   are as one until it is known which sizes and places leave room for a link; only those are compared, across classes.
Candidate pairs that sizes or counts in CELLS cells (a lower bound of the distance) don't rule out are verified on the
words themselves. No bucket is cut short, so no link between different classes
is lost; links inside a class add nothing to the result and are not looked for.

Edge cases: sets that are equal are one (their copies are joined by fingerprint, before all else); null and empty texts
have no shingles and link with nothing; texts under WORDS words are one shingle, the whole; rows that share a doc_id are
one document, linked if any of its texts is; rows without doc_id get their count, but no links and a null component_id;
an empty table gives an empty result; texts of any length are read whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemill.operators.components import connected_components, merged
from telemill.plans.lineage import drop_written, release, sized_join, written

WORDS, PERCENT = 5, 75
LIGHT = 4
#: Times that other centres are tried at most.
TURNS = 6
#: Instead of a segment's hash, SPARSE + k says that a set has k more leading segments than it can differ in (0: none more,
#: MARKS: so many or more).
SPARSE, MARKS = -(1 << 63), 1000
#: Cells in which a set's elements are counted, to rule pairs out.
CELLS = 256
#: Bands reach from a size to its largest partner's, that one's largest partner's and so on, so many times: a set is in two
#: bands only if it is within the first step.
STEPS = 3
#: Leading segments that may be skipped, in percent of a band's largest distance.
SPARE = 12
#: Counts of elements beyond this are as one in the order of segments.
TOP = 15
#: Bytes of text, and texts, hashed at a time.
AT_ONCE, TEXTS = 1 << 17, 2000
U = np.uint64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], U)
_BASE = 0x9FB21C651E98DF25
_BYTES = np.random.default_rng(2024).integers(0, 1 << 64, 256, dtype=U)
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def mix(x: np.ndarray, salt: int | np.ndarray = 0) -> np.ndarray:
    """Scrambled 64-bit numbers."""
    x = x ^ U(salt)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(29)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(32)
    return x


def word_list(text: str | None) -> list[bytes]:
    """Words between the six white-space characters, A-Z in lower case."""
    return (text or "").encode().lower().split()


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses."""
    every = lambda x: np.concatenate([[U(1)], np.cumprod(np.full(n, x, U))])
    return every(_BASE), every(pow(_BASE, -1, 1 << 64))


def _hashed(data: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of some texts in lower case, one after the other, and their sizes: words are hashed by prefix sums over all
    bytes at once."""
    flat = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    powers, inverses = _powers(max(AT_ONCE, 1 << int(len(flat)).bit_length()))
    space = _SPACE[flat]
    before = np.concatenate([[True], space[:-1]])
    start, end = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    sums = np.concatenate([[U(0)], np.cumsum(_BYTES[flat] * powers[: len(flat)], dtype=U)])
    h = mix((sums[end] - sums[start]) * inverses[start] + (end - start).astype(U))
    cuts = np.searchsorted(start, np.cumsum([0] + [len(x) + 1 for x in data]))
    odd = np.resize(_ODD, n) + (U(2) * (np.arange(n, dtype=U) // U(len(_ODD))))
    grams = h[: max(0, len(h) - n + 1)] * odd[0]
    for i in range(1, n):
        grams += h[i : len(grams) + i] * odd[i]
    grams = mix(grams)
    words = np.diff(cuts)
    for a, b in zip(cuts[:-1][words >= n].tolist(), (cuts[1:][words >= n] - n + 1).tolist(), strict=True):
        grams[a:b].sort()
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    new[cuts[:-1][words >= n]] = True
    for i in range(1, n):  # not across texts
        at = cuts[1:][words >= i] - i
        new[at[at < len(new)]] = False
    upto = np.concatenate([[0], np.cumsum(new)])[np.minimum(cuts, len(new))]
    sets, size = grams[new], np.diff(upto)
    few = np.flatnonzero((words > 0) & (words < n))
    if len(few):
        whole = [mix((h[cuts[i] : cuts[i + 1]] * (U(2) * np.arange(words[i], dtype=U) + U(3))).sum(dtype=U, keepdims=True), int(words[i]) + 1)[0] for i in few.tolist()]
        sets = np.insert(sets, upto[few], whole)
        size[few] = 1
    return sets, size


def shingles(texts: pa.Array, n: int = WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct shingles of texts as 64-bit hashes, sorted within each text, and their number by text; some texts at a
    time."""
    held, size = [], 0
    for x in texts.cast(pa.large_binary()):
        held.append((x.as_py() or b"").lower())
        size += len(held[-1]) + 1
        if size >= AT_ONCE or len(held) >= TEXTS:
            yield _hashed(held, n)
            held, size = [], 0
    if held:
        yield _hashed(held, n)


def shingle_sets(texts: pa.Array, n: int = WORDS) -> Iterator[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes."""
    for sets, size in shingles(texts, n):
        yield from np.split(sets, np.cumsum(size)[:-1])


def exact(text: str | None, n: int = WORDS) -> set:
    """The distinct shingles themselves."""
    w = word_list(text)
    return set(zip(*[w[i:] for i in range(n)], strict=False)) if len(w) >= n else ({tuple(w)} if w else set())


def linked(a: set, b: set, percent: int = PERCENT) -> bool:
    if not a or not b or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


class Bands:
    """Sizes by band, segments and distance bounds."""

    def __init__(self, percent: int = PERCENT):
        self.percent, self.edges = percent, [1]

    def most(self, n: int) -> int:
        """The largest partner of a set of n."""
        return 100 * n // self.percent

    def distance(self, a: int, b: int) -> int:
        """The most elements in which linked sets of a and b differ."""
        return a + b - 2 * -(-self.percent * (a + b) // (100 + self.percent))

    def of(self, n: int) -> int:
        while self.edges[-1] <= n:
            last = self.edges[-1]
            for _ in range(STEPS):
                last = self.most(last)
            self.edges.append(last + 1)
        return int(np.searchsorted(self.edges, n, "right")) - 1

    @lru_cache(4096)  # noqa: B019
    def segments(self, band: int) -> int:
        self.of(self.edges[-1])
        while len(self.edges) < band + 2:
            self.of(self.edges[-1])
        return -(-115 * (self.largest(band) + 1) // 100) + 1

    def largest(self, band: int) -> int:
        """The largest distance of a band."""
        a = self.edges[band + 1] - 1
        return self.distance(a, self.most(a))

    def leading(self, band: int, bound: int) -> int:
        """How many segments of a set with this distance bound are indexed at most. What it has beyond its bound is the same
        for all sets of a band: then what one of two linked sets doesn't skip the other has indexed."""
        self.segments(band)
        return bound + 1 + -(-SPARE * (self.largest(band) + 1) // 100)

    @lru_cache(1 << 16)  # noqa: B019
    def roles(self, n: int) -> list[tuple[int, int, int]]:
        """(band, segments, distance bound) for a set of n."""
        own = self.of(n)
        out = [(own, self.segments(own), max(self.distance(n, b) for b in range(self.most(n), max(n, self.most(n) - 2) - 1, -1)))]
        if own and self.most(self.edges[own] - 1) >= n:
            a = self.edges[own] - 1
            out.append((own - 1, self.segments(own - 1), max(self.distance(x, n) for x in range(max(1, a - 2), a + 1))))
        return out


def dealt(s: np.ndarray, band: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments that hold elements, the hash of each one's content, all elements' segments and weights."""
    where = ((mix(s, 7919 * band + 13) >> U(32)) * U(m)) >> U(32)
    order = np.argsort(where.astype(np.uint16) if m < 1 << 16 else where, kind="stable")
    where, weight = where[order], mix(s, 0x5851F42D4C957F2D)[order]
    first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    return where[first], np.add.reduceat(weight, first), where, weight


def signature(segment: np.ndarray, content: np.ndarray, band: int | np.ndarray) -> np.ndarray:
    return np.maximum(mix(content + segment.astype(U) * U(0x9E3779B97F4A7C15), 104729 * band + 1).view(np.int64), SPARSE + MARKS + 1)


def first(sizes: np.ndarray, k: int) -> np.ndarray:
    """Places of the k leading ones of segments in their order: those with most elements, then the first ones."""
    return np.argsort(np.maximum(TOP - sizes, 0).astype(np.uint16), kind="stable")[:k]


def leading(sets: np.ndarray, size: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the leading segments (as first() has them) of some sets in all their bands, and a mark for each band
    (see SPARSE), with the set's number."""
    roles = [(i, *x) for i, n in enumerate(size.tolist()) if n for x in bands.roles(n)]
    if not roles:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whose, band, m, bound = (np.array(x, np.int64) for x in zip(*roles, strict=True))
    most = np.array([bands.leading(b, d) for _, b, _, d in roles])
    n, role = size[whose], np.arange(len(roles))
    element = np.arange(n.sum()) + np.repeat((np.cumsum(size) - size)[whose] - (np.cumsum(n) - n), n)
    where = mix(sets[element], np.repeat((7919 * band + 13).astype(U), n)) >> U(32)
    base = np.cumsum(m) - m
    cell = ((where * np.repeat(m.astype(U), n)) >> U(32)).astype(np.int64) + np.repeat(base, n)
    counts, content = np.bincount(cell, minlength=int(m.sum())), np.zeros(int(m.sum()), U)
    np.add.at(content, cell, mix(sets, 0x5851F42D4C957F2D)[element])
    full = np.flatnonzero(counts)
    own = np.repeat(role, m)[full]
    held = np.bincount(own, minlength=len(roles))
    # at most two bands a set, TEXTS sets: (role, TOP - count) in 16 bits
    order = np.argsort(((TOP + 1) * own + np.maximum(TOP - counts[full], 0)).astype(np.uint16), kind="stable")
    order = order[np.arange(len(order)) - np.repeat(np.cumsum(held) - held, held) < most[own]]
    full, own = full[order], own[order]
    marks = SPARSE + np.clip(np.minimum(held, most) - bound, 0, MARKS)
    return np.concatenate([signature(full - base[own], content[full], band[own]), marks]), np.concatenate([whose[own], whose])


def _table(columns: dict, types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, types[k]) for k, v in columns.items()], list(columns))


def fingerprints(docs: DataFrame, n: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint and the counts in CELLS of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, one, two, cells = [], [], [], []
            for sets, k in shingles(b.column(1), n):
                cell = np.repeat(np.arange(len(k)) * CELLS, k) + (mix(sets, 3) >> U(56)).astype(np.int64)
                cells += np.split(np.minimum(np.bincount(cell, minlength=len(k) * CELLS), 255).astype(np.uint8), len(k))
                ends = np.cumsum(k)
                for salt, out in ((1, one), (2, two)):
                    sums = np.concatenate([[U(0)], np.cumsum(mix(sets, salt), dtype=U)])
                    out.append((sums[ends] - sums[ends - k]).view(np.int64))
                size.append(k)
            if size:
                numbers = [pa.array(np.concatenate(c), pa.int64()) for c in (size, one, two)]
                yield pa.RecordBatch.from_arrays([b.column(0), *numbers, pa.array([c.tobytes() for c in cells], pa.binary())], ["doc_id", "n_shingles", "__one", "__two", "__cells"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, n_shingles long, __one long, __two long, __cells binary")


def index(docs: DataFrame, bands: Bands, n: int = WORDS) -> DataFrame:
    """sig, doc: the content hash of every leading segment of docs (doc, text), and a mark (see SPARSE) for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, at, sigs, ids, held = b.column(0).to_numpy(), 0, [], [], 0
            for sets, size in shingles(b.column(1), n):
                sig, whose = leading(sets, size, bands)
                sigs.append(sig)
                ids.append(doc[at + whose])
                at += len(size)
                held += len(sig)
                if held > 300_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(ids))], ["sig", "doc"])
                    sigs, ids, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(ids))], ["sig", "doc"])

    return docs.select("doc", "text").mapInArrow(run, "sig long, doc long")


def buckets(rows: DataFrame) -> DataFrame:
    """sig, doc, centre: the rows of hashes that several documents have, with one of these documents, and all marks.
    Rows of one hash pass by one after the other and are never held together; they are sorted by hash alone, which Spark
    does digit by digit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, int, bool] | None = None  # hash, document, centre, whether given out
        for b in batches:
            sig, doc = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(sig):
                continue
            if last:
                sig, doc = np.concatenate([[last[0]], sig]), np.concatenate([[last[1]], doc])
            start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            size = np.diff(np.concatenate([start, [len(sig)]]))
            centre, known = np.minimum.reduceat(doc, start), size > 1
            if last:
                centre[0] = last[2]
                known[0] |= last[3]
            shared = np.repeat(known, size) | (sig <= SPARSE + MARKS)
            out = shared.copy()
            if last and last[3]:
                out[0] = False
            last = (int(sig[-1]), int(doc[-1]), int(centre[-1]), bool(shared[-1]))
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(sig[out]), pa.array(doc[out]), pa.array(np.repeat(centre, size)[out])], ["sig", "doc", "centre"])

    return rows.repartition("sig").sortWithinPartitions("sig").mapInArrow(run, "sig long, doc long, centre long")


def possible(pairs: DataFrame, cells: DataFrame, bands: Bands) -> DataFrame:
    """Those pairs (a, b) that sizes and cells don't rule out: sets differ at least as much as their counts in cells.
    cells: doc, n, cells."""
    one = cells.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("cells").alias("cb"))
    two = cells.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("cells").alias("ca"))
    both = pairs.join(one, "b").join(two, "a").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * bands.percent).select("a", "b", "na", "nb", "ca", "cb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                total = b.column(2).to_numpy() + b.column(3).to_numpy()
                most = total - 2 * -(-bands.percent * total // (100 + bands.percent))
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16) for i in (4, 5))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(np.abs(x - y).sum(1) <= most))

    return both.mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """a, b of those pairs whose documents (doc, text) link."""
    ids = written(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), "ids")
    some = sized_join(texts, ids, "doc", "left_semi")
    right = pairs.join(some.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b")
    both = right.join(some.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kept = None, set()
        for b in batches:
            out = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x = x.as_py()
                if x != own:
                    own, kept = x, exact(x, n)
                out.append(linked(kept, exact(y.as_py(), n), percent))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(out, pa.bool_()))

    return written(both.mapInArrow(run, "a long, b long").distinct(), "links")


def _classes(rows: DataFrame, comps: DataFrame, size: int) -> DataFrame:
    """rows (sig, doc, ...) of buckets across classes, with their class and the bucket's size."""
    own = sized_join(rows, comps, "doc", "left", size).withColumn("c", F.coalesce("c", "doc"))
    wide = own.groupBy("sig").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("size")).where("c0 < c1").select("sig", "size")
    return own.join(wide, "sig")


def _across(rows: DataFrame) -> DataFrame:
    """a, b: all pairs of a bucket's rows (sig, doc, c) whose classes differ."""
    a = rows.select("sig", F.col("doc").alias("a"), F.col("c").alias("ca"))
    b = rows.select("sig", F.col("doc").alias("b"), F.col("c").alias("cb"))
    return a.join(b, "sig").where("a < b and ca <> cb").select("a", "b").distinct()


def places(rows: DataFrame, percent: int) -> DataFrame:
    """sig, na, ata, nb, atb: pairs of a size and a place of prefixes() with a shingle in common and enough room behind it:
    what linked sets share is no more than the first shingle in common and those that are less rare. However many sets
    have a shingle, this compares no more than their sizes and places."""
    held = rows.groupBy("sig", "size", "at").agg(F.min("c").alias("c0"), F.max("c").alias("c1"))
    a, b = (held.select("sig", F.col("size").alias(f"n{x}"), F.col("at").alias(f"at{x}"), F.col("c0").alias(f"low{x}"), F.col("c1").alias(f"high{x}")) for x in "ab")
    once = F.expr("(na < nb or na = nb and ata <= atb) and least(lowa, lowb) < greatest(higha, highb)")
    room = F.expr(f"(1 + least(na - ata, nb - atb)) * {100 + percent} >= {percent} * (na + nb)")
    return a.join(b, "sig").where(once & F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)") & room).select("sig", "na", "ata", "nb", "atb")


def _meeting(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of prefixes() across classes that have a shingle in common at places()."""
    a, b = (rows.select("sig", F.col("doc").alias(x), F.col("c").alias(f"c{x}"), F.col("at").alias(f"at{x}"), F.col("size").alias(f"n{x}")) for x in "ab")
    both = places(rows, percent).join(a, ["sig", "na", "ata"]).join(b, ["sig", "nb", "atb"]).where("ca <> cb")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _other_stars(wide: DataFrame, turn: int) -> DataFrame:
    """a, b: of rows (sig, doc, c), each document with the members that two of its buckets draw by hash."""
    centre = wide.groupBy("sig").agg(F.min_by(F.struct("doc", "c"), F.xxhash64("doc", F.lit(turn))).alias("m"))
    j = wide.join(centre, "sig").where("c <> m.c")
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(F.xxhash64("sig", F.lit(turn))))
    return j.withColumn("r", rank).where("r <= 2").select(F.least("doc", "m.doc").alias("a"), F.greatest("doc", "m.doc").alias("b")).distinct()


def _short(s: np.ndarray, skipped: list | None, bands: Bands) -> Iterator[tuple]:
    """Bands in which a set skips too much: band, segments, distance bound, what dealt() gives and signatures."""
    large = np.array(skipped or [], np.int64)
    for band, m, bound in bands.roles(len(s)) if len(s) else ():
        parts = dealt(s, band, m)
        full = signature(parts[0], parts[1], band)
        indexed = full[first(np.bincount(parts[2].astype(np.int64), minlength=m)[parts[0].astype(np.int64)], bands.leading(band, bound))]
        if (~np.isin(indexed, large)).sum() <= bound:
            yield band, m, bound, parts, full


def _own(s: np.ndarray) -> int:
    """A number that tells a document's sets apart."""
    return int(mix(s, 1).sum(dtype=U).view(np.int64))


def elements(docs: DataFrame, bands: Bands, n: int = WORDS) -> DataFrame:
    """sig, doc, own, c, size: every shingle of those sets of docs (doc, c, text, skipped: hashes of large buckets) that skip
    too much in a band. A document with several texts has several sets (own); equal ones count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, sets, held = [], [], 0
            for i, (s, skipped) in enumerate(zip(shingle_sets(b.column(2), n), b.column(3).to_pylist(), strict=True)):
                if next(_short(s, skipped, bands), None):
                    at.append(i)
                    sets.append(s)
                    held += len(s)
                if at and (held > 300_000 or i + 1 == b.num_rows):
                    size = np.array([len(x) for x in sets])
                    rows = pa.array(np.repeat(at, size))
                    own = np.repeat(np.array([_own(x) for x in sets], np.int64), size)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), b.column(0).take(rows), pa.array(own), b.column(1).take(rows), pa.array(np.repeat(size, size))], ["sig", "doc", "own", "c", "size"])
                    at, sets, held = [], [], 0

    return docs.select("doc", "c", "text", "skipped").mapInArrow(run, "sig long, doc long, own long, c long, size long").distinct()


def mostly_shared(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of elements() the rows of sets that share as many shingles with other classes as a link to one of these takes:
    PERCENT / 100 of either set. Each shingle meets one row, so that no row becomes several."""
    across = rows.groupBy("sig").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("sig")
    enough = rows.join(across, "sig").groupBy("doc", "own", "size").agg(F.count(F.lit(1)).alias("k")).where(f"100 * k >= {percent} * size")
    return rows.join(enough.select("doc", "own"), ["doc", "own"], "left_semi")


def neighbourhoods(docs: DataFrame, bands: Bands, n: int = WORDS) -> DataFrame:
    """docs: doc, text, skipped (hashes of large buckets). Of the (set, band) that skip too much: sig, doc, own, c, band,
    need (distance bound + 1), segment, full (content, or content but for one element), lone (the segment's only element) and
    total, what all segments of this set and band are worth."""
    types = {"sig": pa.int64(), "doc": pa.int64(), "own": pa.int64(), "c": pa.int64(), "band": pa.int32(), "need": pa.int32(), "segment": pa.int64(), "full": pa.bool_(), "lone": pa.bool_(), "total": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in types}
            for doc, c, s, skipped in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), shingle_sets(b.column(2), n), b.column(3).to_pylist(), strict=True):
                own = _own(s)
                for band, m, bound, (segment, content, where, weight), full in _short(s, skipped, bands):
                    counts = np.bincount(where.astype(np.int64), minlength=m)
                    total = np.zeros(m, U)
                    total[segment.astype(np.int64)] = content
                    worth = int(np.minimum(counts, 2).sum())
                    at = np.flatnonzero(counts[where.astype(np.int64)] > 1)
                    less = signature(where[at], total[where[at].astype(np.int64)] - weight[at], band)
                    for sig, seg, whole in ((full, segment, True), (less, where[at], False)):
                        out["sig"].append(sig)
                        out["segment"].append(seg.astype(np.int64))
                        out["full"].append(np.full(len(sig), whole))
                        out["lone"].append(counts[seg.astype(np.int64)] == 1)
                        for k, v in (("doc", doc), ("own", own), ("c", c), ("band", band), ("need", bound + 1), ("total", worth)):
                            out[k].append(np.full(len(sig), v, np.int64))
            if out["sig"]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)).cast(types[k]) for k, v in out.items()], list(types))

    return docs.select("doc", "c", "text", "skipped").mapInArrow(run, "sig long, doc long, own long, c long, band int, need int, segment long, full boolean, lone boolean, total int")


def shared_neighbourhoods(short: DataFrame, light: int = LIGHT) -> DataFrame:
    """Of neighbourhoods() those rows whose hash another class has as well, with heavy: whether more than `light` documents
    have it. Each hash meets its one count, so that no row becomes several, and rows of one document alone become none."""
    sized = short.groupBy("sig").agg(F.count_distinct("doc").alias("size"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.max("full").alias("f")).where("size > 1 and c0 < c1 and f")
    return short.join(sized.select("sig", (F.col("size") > light).alias("heavy")), "sig")


def unserved(short: DataFrame, near: DataFrame) -> DataFrame:
    """doc, own: sets of neighbourhoods() with a band whose segments are worth less than it needs. near: of
    shared_neighbourhoods(); a segment with a heavy hash is worth nothing if that is its content's, and else one."""
    lost = near.where("heavy").groupBy("doc", "own", "band", "need", "total", "segment").agg(F.max("full").alias("full"), F.max("lone").alias("lone"))
    lost = lost.groupBy("doc", "own", "band", "need", "total").agg(F.sum(F.when(F.col("full") & ~F.col("lone"), 2).otherwise(1)).alias("lost"))
    return short.where("total < need").select("doc", "own").union(lost.where("total - lost < need").select("doc", "own")).distinct()


def prefixes(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of elements() the rarest of each set, so many that linked sets share one of them, with at, their place by rarity."""
    often = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    ranked = rows.join(often, "sig").withColumn("at", F.row_number().over(Window.partitionBy("doc", "own").orderBy("n", "sig")))
    return ranked.where(F.expr(f"at <= size - (({percent} * size + 99) div 100) + 1")).select("sig", "doc", "c", "at", "size")


def components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text", light: int = LIGHT) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) of every row of docs."""
    spark = docs.sparkSession
    bands = Bands(percent)
    sets = written(fingerprints(docs, n, key, text), "sets")
    whole = sets.where("n_shingles > 0 and doc_id is not null")
    groups = whole.groupBy("n_shingles", "__one", "__two").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    copies = sized_join(whole, groups, ["n_shingles", "__one", "__two"]).where("doc_id > first").select(F.col("doc_id").alias("doc"), "first").distinct()
    copies = written(copies, "copies")
    texts = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    ones = sized_join(texts, copies.select("doc").distinct(), "doc", "left_anti")

    all_shared = written(buckets(index(ones, bands, n)), "buckets")
    shared, marks = all_shared.where(F.col("sig") > SPARSE + MARKS), all_shared.where(F.col("sig") <= SPARSE + MARKS)
    release(spark)
    counts = whole.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), F.col("__cells").alias("cells"))

    def checked(pairs: DataFrame) -> DataFrame:
        pairs = written(possible(pairs, counts, bands), "pairs")
        release(spark)
        return pairs if pairs.isEmpty() else verified(pairs, ones, n, percent)

    links = checked(shared.where("doc <> centre").select(F.least("doc", "centre").alias("a"), F.greatest("doc", "centre").alias("b")).distinct())
    # a doc_id with several texts is in several groups of copies
    links = links.union(copies.select(F.col("first").alias("a"), F.col("doc").alias("b")).join(copies.groupBy("doc").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("doc").alias("b")), "b", "left_semi").select("a", "b"))

    def classes(before: DataFrame, k: int, links: DataFrame) -> tuple[DataFrame, int]:
        after = merged(before, links)
        if after is None:
            return before, k
        found = written(after, "classes")
        release(spark)
        return found, found.count()

    comps = written(connected_components(links).select(F.col("node").alias("doc"), F.col("component").alias("c")), "classes")
    k = comps.count()
    release(spark)
    wide = written(_classes(shared.select("sig", "doc"), comps, k), "wide")
    links = checked(_across(wide.where(F.col("size") <= light)))
    for turn in range(TURNS):  # other centres: this only makes classes grow before what follows, which is exact without
        found = checked(_other_stars(wide, turn))
        comps, k = classes(comps, k, found if turn else links.union(found))
        wide = written(_classes(wide.select("sig", "doc"), comps, k), "wide")
        if 50 * found.count() < wide.select("doc").distinct().count():
            break

    large = _classes(wide.where(F.col("size") > light).select("sig", "doc"), comps, k)
    skipped = large.groupBy("doc").agg(F.collect_set("sig").alias("skipped"))
    spare = marks.groupBy("doc").agg((F.min("sig") - F.lit(SPARSE)).alias("spare"))
    asked = spare.join(skipped, "doc", "left").where((F.col("spare") == 0) | (F.size("skipped") >= F.col("spare"))).drop("spare")
    asked = written(sized_join(asked, comps, "doc", "left", k).select("doc", F.coalesce("c", "doc").alias("c"), "skipped"), "asked")
    every = written(elements(sized_join(ones, asked.select("doc"), "doc", "left_semi").join(asked, "doc"), bands, n), "elements")
    drop_written(all_shared)
    left = written(mostly_shared(every, percent), "left")
    if not left.isEmpty():
        asked = asked.join(left.select("doc").distinct(), "doc", "left_semi")
        short = written(neighbourhoods(sized_join(ones, asked.select("doc"), "doc", "left_semi").join(asked, "doc"), bands, n), "neighbourhoods")
        near = written(shared_neighbourhoods(short, light), "near")
        cells = near.where("not heavy").select("sig", "doc", "c", "full").distinct()
        a = cells.where("full").select("sig", F.col("doc").alias("x"), F.col("c").alias("cx"))
        b = cells.select("sig", F.col("doc").alias("y"), F.col("c").alias("cy"))
        found = checked(a.join(b, "sig").where("x <> y and cx <> cy").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        comps, k = classes(comps, k, found)
        hard = written(unserved(short, near), "hard")
        if not hard.isEmpty():
            rest = sized_join(left.drop("c").join(hard, ["doc", "own"], "left_semi"), comps, "doc", "left", k).withColumn("c", F.coalesce("c", "doc"))
            rows = prefixes(rest, percent)
            open_ = rows.groupBy("sig").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("sig")
            rows = written(rows.join(open_, "sig"), "prefixes")
            comps, k = classes(comps, k, checked(_meeting(rows, percent)))

    firsts = copies.groupBy("doc").agg(F.min("first").alias("first"))
    out = sized_join(sets, firsts.withColumnRenamed("doc", "doc_id"), "doc_id", "left").withColumn("first", F.coalesce("first", "doc_id"))
    out = sized_join(out, comps.withColumnRenamed("doc", "first"), "first", "left", k)
    return out.select("doc_id", "n_shingles", F.coalesce("c", "first").alias("component_id"))


#: All pairs that share a shingle, and what links reach. A shingle's words hold no spaces.
ORACLE = rf"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as materialized (select doc_id, unnest(case when len(w) >= {WORDS} then list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w),
n as materialized (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= {PERCENT} * (x.n + y.n - k)),
e as materialized (select a, b from l union all select b, a from l),
c(id, component) using key (id) as (select doc_id, doc_id from documents union (select e.b, min(c.component) from c join e on e.a = c.id join recurring.c r on r.id = e.b where c.component < r.component group by 1))
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component as component_id from documents d left join n using (doc_id) join c on c.id = d.doc_id
"""
