"""Source divergence: how far the words of each source of a language are from those of its other sources and of the whole.

Tasks count the terms of their documents by language and source; the counts are summed up, and a language keeps the terms
that enough of its documents have. Kept terms are dealt into blocks; each block of a language is a dense tile of integers,
groups by terms, in which all pairs of groups are compared by broadcasting. The tiles' pair matrices are summed up, and
their lists of each group's most divergent terms are merged. A language of many sources is cut into blocks of groups as
well, so that a tile holds at most about 2 * GROUPS by TERMS numbers whatever the input.

All arithmetic is in integers: of counts c in a total of N over V kept terms, p = 1 + floor(SCALE * (c + 1) / (N + V)),
and the divergence of p from q is floor((p - q)^2 / q). Null texts, languages and sources are empty ones; a group without
kept terms takes part with counts of 0, one of a language that keeps none is at distance 0. Totals are below 9 * 10^15.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemill.plans.lineage import drop_written, sized_join, written

#: Letters of terms: those of ASCII, lower-cased, and all bytes of other characters.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_BREAK = re.compile(rb"[^a-z\x80-\xff]")
SCALE = 1_000_000_000
LEAST, TOP = 3, 200
#: Terms and groups of a tile, on average; entries that a task gathers before it hands them on; bytes looked at at once;
#: numbers of a comparison in memory.
TERMS, GROUPS = 1024, 256
GATHERED, PIECE, CELLS = 400_000, 1 << 20, 1 << 20


def _pieces(data: bytes) -> Iterator[bytes]:
    """data in pieces of about PIECE bytes that cut no term."""
    at = 0
    while at < len(data):
        end = _BREAK.search(data, min(at + PIECE, len(data)))
        end = end.start() if end else len(data)
        yield data[at:end]
        at = end + 1 if end < len(data) else end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n (occurrences), docs (documents with it), of the documents of a task."""
    names = ["lang", "source", "term", "n", "docs"]

    def out() -> pa.RecordBatch:
        rows = [(*g, t.decode(), n, have[g][t]) for g, c in seen.items() for t, n in c.items()]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string()] * 3 + [pa.int64()] * 2, strict=True)], names)

    seen, have, held = defaultdict(Counter), defaultdict(Counter), 0
    for b in batches:
        for text, *group in zip(*(b.column(c).to_pylist() for c in ("text", "lang", "source")), strict=True):
            g, mine = tuple(group), set()
            known = len(seen[g])
            for piece in _pieces(text.encode().lower()):
                words = _TERM.findall(piece)
                seen[g].update(words)
                mine.update(words)
            have[g].update(mine)
            held += len(seen[g]) - known
            if held >= GATHERED:
                yield out()
                seen, have, held = defaultdict(Counter), defaultdict(Counter), 0
    yield out()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs."""
    texts = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    parts = texts.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def rates(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + 1) / totals), by long division in steps of 1000, so that nothing overflows."""
    rest, out = counts + 1, np.zeros(np.broadcast_shapes(counts.shape, totals.shape), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // totals
        rest = rest % totals
    return out + 1


def matrix(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The divergence of each row of p from each row of q, summed up over their terms."""
    out = np.zeros((len(p), len(q)), np.int64)
    step = max(1, CELLS // max(1, q.size))
    for i in range(0, len(p), step):
        gap = p[i : i + step, None, :] - q[None, :, :]
        out[i : i + step] = (gap * gap // q[None, :, :]).sum(axis=2)
    return out


def _tile(top: int):
    """A block of a language's terms, and two blocks of its groups: rows of pairs and of terms."""

    def tile(key, entries: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        lang, _, x, y = key
        groups = groups.sort_values("source").reset_index(drop=True)
        names, block = groups["source"].to_numpy(object), groups["block"].to_numpy()
        columns, terms = pd.factorize(entries["term"])
        row = pd.Series(np.arange(len(names)), index=names)
        counts = np.zeros((len(names), len(terms)), np.int64)
        if len(entries):
            counts[row[entries["source"]].to_numpy(), columns] = entries["n"].to_numpy()
        size, kept = groups["size"].to_numpy(np.int64), groups["kept"].to_numpy(np.int64)
        p = rates(counts, (size + kept)[:, None]) if len(terms) else counts
        a, b = np.flatnonzero(block == x), np.flatnonzero(block == y)
        out = []
        for one, two in [(a, b)] if x == y else [(a, b), (b, a)]:
            values = matrix(p[one], p[two])
            out += [(lang, names[i], "pair", names[j], int(values[m, n])) for m, i in enumerate(one) for n, j in enumerate(two) if i != j]
        if x == y and len(terms):
            total = np.zeros(len(terms), np.int64)
            total[columns] = entries["total"].to_numpy()
            q = rates(total, np.array([groups["lang_size"].iloc[0] + kept[0]], np.int64))
            for i, name in enumerate(names):
                over = np.flatnonzero((counts[i] > 0) & (p[i] > q))
                f = (p[i, over] - q[over]) ** 2 // q[over]
                best = heapq.nsmallest(top, ((-int(v), terms[t].encode(), terms[t]) for v, t in zip(f, over, strict=True)))
                out += [(lang, name, "term", t, -v) for v, _, t in best]
        return pd.DataFrame(out, columns=["lang", "source", "part", "item", "value"])

    return tile


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: of each group (lang, source) all other sources of its language (part pair),
    and its `top` terms that are more frequent in it than in its language (part term), the most divergent first, ties by
    item. Terms are kept that at least `least` documents of the language have."""
    counts = written(term_counts(docs), "counts")
    kept = written(counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs"), "kept")
    entries = written(sized_join(counts.drop("docs"), kept, ["lang", "term"]), "entries")
    drop_written(counts)
    own = entries.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct().join(own, ["lang", "source"], "left")
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("groups")).join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_size")), "lang", "left").na.fill(0)
    cut = lambda n, most: F.greatest(F.lit(1), F.ceil(F.col(n) / most)).cast("int")
    langs = written(langs.withColumns({"tiles": cut("kept", TERMS), "blocks": cut("groups", GROUPS)}), "langs")
    groups = sized_join(groups.na.fill(0, ["size"]), langs, "lang").withColumn("block", F.expr("cast(pmod(xxhash64(source), blocks) as int)"))
    mine = sized_join(entries, langs, "lang").withColumns({"block": F.expr("cast(pmod(xxhash64(source), blocks) as int)"), "tile": F.expr("cast(pmod(xxhash64(term), tiles) as int)")})

    def met(rows: DataFrame) -> DataFrame:
        """Rows for each other block of groups that theirs is compared with."""
        rows = rows.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return rows.withColumns({"x": F.least("block", "__other"), "y": F.greatest("block", "__other")})

    key = ["lang", "tile", "x", "y"]
    left = met(mine).select(*key, "source", "term", "n", "total")
    right = met(groups.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))).select(*key, "source", "block", "size", "kept", "lang_size")
    tiles = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_tile(top), "lang string, source string, part string, item string, value long")
    tiles = written(tiles, "tiles")
    for t in (kept, entries, langs):
        drop_written(t)
    pairs = tiles.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = tiles.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).union(terms)


ORACLE = r"""with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
w as (select r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term, count(*)::hugeint as total from w group by 1, 2 having count(distinct r) >= 3),
l as (select lang, count(*)::hugeint as v, sum(total) as n from k group by 1),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*)::hugeint as c from w join k using (lang, term) group by 1, 2, 3),
s as (select lang, source, sum(c) as n from c group by 1, 2),
p as (select g.lang, g.source, k.term, coalesce(c.c, 0) as c, (1 + (1000000000::hugeint * (coalesce(c.c, 0) + 1)) // (coalesce(s.n, 0) + l.v))::bigint as p, (1 + (1000000000::hugeint * (k.total + 1)) // (l.n + l.v))::bigint as q
  from g join k on k.lang = g.lang join l on l.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term left join s on s.lang = g.lang and s.source = g.source),
m as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
x as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(m.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join m on m.lang = a.lang and m.source = a.source and m.item = b.source
  union all select lang, source, 'term', term, (p - q) * (p - q) // q from p where c > 0 and p > q),
y as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::integer as rank from x)
select lang, source, part, item, value, rank from y where part = 'pair' or rank <= 200"""
