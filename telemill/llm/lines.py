"""Line deduplication by a log-template tree.

Every line with a word is parsed as log messages are. Tokens with a digit are variable fields, written <*>; a tree of
fixed depth leads from the number of tokens over the first LEAD tokens to a leaf. In a leaf, lines are told apart on
LEVELS further levels: the lines of a group that agree with its most frequent tokens, place by place, in at least
SIMILAR percent of the places behind the leading ones are one template, whose other places are variable fields too; the
other lines go on in groups by the token that they share with most lines of the group without its being the most
frequent of its place. So each template is judged on its own lines, whatever else is in the leaf. Lines that share too
few tokens with others for any template, and all lines of under WIDE tokens, are a template by themselves (their digit
fields being variable). Short lines (under MIN_TOKENS tokens) and rows of numbers (under FIXED tokens without a digit)
are templates just as they stand, so that only exact recurrences of them count.

A template that recurs, that is, occurs in several documents, stays in the document with the least doc_id; its lines are
dropped from all others.

All of it is DataFrame functions. The text is read to give each line two hashes and again for what is written; only
hashes, and the tokens of one line for each of those in leaves whose lines differ, are shuffled, after partial
aggregation.

Edge cases: null texts stay null and empty ones empty; lines without a word are never dropped; rows that share a doc_id
are one document, so that repeated rows lose nothing to each other; rows without doc_id come last; an empty table gives
an empty result; lines and texts of any length are read whole; other columns are kept whatever their names, but n_lines
and n_dropped of the result take the place of columns of these names.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import SPACES
from telemill.plans.lineage import drop_written, sized_join, written

MIN_TOKENS, FIXED, LEAD, WIDE, SIMILAR, LEVELS = 5, 2, 4, 8, 60, 3
LAST = (1 << 63) - 1
_FIELD = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"


def row_key(key: str, text: str) -> Column:
    """Tells rows apart by content."""
    return F.xxhash64(key, text)


def _tokens(line: Column) -> Column:
    """The words of a line whose white space is spaces."""
    return F.array_remove(F.split(line, " "), "")


def parsed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """__key, __o (doc_id, last if null), __pos, __toks and __wide (whether it may be generalised) of every line with a word."""
    others = [c for c in SPACES if c not in " \n"]
    plain = F.when(reduce(or_, [F.contains(text, F.lit(c)) for c in others]), F.translate(text, "".join(others), " " * len(others))).otherwise(F.col(text))
    rows = docs.select(row_key(key, text).alias("__key"), F.coalesce(key, F.lit(LAST)).alias("__o"), F.posexplode(F.split(plain, "\n")).alias("__pos", "__line"))
    rows = rows.where(F.trim("__line") != "").withColumn("__digit", F.col("__line").rlike("[0-9]"))
    rows = rows.withColumn("__toks", _tokens(F.when(F.col("__digit"), F.regexp_replace("__line", _FIELD, "<*>")).otherwise(F.col("__line"))))
    own = (F.size("__toks") < MIN_TOKENS) | (F.col("__digit") & (F.size(F.array_remove("__toks", "<*>")) < FIXED))
    rows = rows.withColumn("__own", own)
    rows = rows.withColumns({"__toks": F.when(F.col("__own"), _tokens(F.col("__line"))).otherwise(F.col("__toks")), "__wide": ~F.col("__own") & (F.size("__toks") >= WIDE)})
    return rows.drop("__line", "__digit", "__own")


def hashes() -> dict[str, Column]:
    """The line's own template, and its leaf: of a line that can't be generalised, the same."""
    n, h = F.size("__toks"), F.xxhash64(F.size("__toks"), F.col("__toks"))
    return {"__h": h, "__leaf": F.when(F.col("__wide"), F.xxhash64(n, F.slice("__toks", 1, LEAD))).otherwise(h)}


def generalised(lines: DataFrame) -> DataFrame:
    """__h, __t: the template of those distinct lines (__leaf, __h, toks: behind the leading ones) that have one with
    others of their leaf. Places are joined by hashes of group, place and token, as these are the most rows."""
    found, now = None, lines.select(F.col("__leaf").alias("g"), "__h", "toks")
    for level in range(LEVELS):
        places = now.select("g", "__h", F.size("toks").alias("size"), F.posexplode("toks").alias("i", "tok"))
        counts = written(places.groupBy("g", "i", "tok").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
        most = counts.groupBy("g", "i").agg(F.max(F.struct("n", "tok")).alias("top")).select("g", "i", F.col("top.tok").alias("top"))
        place = F.xxhash64("g", "i", "tok").alias("place")
        shared = counts.join(most, ["g", "i"]).select(place, (F.shiftleft("n", 32) + F.col("i")).alias("rank"), (F.col("tok") == F.col("top")).alias("is_top"))
        judged = places.select(place, "g", "__h", "size").join(shared, "place").groupBy("g", "__h", "size").agg(
            F.count_if("is_top").alias("same"), F.count(F.lit(1)).alias("shared"), F.max(F.when(~F.col("is_top"), F.col("rank"))).alias("anchor")
        )
        judged = written(judged.where(100 * F.col("shared") >= SIMILAR * F.col("size")), "judged")
        drop_written(counts)
        fits = 100 * F.col("same") >= SIMILAR * F.col("size")
        one = judged.where(fits).select("__h", F.xxhash64("g", F.lit(level)).alias("__t"))
        found = one if found is None else found.union(one)
        rest = judged.where(~fits).select("__h", F.expr("cast(anchor & 4294967295 as int)").alias("i"))
        if level + 1 == LEVELS or rest.isEmpty():
            break
        now = written(now.join(rest, "__h").select(F.xxhash64("g", "i", F.get("toks", "i")).alias("g"), "__h", "toks"), "level")
    return found


def dropped(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """__key and __drop: the places (from 0) of the lines to drop, for each row that has any."""
    rows = written(parsed(docs, key, text).withColumns(hashes()).drop("__toks", "__wide"), "lines")
    leaves = rows.groupBy("__leaf").agg(F.min("__o").alias("o0"), F.max("__o").alias("o1"), F.min("__h").alias("h0"), F.max("__h").alias("h1"))
    leaves = written(leaves.where("o0 < o1").select("__leaf", (F.col("h0") < F.col("h1")).alias("mixed")), "leaves")
    every, rows = rows, written(sized_join(rows, leaves, "__leaf"), "candidates")
    drop_written(every)
    # one line for each hash in a leaf whose lines differ
    named = rows.where("mixed").groupBy("__leaf", "__h").agg(F.min(F.struct("__key", "__pos")).alias("at")).select("at.__key", "at.__pos", "__leaf", "__h")
    named = written(named, "named")
    some = sized_join(docs.select(key, text, row_key(key, text).alias("__key")), written(named.select("__key").distinct(), "keys"), "__key", "left_semi").drop("__key")
    lines = sized_join(parsed(some, key, text), named, ["__key", "__pos"]).dropDuplicates(["__key", "__pos"])
    lines = written(lines.select("__leaf", "__h", F.slice("__toks", LEAD + 1, F.size("__toks")).alias("toks")), "distinct-lines")
    general = written(generalised(lines), "general")
    rows = sized_join(rows, general, "__h", "left").withColumn("__t", F.coalesce("__t", "__h"))
    firsts = rows.groupBy("__t").agg(F.min("__o").alias("o0"), F.max("__o").alias("o1")).where("o0 < o1").select("__t", "o0")
    out = sized_join(rows, written(firsts, "templates"), "__t").where("__o > o0")
    return written(out.groupBy("__key").agg(F.collect_set("__pos").alias("__drop")), "dropped")


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the text that stays, n_lines and n_dropped."""
    own = F.col(f"__row.`{text}`")
    held = docs.select(row_key(key, text).alias("__key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    some = sized_join(held, dropped(docs.select(key, text), key, text), "__key", "left").withColumn("__lines", F.split(own, "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__drop")
    stays = F.array_join(F.transform(F.array_sort(kept), lambda i: F.get("__lines", i)), "\n")
    counts = {"n_lines": F.greatest(F.lit(0), F.coalesce(F.size("__lines"), F.lit(0))).cast("long"), "n_dropped": F.greatest(F.lit(0), F.coalesce(F.size("__drop"), F.lit(0))).cast("long")}
    after = {text: F.when(F.col("__drop").isNull(), own).otherwise(stays)} | counts
    columns = [c for c in docs.columns if c not in counts]
    return some.select(*[after.get(c, F.col(f"__row.`{c}`")).alias(c) for c in [*columns, *counts]])


_WORDS = r"list_filter(string_split({}, ' '), lambda w: w <> '')"


def _level(k: int) -> str:
    return f"""t{k} as materialized (select g, leaf, h, len(toks) as size, unnest(toks) as tok, generate_subscripts(toks, 1) - 1 as i from c{k}),
s{k} as materialized (select g, i, tok, count(*) as n from t{k} group by all having count(*) > 1),
m{k} as materialized (select g, i, max((n, tok))[2] as top from s{k} group by all),
j{k} as materialized (select g, leaf, h, any_value(t.size) as size, count(*) filter (where tok = top) as same, count(*) as shared, max((s.n, i, tok)) filter (where tok <> top) as anchor
  from t{k} t join s{k} s using (g, i, tok) join m{k} using (g, i) group by g, leaf, h),
a{k} as (select leaf, h, concat('T{k} ', g) as t from j{k} where 100 * same >= {SIMILAR} * size),
c{k + 1} as materialized (select concat(j.g, ' ', anchor[2], '=', anchor[3]) as g, leaf, h, toks from c{k} join j{k} j using (g, leaf, h) where 100 * shared >= {SIMILAR} * size and 100 * same < {SIMILAR} * size)"""


ORACLE = rf"""
with raw as (select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents),
mask as (select *, translate(line, concat(chr(9), chr(11), chr(12), chr(13)), '    ') as p from raw),
cut as (select doc_id, text, line, pos, {_WORDS.format("p")} as plain, {_WORDS.format(f"regexp_replace(p, '{_FIELD}', '<*>', 'g')")} as masked from mask),
own as (select *, len(masked) < {MIN_TOKENS} or (regexp_matches(line, '[0-9]') and len(list_filter(masked, lambda w: w <> '<*>')) < {FIXED}) as exact from cut where len(plain) > 0),
tk as (select doc_id, text, pos, case when exact then plain else masked end as toks, not exact and len(masked) >= {WIDE} as wide from own),
hs as (select *, concat(len(toks), ' ', array_to_string(toks, ' ')) as h from tk),
l as materialized (select *, case when wide then concat('L', len(toks), ' ', array_to_string(toks[1:{LEAD}], ' ')) else h end as leaf from hs),
leaves as (select leaf from l group by leaf having min(doc_id) < max(doc_id) and min(h) < max(h)),
c0 as materialized (select leaf as g, leaf, h, any_value(toks)[{LEAD + 1}:] as toks from l where leaf in (select leaf from leaves) group by leaf, h),
{",{}".format(chr(10)).join(_level(k) for k in range(LEVELS))},
general as ({" union all ".join(f"select * from a{k}" for k in range(LEVELS))}),
t as (select doc_id, pos, coalesce(g.t, concat('H', l.h)) as t from l left join general g on g.leaf = l.leaf and g.h = l.h),
firsts as (select t, min(doc_id) as o0 from t group by t having min(doc_id) < max(doc_id)),
gone as materialized (select distinct doc_id, pos from t join firsts using (t) where doc_id > o0),
kept as (select doc_id, string_agg(line, chr(10) order by pos) as text from raw where not exists (select 1 from gone g where g.doc_id = raw.doc_id and g.pos = raw.pos) group by doc_id)
select d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::bigint as n_lines, (select count(*) from gone g where g.doc_id = d.doc_id)::bigint as n_dropped,
  case when d.text is null then null else sha256(coalesce(k.text, '')) end as text_sha256
from documents d left join kept k on k.doc_id = d.doc_id
"""
