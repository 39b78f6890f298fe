"""Fill-in-the-middle: texts cut at borders of units into prefix, middle and suffix, and put together in another order.

Units are the matches of a pattern, left to right: code points, words, lines. A text's matches are taken up to RUN at a
time and exploded with their places; window sums over these runs tell how many units and code points stand before each.
The cuts that a document asks for are rows that join the run that holds their unit's ordinal; their offsets are gathered
by document, and the pieces are substrings of its text. Only numbers are shuffled up to there: units are those of a text,
whichever documents have it, and cuts those of a document's id and text, so that repeated rows get the same result.

Null texts are empty. A document stays plain if its text is empty, holds one of the marks, isn't covered by matches from
end to end, or the draw says so. A null id is drawn as no digits at all. Other columns of the input are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.llm.common import bound
from telemill.plans.lineage import drop_written, sized_join, written

#: Patterns of units that cover any text.
POINTS, WORDS, LINES = r"(?s).", r"\s*\S+|\s+", r"[^\n]*\n|[^\n]+"
#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Units that one row stands for.
RUN = 1024


def drawn(doc_id: Column, n: Column, seed: int = 1, plain: int = 90, spm: int = 20) -> dict[str, Column]:
    """plain, spm: whether a document of n units stays plain or has its suffix first; first, second: units before its cuts."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    return {"plain": h[2] % 100 >= plain, "spm": h[3] % 100 < spm, "first": F.least(a, b), "second": F.greatest(a, b)}


def _keys(docs: DataFrame) -> DataFrame:
    """doc_id, __doc, __text and __key, the text's 256-bit digest."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__doc"), text.alias("__text"), F.unhex(F.sha2(text, 256)).alias("__key"))


def units(docs: DataFrame, unit: str = POINTS) -> DataFrame:
    """doc_id, __doc, __key, runs (array of chars, units), n, whole: whether the matches cover the text."""
    d = _keys(docs)
    taken = F.regexp_extract_all("__text", F.lit(f"(?:{unit}){{1,{RUN}}}+"), F.lit(0))

    def measured(runs: Column) -> Column:
        full = lambda i: i < F.size(runs) - 1
        return F.transform(runs, lambda r, i: F.struct(F.length(r).cast("long").alias("chars"), F.when(full(i), F.lit(RUN)).otherwise(F.regexp_count(r, F.lit(unit))).cast("long").alias("units")))

    d = d.select("doc_id", "__doc", "__key", "__text", bound(taken, measured).alias("runs"))
    total = lambda name: F.aggregate(f"runs.{name}", F.lit(0).cast("long"), lambda s, x: s + x)
    whole = total("chars") == F.length("__text")
    n = F.when(whole, total("units")).otherwise(F.regexp_count("__text", F.lit(unit)))  # of gaps, runs end before they are full
    return d.select("doc_id", "__doc", "__key", "runs", n.cast("long").alias("n"), whole.alias("whole"))


def offsets(cuts: DataFrame, about: DataFrame) -> DataFrame:
    """__doc, __key, and for the cuts `first` and `second` (units before them) a struct of before, chars and inner: the
    code points before the run that holds the cut's last unit, those of the run, and the units of the run before the cut."""
    runs = about.select("__key", F.posexplode("runs").alias("run", "r")).groupBy("__key", "run").agg(F.max("r").alias("r")).select("__key", "run", "r.*")
    so_far = Window.partitionBy("__key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(so_far), F.lit(0).cast("long"))
    runs = runs.select("__key", "run", "chars", before("units").alias("__past"), before("chars").alias("before"))
    asked = cuts.select("__doc", "__key", F.explode(F.array(*[F.struct(F.lit(c).alias("cut"), F.col(c).alias("ordinal")) for c in ("first", "second")])).alias("a")).select("__doc", "__key", "a.*")
    asked = asked.where("ordinal > 0").withColumn("run", F.expr(f"cast((ordinal - 1) div {RUN} as int)"))
    met = sized_join(asked, runs, ["__key", "run"])
    at = F.struct("before", "chars", (F.col("ordinal") - F.col("__past")).alias("inner"))
    return met.groupBy("__doc", "__key").agg(*[F.max(F.when(F.col("cut") == c, at)).alias(c) for c in ("first", "second")])


def _offset(at: str, unit: str) -> Column:
    """Code points before a cut; 0 where no unit is."""
    c = F.col(at)
    run = F.substring("__text", (c["before"] + 1).cast("int"), c["chars"].cast("int"))
    head = F.slice(F.regexp_extract_all(run, F.lit(unit), F.lit(0)), F.lit(1), c["inner"].cast("int"))
    inner = F.aggregate(head, F.lit(0).cast("long"), lambda s, u: s + F.length(u))
    return F.when(c.isNull(), F.lit(0).cast("long")).otherwise(c["before"] + inner)


def fill_in_middle(docs: DataFrame, unit: str = POINTS, marks: tuple[str, str, str] = MARKS, seed: int = 1, plain: int = 90, spm: int = 20) -> DataFrame:
    """doc_id, text, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output."""
    about = written(units(docs, unit), "units")
    draw = drawn(F.col("doc_id"), F.col("n"), seed, plain, spm)
    asked = about.where(F.col("whole") & (F.col("n") > 0) & ~draw["plain"]).select("__doc", "__key", draw["first"].alias("first"), draw["second"].alias("second")).distinct()
    found = written(offsets(asked, about), "offsets")
    shape = about.groupBy("__doc", "__key").agg(F.max("n").alias("n"), F.max("whole").alias("whole"))
    shape = shape.join(found, ["__doc", "__key"], "left")
    d = sized_join(_keys(docs), written(shape, "shape"), ["__doc", "__key"])
    marked = F.lit(False)
    for m in marks:
        marked = marked | F.contains("__text", F.lit(m))
    form = F.when((F.col("__text") == "") | ~F.col("whole") | marked | draw["plain"], "plain").when(draw["spm"], "spm").otherwise("psm")
    d = d.select("doc_id", "__text", "n", form.alias("form"), _offset("first", unit).alias("__a"), _offset("second", unit).alias("__b"))
    a, b, cut = F.col("__a").cast("int"), F.col("__b").cast("int"), F.col("form") != "plain"
    prefix, middle, suffix = F.substring("__text", F.lit(1), a), F.substring("__text", a + 1, b - a), F.substring("__text", b + 1, F.length("__text"))
    p, s, m = (F.lit(x) for x in marks)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("__text"))
    drop_written(found)
    return d.select("doc_id", F.col("__text").alias("text"), "n", "form", F.when(cut, F.col("__a")).alias("prefix_chars"), F.when(cut, F.col("__b") - F.col("__a")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of: its pieces hold no marks, so that the first of each is the one put there."""
    p, s, m = marks

    def pieces(one: str, two: str) -> tuple[Column, Column, Column]:
        i, j, n = F.instr(output, two), F.instr(output, m), F.length(output)
        return F.substring(output, F.lit(len(one) + 1), i - len(one) - 1), F.substring(output, i + len(two), j - i - len(two)), F.substring(output, j + len(m), n)

    prefix, suffix, middle = pieces(p, s)
    suffix2, prefix2, middle2 = pieces(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


ORACLE = """with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
h as (select *, ('0x' || h[1:8])::bigint % (n + 1) as a, ('0x' || h[9:16])::bigint % (n + 1) as b, ('0x' || h[17:24])::bigint % 100 as c, ('0x' || h[25:32])::bigint % 100 as e from d),
f as (select *, least(a, b) as x, greatest(a, b) as y, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or c >= 90 then 'plain' when e < 20 then 'spm' else 'psm' end as form from h),
g as (select *, t[1:x] as pre, t[x + 1:y] as mid, t[y + 1:n] as suf from f)
select doc_id, n, form, case when form <> 'plain' then x end as prefix_chars, case when form <> 'plain' then y - x end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256 from g"""
