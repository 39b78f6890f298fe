"""URL filters: rules by host and path, and for the rest a naive Bayes model over segmented names.

Hosts and paths are split into names at what isn't a letter or digit; each name is cut into words by the most likely
path through a unigram model (Viterbi), a name that is itself a word among them. Its counts come from prose, the titles
and bodies of the pages, as the names in URLs are run together. A multinomial naive Bayes model over these words is
learnt from the URLs for which a rule speaks, and from words with a known verdict where the caller has such (known). What
the rules speak about, the names in their hosts and paths, is not shown to the model.

Words of prose and odds of tokens are tables without a cap. Each name is cut once: its parts are joined with the words,
and a worker gets the counts of those parts only. The odds of a name's words are summed to a score of the name, and the
scores of a page's names to that of the page, in whole billionths, so that no order of summing tells.

Edge cases: null URLs and those without :// have empty host and path, no rule, and the verdict of the class prior, as
have URLs without a known word; ties and a model without examples allow; repeated rows each get their verdict; names and
words of any length and of any letters are cut; a host's punycode is read as it is written; other columns are kept out.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.pretokens import Memo
from telemill.plans.lineage import sized_join, written

#: Letters by which words are looked up in names: of longer words, their first ones.
HEAD = 20
#: Cuts of names that a Segmenter keeps.
KEPT = 200_000
#: Log odds are whole numbers of this part.
UNIT = 10**9
#: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: How many examples a word stands for whose verdict the caller knows.
KNOWN_WEIGHT = 100
_NAME = regex.compile(r"\p{L}+|[0-9]+")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # longer ones are asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


class Segmenter:
    """Words of names by a unigram model: counts of words (of all, or those that are parts of the names) and their total."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = total or sum(counts.values()) or 1
        self.cost = {w: log(total) - log(n) for w, n in counts.items()}
        self.lengths = sorted({len(w) for w in counts})
        self.unknown = log(total) + 1
        self.words = Memo(self._words, KEPT)

    def _words(self, name: str) -> tuple[str, ...]:
        if not name.isalpha():
            return (name,)
        best: list[tuple[float, int]] = [(0.0, 0)]
        least = (0.0, 0)  # of the places so far, where an unknown word would best begin
        for end in range(1, len(name) + 1):
            here = (least[0] + self.unknown + 2.5 * end, least[1])
            for n in self.lengths:
                if n > end:
                    break
                cost = self.cost.get(name[end - n : end])
                if cost is not None:
                    here = min(here, (best[end - n][0] + cost, end - n))
            best.append(here)
            least = min(least, (here[0] - 2.5 * end, end))
        words, end = [], len(name)
        while end:
            words.append(name[best[end][1] : end])
            end = best[end][1]
        return tuple(words[::-1])


def rule_names(rules) -> tuple[set[str], set[str]]:
    """What rules say is not shown to the model: these names of hosts, and of paths."""
    return {x for _, h, _ in rules for x in h.split(".")}, {x for _, _, p in rules for x in p.lower().split("/") if x}


def prose(pages: DataFrame) -> DataFrame:
    """w: each word in the titles and bodies of pages, without markup and scripts, in small letters."""
    said = F.coalesce("html", F.lit(""))
    for hidden in (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->", r"<[^>]*>", r"&#?[0-9A-Za-z]+;"):
        said = F.regexp_replace(said, hidden, " ")
    found = F.filter(F.split(F.lower(said), r"[^\p{L}]+"), lambda w: F.length(w) > 1)
    return pages.select(F.explode(found).alias("w"))


def _known(spark, known: dict[str, str] | None) -> DataFrame:
    """w, b, a: words with a known verdict as examples."""
    rows = [(w, KNOWN_WEIGHT * (v == "block"), KNOWN_WEIGHT * (v == "allow")) for w, v in (known or {}).items()]
    return spark.createDataFrame(rows, "w string, b long, a long")


def lexicon(pages: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """w and n: counts of all words in prose, and of words with a known verdict, seen once more each."""
    return prose(pages).union(_known(pages.sparkSession, known).select("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def named(pages: DataFrame, rules=RULES) -> DataFrame:
    """__row, page_id, host, path, rule, verdict of the rule, and names: those of the host, and after a / those of the path."""
    host, path = parts(F.col("url"))
    rows = pages.select(F.monotonically_increasing_id().alias("__row"), "page_id", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict})
    labels, left_out = rule_names(rules)

    def names(host: str, path: str) -> list[str]:
        out = [x for n in host.split(".") if n not in labels for x in _NAME.findall(n)]
        return out + ["/" + ("#" if x.isdigit() else x) for x in _NAME.findall(path.lower()) if x not in left_out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [names(h, p) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.string()))], [*b.schema.names, "names"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"__row long, page_id {kind}, host string, path string, rule string, verdict string, names array<string>")


def segmented(names: DataFrame, words: DataFrame) -> DataFrame:
    """names (name, b, a) with words: what each name is cut into, by the counts of words (w, n).

    The words in a name are found by their first HEAD letters, so that a name's rows grow with its length alone. Of
    longer words, a name may get some that it doesn't hold; a Segmenter doesn't find them there.
    """
    names = written(names.withColumn("__id", F.monotonically_increasing_id()), "names")
    bare = names.select("__id", F.regexp_replace("name", "^/", "").alias("s")).withColumn("l", F.length("s"))
    starts = bare.where("l > 1").select("__id", "s", "l", F.explode(F.expr("sequence(1, l - 1)")).alias("i"))
    heads = starts.select("__id", F.explode(F.expr(f"transform(sequence(2, least({HEAD}, l - i + 1)), k -> substring(s, i, k))")).alias("head"))
    total, longest = words.agg(F.sum("n")).first()[0], bare.agg(F.max("l")).first()[0]
    told = words.where(F.length("w") <= F.lit(longest)).select(F.substring("w", 1, HEAD).alias("head"), "w", "n")
    known = sized_join(heads, told, "head").groupBy("__id").agg(F.collect_set(F.struct("w", "n")).alias("known"))
    rows = sized_join(names, written(known, "parts"), "__id", "left").select("name", "b", "a", "known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = []
            for name, known in zip(b.column("name").to_pylist(), b.column("known").to_pylist(), strict=True):
                sign, own = name[: name.startswith("/")], Segmenter({x["w"]: x["n"] for x in known or ()}, total)
                cut.append([sign + w for w in own.words[name[len(sign) :]]])
            yield pa.RecordBatch.from_arrays([b.column("name"), b.column("b"), b.column("a"), pa.array(cut, pa.list_(pa.string()))], ["name", "b", "a", "words"])

    return rows.mapInArrow(run, "name string, b long, a long, words array<string>")


def bayes(rows: DataFrame, cut: DataFrame, known: dict[str, str] | None = None) -> tuple[int, DataFrame]:
    """Log odds of block: of the prior, and of each word (w, odds)."""
    n = {r["verdict"]: r["count"] for r in rows.where("verdict is not null").groupBy("verdict").count().collect()}
    tokens = cut.where("b + a > 0").select(F.explode("words").alias("w"), "b", "a").union(_known(rows.sparkSession, known))
    counts = written(tokens.groupBy("w").agg(F.sum("b").alias("b"), F.sum("a").alias("a")), "tokens")
    all_b, all_a, size = counts.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0)), F.count(F.lit(1))).first()
    odds = F.log((F.col("b") + 1) / (all_b + size)) - F.log((F.col("a") + 1) / (all_a + size))
    prior = log((n.get("block", 0) + 1) / (n.get("allow", 0) + 1))
    return round(prior * UNIT), counts.select("w", F.round(odds * UNIT).cast("long").alias("odds"))


def judge(pages: DataFrame, rules=RULES, known: dict[str, str] | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of each page. known: verdicts of words, if any are known beforehand."""
    rows = written(named(pages, rules), "urls")
    uses = rows.select(F.explode("names").alias("name"), "verdict").groupBy("name").agg(F.count_if(F.col("verdict") == "block").alias("b"), F.count_if(F.col("verdict") == "allow").alias("a"))
    cut = written(segmented(uses, written(lexicon(pages, known), "words")), "cut")
    prior, odds = bayes(rows, cut, known)
    scores = sized_join(cut.select("name", F.explode("words").alias("w")), odds, "w").groupBy("name").agg(F.sum("odds").alias("score"))
    asked = rows.where("verdict is null").select("__row", F.explode("names").alias("name"))
    sums = sized_join(asked, written(scores, "scores"), "name").groupBy("__row").agg(F.sum("score").alias("score"))
    said = F.when(F.coalesce("score", F.lit(0)) + prior > 0, "block").otherwise("allow")
    out = sized_join(rows.drop("names"), written(sums, "sums"), "__row", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", said).alias("verdict"))
