"""Quality rules with risk-controlled thresholds.

Each document gets counts (words, symbols, repeated lines and word windows) and, from them, integer scores per
mille, higher being worse. A base rule rejects documents that are too short or repeat themselves. The method's verdict
rejects what exceeds a cutoff of any score; cutoffs are chosen for every stratum (language) on labelled documents that
the base rule leaves, equal texts being one:

1. A third of the labelled texts, drawn by hash, gives a path of ever stricter sets of cutoffs: from no cutoff on, the
   step next taken is the one that rejects the fewest good documents for each bad one, while a bad one outweighs them.
2. The other texts are the holdout. Along the path, an exact binomial test asks whether the whole set (the union of its
   cutoffs) rejects more than RISK of the good documents of the stratum, at level ALPHA / strata (Bonferroni), until it
   first fails (fixed-sequence testing, which needs no further correction). The last set that passes is used.

So, with a chance of 1 - ALPHA, the method rejects at most RISK of the good documents in every stratum at once. A
stratum without enough labelled texts to pass any test gets no cutoff.

Only built-in functions run on the rows; the driver sees one row of counts and the path for each stratum.

Edge cases: null and empty texts have zero counts and fail the base rule; repeated rows each get their result, rows that
share a doc_id are judged one by one; an empty table gives an empty result; labels that contradict one another for a
document or text count as bad; labels that are null are ignored; rows without doc_id have no label but are judged as
others; further columns of the input are kept, the result's names winning over equal ones.
"""

from __future__ import annotations

from math import exp, lgamma, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import bound, counted, words
from telemill.plans.lineage import sized_join, written

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Allowed share of good documents that all cutoffs together may reject in a stratum, and the chance that this fails anywhere.
RISK, ALPHA = 0.005, 0.05
#: One in so many labelled texts gives the path, the others test it.
PATH_SHARE = 3
#: Good documents weigh so much more than bad ones when a cutoff is picked from those that hold the risk.
GAIN = 5
#: Cutoffs per mille, mildest first; scores run to 1000 (word_length: tenths of characters).
GRID = (900, 800, 700, 600, 500, 400, 350, 300, 250, 200, 175, 150, 125, 100, 90, 80, 70, 60, 50, 40, 30, 20, 10, 5)


def repeated_words(w: Column) -> Column:
    """Words in windows of WINDOW words that the text holds twice or more."""
    starts = F.when(F.size(w) >= WINDOW, F.sequence(F.lit(0), F.size(w) - WINDOW)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i + 1, WINDOW)))

    def covered(positions: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct((i + WINDOW).alias("end"), (a.n + i + WINDOW - F.greatest(i, a.end)).alias("n"))
        return F.aggregate(positions, start, step, lambda a: a.n)

    def twins(s: Column) -> Column:
        same = lambda e, k: (e.h == F.get(s, k - 1).h) | (e.h == F.get(s, k + 1).h)
        return F.sort_array(F.transform(F.filter(s, lambda e, k: F.coalesce(same(e, k), F.when(F.get(s, k - 1).isNull(), e.h == F.get(s, k + 1).h).otherwise(e.h == F.get(s, k - 1).h), F.lit(False))), lambda e: e.i))

    def by_hash(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(bound(pairs, twins)))

    return bound(hashes, by_hash).cast("long")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, n_lines, n_upper, n_marks."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    per_words = bound(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeated")))
    per_lines = bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    out = docs.withColumns({"__w": per_words, "__l": per_lines, "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"), "n_symbols": counted(t, SYMBOLS), "n_upper": counted(t, UPPER), "n_marks": counted(t, "!")})
    out = out.withColumns({"n_words": F.col("__w.n"), "n_repeat_words": F.col("__w.repeated"), "n_dup_lines": F.col("__l.dup"), "n_lines": F.col("__l.n")}).drop("__w", "__l")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def scores() -> dict[str, Column]:
    """Integer scores per mille of a row of features()."""
    per = lambda a, b: F.least(F.lit(1000), F.coalesce(F.expr(f"try_divide(1000 * {a}, {b})").cast("long"), F.lit(0)))
    return {
        "symbols": per("n_symbols", "word_chars"),
        "upper": per("n_upper", "word_chars"),
        "marks": per("n_marks", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeats": per("n_repeat_words", "n_words"),
        "word_length": per("word_chars", "100 * n_words"),
    }


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for n trials of chance p."""
    if k >= n:
        return 1.0
    a, b = log(p), log(1 - p)
    top = lgamma(n + 1)
    return min(1.0, sum(exp(top - lgamma(i + 1) - lgamma(n - i + 1) + i * a + (n - i) * b) for i in range(k + 1)))


def path(counts: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int]]:
    """(score, cutoff) in the order in which they are to be added. counts: good and bad documents that each cutoff of
    GRID rejects, by score."""
    at, steps = dict.fromkeys(counts, -1), []
    while True:
        best = None
        for s, rejected in counts.items():
            g0, b0 = rejected[at[s]] if at[s] >= 0 else (0, 0)
            for i in range(at[s] + 1, len(GRID)):
                good, bad = rejected[i][0] - g0, rejected[i][1] - b0
                if bad > GAIN * good and (best is None or (good / bad, -bad, s, i) < best):
                    best = (good / bad, -bad, s, i)
        if best is None:
            return steps
        steps.append((best[2], GRID[best[3]]))
        at[best[2]] = best[3]


def passed(good: int, first: dict[int, int], n: int, level: float, risk: float = RISK) -> int:
    """How many of n steps hold the risk. good: good documents of the holdout; first: how many of them each step (from 1)
    is the first to reject."""
    rejected = 0
    for step in range(1, n + 1):
        rejected += first.get(step, 0)
        if not good or binomial_cdf(rejected, good, risk) > level:
            return step - 1
    return n


def thresholds(scored: DataFrame, labels: DataFrame, stratum: str, alpha: float = ALPHA, risk: float = RISK) -> list[tuple]:
    """(stratum, cutoff of each score or None) of the strata that have any. scored: features() with __text and scores()."""
    names = list(scores())
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("__good"))
    held = sized_join(scored.where(~F.col("base_failed")), known, "doc_id")
    held = held.groupBy(F.col(stratum).alias("stratum"), "__text").agg((F.min("__good") == 1).alias("good"), F.first(F.array(*[F.col(f"__{s}") for s in names])).alias("scores"))
    held = written(held.withColumn("on_path", F.pmod(F.xxhash64(F.lit("path"), F.col("__text")), F.lit(PATH_SHARE)) == 0), "labelled")
    counts = []
    for k, s in enumerate(names):
        for c in GRID:
            over = F.col("on_path") & (F.col("scores")[k] > c)
            counts += [F.count_if(over & F.col("good")).alias(f"{s}_{c}_g"), F.count_if(over & ~F.col("good")).alias(f"{s}_{c}_b")]
    paths = {r["stratum"]: path({s: [(r[f"{s}_{c}_g"], r[f"{s}_{c}_b"]) for c in GRID] for s in names}) for r in held.groupBy("stratum").agg(*counts).collect()}
    rows = [(value, [(names.index(s) + 1, c) for s, c in steps]) for value, steps in paths.items()]
    steps = held.sparkSession.createDataFrame(rows, f"stratum {scored.schema[stratum].dataType.simpleString()}, steps array<struct<s:int,c:int>>")
    test = held.where(~F.col("on_path") & F.col("good")).alias("h").join(F.broadcast(steps).alias("p"), F.col("h.stratum").eqNullSafe(F.col("p.stratum")))  # a row a stratum
    first = F.array_position(F.transform("steps", lambda x: F.element_at("scores", x.s) > x.c), True)
    found: dict = {}
    for r in test.groupBy(F.col("h.stratum").alias("stratum"), first.alias("step")).count().collect():
        found.setdefault(r["stratum"], {})[r["step"]] = r["count"]
    out = []
    for value, steps in paths.items():
        cutoffs = dict(steps[: passed(sum(found.get(value, {}).values()), found.get(value, {}), len(steps), alpha / len(paths), risk)])
        if cutoffs:
            out.append((value, *[cutoffs.get(s) for s in names]))
    return sorted(out, key=repr)


def _judged(needed: DataFrame, labels: DataFrame, stratum: str) -> DataFrame:
    """needed (doc_id, stratum, __text, features and scores), with kept."""
    names = list(scores())
    kind = needed.schema[stratum].dataType.simpleString()
    cutoffs = needed.sparkSession.createDataFrame(thresholds(needed, labels, stratum), f"__stratum {kind}, " + ", ".join(f"__cut_{s} int" for s in names))
    judged = needed.join(F.broadcast(cutoffs), F.col(stratum).eqNullSafe(F.col("__stratum")), "left")  # a row a stratum
    bad = F.lit(False)
    for s in names:
        bad = bad | F.coalesce(F.col(f"__{s}") > F.col(f"__cut_{s}"), F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~bad).drop("__stratum", "__text", *[f"__{s}" for s in names], *[f"__cut_{s}" for s in names])


def _featured(rows: DataFrame) -> DataFrame:
    """rows (text and others) with features, scores and a hash of the text, which goes."""
    return features(rows).withColumns({f"__{k}": v for k, v in scores().items()}).withColumn("__text", F.xxhash64("text")).drop("text")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """docs' doc_id and stratum with the features, and kept: false if the base rule or a learnt cutoff rejects."""
    return _judged(written(_featured(docs.select("doc_id", stratum, "text")), "features"), labels, stratum)


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of docs that are kept, unchanged. Rows are written once with their features, so that none is shuffled."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    needed = written(_featured(docs.select(whole, "doc_id", stratum, "text")), "features")
    return _judged(needed, labels, stratum).where("kept").select("__row.*")
