"""Secret scans with a random forest that removes false positives.

Candidates are runs of at least LEAST characters of the alphabets that keys are written in, with a digit or two changes
of case. Each gets features: length, shares of character classes, how unusual its transitions from letter to letter are,
how much of it words of a dictionary cover, what the words around it and in its path speak for, and whether it is
assigned. A random forest learnt from labelled findings tells secrets from hashes, numbers, names and placeholders.

Dictionary and transitions come from all words of all texts: letter words seen twice or more, and the pairs of letters in
them. The dictionary is a table without a cap that the pieces of distinct candidates are joined with; the transitions are
26 by 26. What words speak for is learnt from one half of the labelled findings, the forest from the other. The findings
are a sample of at most FINDINGS rows; where none are given, they are drawn: keys in well-known formats, and hashes,
numbers, placeholders and names made of words of the dictionary.

All of it but the fitting of that sample is DataFrame functions; texts are never shuffled, but those that hold a
candidate when many are to be changed.

Edge cases: null texts have no findings and stay null; empty texts have none; equal candidates of a text are one finding
with its number of occurrences, its neighbours being those of the first; a probability equal to the limit is a secret; of
findings within one another the longest is replaced first; repeated rows each get their result; texts of any length are
scanned whole; an empty table gives an empty result; a missing path column counts as none; other columns are kept, but
`findings` of the result takes the place of one of that name.
"""

from __future__ import annotations

import random
import string
from math import log, log2

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import bound
from telemill.plans.lineage import release, sized_join, written

LEAST, AROUND, FINDINGS = 16, 48, 20_000
CANDIDATE = r"[A-Za-z0-9_+/=\-]{%d,}" % LEAST
MARK = "[SECRET]"
TREES, DEPTH, SEED = 16, 6, 7
#: Words of names that the drawn findings are made of, and rows of them.
WORDS, DRAWN = 400, 6000
#: A word around a finding or in a path counts if so many labelled findings have it.
SUPPORT = 5
# Names under which keys are kept, what stands before other long runs, paths, and words for want of others.
NAMES = ("token", "api_key", "apikey", "secret", "password", "access_key", "auth_token", "client_secret", "TOKEN", "bearer", "credential", "private_key", "API_KEY", "passwd")
OTHERS = ("commit", "sha256", "sha1", "md5", "checksum", "digest", "uuid", "revision", "order", "card", "account", "invoice", "build", "etag", "isbn", "id", "hash", "version")
PATHS = ("src/app.py", "config/prod.yml", ".env", "deploy/values.yaml", "notes/2024.txt", "web/index.html", "")
SAMPLES = ("tests/test_login.py", "docs/example.md", "examples/sample.json", "fixtures/keys.txt", "mocks/service.js")
PLAIN = ("time", "people", "water", "number", "place", "house", "market", "history", "report", "system", "river", "music", "friend", "paper", "garden", "window", "story", "morning")


def lexicon(docs: DataFrame, text: str = "text") -> DataFrame:
    """w, n: the words of three to twenty letters a-z that stand by themselves in all texts, in small letters, twice or more."""
    raw = docs.select(F.explode(F.split(F.replace(F.col(text), F.lit("\n"), F.lit(" ")), " ")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    clean = raw.where(F.col("w").rlike("^[A-Za-z]{3,20}[.,;:!?)]*$")).select(F.lower(F.regexp_replace("w", "[^A-Za-z]", "")).alias("w"), "n")
    return clean.groupBy("w").agg(F.sum("n").alias("n")).where("n > 1")


def transitions(words: DataFrame) -> list[float]:
    """Bits of each pair of letters (26 * first + second), from the words of lexicon()."""
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring(F.col("w"), i, F.lit(2)))).alias("p"), "n")
    counts = {r["p"]: r["n"] for r in pairs.groupBy("p").agg(F.sum("n").alias("n")).collect()}
    letters, out = string.ascii_lowercase, []
    for a in letters:
        total = sum(counts.get(a + b, 0) for b in letters)
        out += [-log2((counts.get(a + b, 0) + 1) / (total + 26)) for b in letters]
    return out


def covered(values: DataFrame, words: DataFrame) -> DataFrame:
    """value and covered: of distinct values, how many characters are in pieces (by case and signs) that are words."""
    piece = F.explode(F.regexp_extract_all("value", F.lit("[A-Z]?[a-z]+|[A-Z]+"), F.lit(0)))
    pieces = values.select("value").distinct().select("value", piece.alias("w")).withColumn("w", F.lower("w")).where(F.length("w") >= 3)
    asked = written(pieces.select("w").distinct(), "pieces")
    known = written(sized_join(words, asked, "w", "left_semi").select("w"), "known")
    release(values.sparkSession)
    return sized_join(pieces, known, "w").groupBy("value").agg(F.sum(F.length("w")).alias("covered"))


def _near(text: Column, n: int) -> Column:
    """The last n words of a text (n below 0: the first)."""
    w = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{2,}"), F.lit(0))
    return F.slice(w, F.greatest(F.size(w) - n + 1, F.lit(1)), n) if n > 0 else F.slice(w, 1, -n)


def _numbers(values: list, kind: str = "double") -> Column:
    """An array of numbers as one literal that the optimizer folds, not one a number."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def features(pairs: list[float], near: dict[str, float], path: dict[str, float]) -> dict[str, Column]:
    """Of a row with value, covered, before, after and path. pairs: transitions(); near and path: what words speak for."""
    value = F.col("value")
    n = F.length(value)
    share = lambda pattern: (n - F.length(F.regexp_replace(value, pattern, ""))) * 100 / n
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "9")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    table = _numbers(pairs)
    codes = F.transform(F.sequence(F.lit(1), n), lambda i: F.ascii(F.substring(F.lower(value), i, F.lit(1))) - 97)
    letter = lambda c: (c >= 0) & (c < 26)
    bits = bound(codes, lambda c: F.filter(F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.when(letter(c[i]) & letter(c[i + 1]), F.get(table, c[i] * 26 + c[i + 1]))), lambda x: x.isNotNull()))
    mean = bound(bits, lambda b: F.when(F.size(b) > 0, F.aggregate(b, F.lit(0.0), lambda a, x: a + x) / F.size(b)).otherwise(F.lit(0.0)))

    def odds(words: Column, of: dict[str, float]) -> Column:
        if not of:
            return F.lit(0.0)
        known = F.str_to_map(F.lit(",".join(f"{w}:{of[w]!r}" for w in sorted(of))), F.lit(","), F.lit(":")).cast("map<string,double>")
        return F.aggregate(words, F.lit(0.0), lambda a, w: a + F.coalesce(known[w], F.lit(0.0)))

    return {
        "length": n.cast("double"), "digits": share("[0-9]"), "upper": share("[A-Z]"), "lower": share("[a-z]"), "signs": 100 - share("[A-Za-z0-9]"), "runs": (F.length(runs) - 1) * 100 / n,
        "distinct": F.size(F.array_distinct(F.split(value, ""))).cast("double"), "hexadecimal": flag(value.rlike("^([0-9a-f]+|[0-9A-F]+)$")), "transitions": mean,
        "words": F.coalesce(F.col("covered"), F.lit(0)) * 100.0 / n, "before": odds(_near(F.col("before"), 3), near), "after": odds(_near(F.col("after"), -2), near),
        "path": odds(_near(F.col("path"), 9), path), "assigned": flag(F.col("before").rlike(r"[=:]\s*[\"'`]?\s*$")),
    }


def drawn(words: list[str], n: int = DRAWN, seed: int = SEED) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings (value, before, after, path, 1 for a secret) in well-known formats; words: of the dictionary."""
    r = random.Random(seed)
    words = [*words, *PLAIN]
    draw = lambda letters, a, b=None: "".join(r.choice(letters) for _ in range(r.randint(a, b or a)))
    low, alnum, word = "0123456789abcdef", string.ascii_letters + string.digits, lambda: r.choice(words)
    text = lambda: " ".join(word() for _ in range(3)) + " "
    keys = [  # the first ones show by themselves what they are
        lambda: "AKIA" + draw(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + draw(alnum, 36), lambda: "sk_live_" + draw(alnum, 24), lambda: draw(alnum + "+/", 38) + "==", lambda: "xoxb-" + draw(string.digits, 12) + "-" + draw(alnum, 24),
        lambda: draw(low, r.choice([32, 40, 64])), lambda: draw(low, r.choice([32, 40, 64])).upper(), lambda: draw(alnum, 20, 48), lambda: draw(alnum + "-_", 24, 64),
    ]
    names = [
        lambda: "_".join(word() for _ in range(r.randint(3, 5))) + draw(string.digits, 1, 2), lambda: "".join(word().title() for _ in range(r.randint(3, 5))), lambda: "/".join([word(), word() + draw(string.digits, 2), word(), word()]),
        lambda: "-".join([*(word() for _ in range(3)), draw(string.digits, 4)]), lambda: draw(string.digits, 16, 20), lambda: r.choice("x0*a-=_") * r.randint(16, 40) + r.choice("09"), lambda: "-".join(draw(low, k) for k in (8, 4, 4, 4, 12)),
    ]
    sign = lambda: r.choice([' = "', "=", ": ", ": '", " := `", '="', " "])
    out = []
    for _ in range(n):
        kind, path = r.random(), r.choice(PATHS)
        if kind < 0.40:
            out.append((r.choice(keys)(), text() + r.choice(NAMES) + sign(), '" ' + text(), path, 1))
        elif kind < 0.47:
            out.append((r.choice(keys[:5])(), text(), " " + text(), path, 1))
        elif kind < 0.60:  # hashes and numbers said to be such
            out.append((r.choice([keys[5], keys[6], names[4], names[6]])(), text() + r.choice(OTHERS) + sign(), " " + text(), path, 0))
        elif kind < 0.68:  # placeholders and names where a key would stand
            out.append((r.choice(names)(), text() + r.choice(NAMES) + sign(), '" ' + text(), path, 0))
        elif kind < 0.74:  # keys of tests and samples
            out.append((r.choice(keys[5:])(), text() + r.choice(NAMES) + sign(), '" ' + text(), r.choice(SAMPLES), 0))
        else:
            out.append((r.choice(names)(), text() + r.choice(["", "", "(", '"']), " " + text(), path, 0))
    return [(v if len(v) >= LEAST else v + "0" * LEAST, *rest) for v, *rest in out]


def _tree(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator) -> tuple | float:
    """A tree of (feature, cut, tree at or below, tree above), or the share of secrets."""
    if depth == 0 or len(y) < 8 or y.min() == y.max():
        return float(y.mean())
    best = None
    for f in rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:])[:: max(1, len(values) // 24)] / 2:
            left = x[:, f] <= cut
            k = left.sum()
            if k in (0, len(y)):  # two values so near that the cut is one of them
                continue
            a, b = y[left].mean(), y[~left].mean()
            cost = k * a * (1 - a) + (len(y) - k) * b * (1 - b)
            if best is None or cost < best[0]:
                best = (cost, int(f), float(cut))
    if best is None:
        return float(y.mean())
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], _tree(x[left], y[left], depth - 1, rng), _tree(x[~left], y[~left], depth - 1, rng)


def forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list:
    """Trees, each from a bootstrap sample."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        at = rng.integers(0, len(y), len(y))
        out.append(_tree(x[at], y[at], depth, rng))
    return out


def probability(trees: list, names: list[str], of) -> Column:
    """The forest as an expression. of: the column of a feature's name.

    Trees are filled up to one depth and kept as three folded arrays, so that plans don't grow with the forest: the
    children of place i are 2i and 2i + 1, a tree has `slots` places, and after its last places come its leaves.
    """

    def depth(t) -> int:
        return 0 if isinstance(t, float) else 1 + max(depth(t[2]), depth(t[3]))

    deep = max(1, *map(depth, trees))
    slots = 1 << deep
    asked, cuts, leaves = [0] * (slots * len(trees)), [0.0] * (slots * len(trees)), [0.0] * (slots * len(trees))

    def put(t, first: int, at: int) -> None:
        if at >= slots:
            leaves[first + at - slots] = round(t, 6)
            return
        inner = not isinstance(t, float)
        if inner:
            asked[first + at], cuts[first + at] = t[0], t[1]
        put(t[2] if inner else t, first, 2 * at)
        put(t[3] if inner else t, first, 2 * at + 1)

    for k, t in enumerate(trees):
        put(t, k * slots, 1)
    f, c, v = _numbers(asked, "int"), _numbers(cuts), _numbers(leaves)

    def total(x: Column) -> Column:
        def leaf(first: Column) -> Column:
            at = F.aggregate(F.sequence(F.lit(1), F.lit(deep)), F.lit(1), lambda i, _: 2 * i + F.when(F.get(x, F.get(f, first + i)) <= F.get(c, first + i), 0).otherwise(1))
            return F.get(v, first + at - slots)

        return F.aggregate(F.sequence(F.lit(0), F.lit(len(trees) - 1)), F.lit(0.0), lambda a, k: a + leaf(k * slots))

    return F.round(bound(F.array(*[of(n).cast("double") for n in names]), total) / len(trees), 6)


def _odds(rows: list, words) -> dict[str, float]:
    """What each word speaks for: log odds of a secret, from findings (label last) with the word against all."""
    seen: dict[str, list[int]] = {}
    totals = [1, 1]
    for r in rows:
        totals[r[-1]] += 1
        for w in set(words(r)):
            seen.setdefault(w, [0, 0])[r[-1]] += 1
    return {w: round(log((b + 0.5) / totals[1]) - log((a + 0.5) / totals[0]), 4) for w, (a, b) in seen.items() if a + b >= SUPPORT}


class Model:
    """What is learnt: the forest, its features' names, what words speak for, and the transitions."""

    def __init__(self, words: DataFrame, findings: DataFrame | None = None):
        spark = words.sparkSession
        schema = "value string, before string, after string, path string, label int"
        self.words, self.pairs = words, transitions(words)
        if findings is None:
            some = words.where("length(w) between 4 and 10").orderBy(F.xxhash64("w"), "w").limit(WORDS)
            findings = spark.createDataFrame(drawn([r["w"] for r in some.select("w").collect()]), schema)
        rows = sorted(map(tuple, findings.select("value", F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")), F.coalesce("path", F.lit("")), "label").limit(FINDINGS).collect()))
        random.Random(SEED).shuffle(rows)
        half = rows[::2]
        held = spark.createDataFrame(half, schema).select(_near(F.col("before"), 3).alias("b"), _near(F.col("after"), -2).alias("a"), _near(F.col("path"), 9).alias("p"), "label").collect() if half else []
        self.near = _odds(held, lambda r: [*r["b"], *r["a"]])
        self.path = _odds(held, lambda r: r["p"])
        self.trees, self.names = [], []
        made = self.features()
        self.names = list(made)
        rest = rows[1::2]
        if rest:
            frame = spark.createDataFrame(rest, schema)
            frame = frame.join(covered(frame, words), "value", "left")
            data = np.array(sorted(tuple(r) for r in frame.select(*made.values(), F.col("label").cast("double")).collect()), float)
            self.trees = forest(data[:, :-1], data[:, -1])

    def features(self) -> dict[str, Column]:
        return features(self.pairs, self.near, self.path)

    def judged(self, rows: DataFrame, least: float) -> DataFrame:
        """rows (value, before, after, path) with probability and secret."""
        rows = sized_join(rows, written(covered(rows, self.words), "covered"), "value", "left")
        if not self.trees:
            return rows.withColumns({"probability": F.lit(0.0), "secret": F.lit(False)})
        rows = rows.withColumn("__f", F.struct(*[c.alias(k) for k, c in self.features().items()]))
        rows = rows.withColumn("probability", probability(self.trees, self.names, lambda k: F.col(f"__f.{k}")))
        return rows.withColumn("secret", F.col("probability") >= least).drop("__f")


def train(docs: DataFrame, findings: DataFrame | None = None, text: str = "text") -> Model:
    """A model with the dictionary of docs. findings: labelled ones (value, before, after, path, label: 1 for a secret)."""
    words = written(lexicon(docs, text), "lexicon")
    release(docs.sparkSession)
    return Model(words, findings)


def _found(text: Column) -> Column:
    """The distinct candidates of a text."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
    return F.filter(found, lambda v: v.rlike("[0-9]|[a-z][A-Z].*[a-z][A-Z]"))


def _row(docs: DataFrame, text: str, path: str) -> tuple[Column, Column]:
    """A hash that tells rows of other results apart, and the path."""
    p = F.coalesce(F.col(path), F.lit("")) if path in docs.columns else F.lit("")
    return F.xxhash64(text, p), p


def candidates(docs: DataFrame, keep: list[str] = (), text: str = "text", path: str = "source") -> DataFrame:
    """A row for each candidate of each row: the columns to keep, __key, nth, value, occurrences, before, after, path."""
    t = F.col(text)
    key, p = _row(docs, text, path)

    def one(v: Column) -> Column:
        at = F.instr(t, v)
        before = F.substring(t, F.greatest(F.lit(1), at - AROUND), F.least(F.lit(AROUND), at - 1))
        times = ((F.length(t) - F.length(F.replace(t, v, F.lit("")))) / F.length(v)).cast("long")
        return F.struct(v.alias("value"), times.alias("occurrences"), before.alias("before"), F.substring(t, at + F.length(v), F.lit(AROUND)).alias("after"))

    rows = docs.select(*keep, key.alias("__key"), p.alias("path"), F.posexplode(F.transform(_found(t), one)).alias("nth", "c"))
    return rows.select(*keep, "__key", "nth", "c.*", "path")


def found(docs: DataFrame, keep: list[str] = ("doc_id",), findings: DataFrame | None = None, text: str = "text", path: str = "source", least: float = 0.5) -> DataFrame:
    """The findings of all rows: the columns to keep, __key, nth, value, occurrences, probability, secret."""
    rows = written(candidates(docs, list(keep), text, path), "candidates")
    return train(docs, findings, text).judged(rows, least).select(*keep, "__key", "nth", "value", "occurrences", "probability", "secret")


def scan(docs: DataFrame, findings: DataFrame | None = None, text: str = "text", path: str = "source", least: float = 0.5) -> DataFrame:
    """docs with findings: array of (value, occurrences, probability, secret), in order of first occurrence."""
    each = found(docs, [], findings, text, path, least)
    by_row = each.groupBy("__key").agg(F.array_sort(F.collect_set(F.struct("nth", "value", "occurrences", "probability", "secret"))).alias("__found"))
    held = docs.withColumn("__key", _row(docs, text, path)[0])
    out = sized_join(held, written(by_row, "findings"), "__key", "left")
    plain = F.transform("__found", lambda f: F.struct(f.value.alias("value"), f.occurrences.alias("occurrences"), f.probability.alias("probability"), f.secret.alias("secret")))
    none = F.array().cast("array<struct<value:string,occurrences:bigint,probability:double,secret:boolean>>")
    return out.withColumn("findings", F.coalesce(plain, none)).drop("__key", "__found")


def redacted(docs: DataFrame, findings: DataFrame | None = None, text: str = "text", path: str = "source", least: float = 0.5) -> DataFrame:
    """docs with secrets replaced by MARK, longest first. Texts without any candidate pass by."""
    each = found(docs, [], findings, text, path, least).where("secret")
    order = lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0)
    secrets = written(each.groupBy("__key").agg(F.array_sort(F.collect_set("value"), order).alias("__secrets")), "secrets")
    some = F.coalesce(F.col(text).rlike(CANDIDATE), F.lit(False))
    held = sized_join(docs.where(some).withColumn("__key", _row(docs, text, path)[0]), secrets, "__key", "left")
    clean = F.aggregate(F.coalesce("__secrets", F.array().cast("array<string>")), F.col(text), lambda t, v: F.replace(t, v, F.lit(MARK)))
    return held.withColumn(text, clean).select(*docs.columns).union(docs.where(~some))
