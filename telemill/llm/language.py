"""Language identification by cross-parsing entropy.

For every language, labelled text is kept as a suffix automaton. A text is cut, from left to right, into the longest
phrases that the language's text holds; as one phrase costs a pointer into that text, phrases * log2(its length) bits
are what the text needs in this language, and the language that needs fewest wins. Many texts are walked side by side;
each is parsed whole, in one go.

The automata learn from a bounded sample of labelled rows: at most ROWS rows a language, those of the distinct texts with
the least hashes, and of each a passage of PASSAGE characters at a random place. So their tables fit every worker. All
letters of the labelled text are told apart: the LETTERS most frequent ones have a code each, others several digits.

Edge cases: null texts and texts without a letter are `und` with score 0; with no labelled text at all, so is every
text; with one language, it wins with score 1; ties go to the first language by name; repeated rows each get their
result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS, PASSAGE = 60, 500
#: Letters that have a code each, and the base in which rarer ones of the labelled text are written.
LETTERS, BASE = 94, 32
#: Characters walked at a time, and the number of texts under which they are walked one by one.
AT_ONCE, FEW = 32_000_000, 24


def labelled(docs: DataFrame, learn, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, str]:
    """The sample by language, from the rows for which the condition learn holds."""
    known = docs.where(learn & F.col(lang).isNotNull() & (F.length(text) > 0)).withColumn("__h", F.xxhash64(text))
    counts = {r[lang]: r["count"] for r in known.select(lang, "__h").distinct().groupBy(lang).count().collect()}
    nth = F.pmod("__h", F.lit(1 << 32))
    chosen = F.lit(False)
    for name, n in counts.items():  # six times as many as needed on the average, so that they don't run short
        chosen = chosen | ((F.col(lang) == name) & (nth <= min(1, 6 * ROWS / n) * (1 << 32)))
    place = F.pmod(F.xxhash64(F.lit("place"), F.col("__h")), F.greatest(F.lit(1), F.length(text) - PASSAGE + 1)).cast("int") + 1
    rows = known.where(chosen).select(lang, nth.alias("nth"), F.substring(F.col(text), place, F.lit(PASSAGE)).alias("t")).distinct().collect()
    out: dict[str, list[str]] = {}
    for name, _, t in sorted(rows):
        if len(out.setdefault(name, [])) < ROWS:
            out[name].append(t)
    return {name: "\n".join([*texts, ""]) for name, texts in out.items()}


def automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """The transitions of the suffix automaton of a text, by state; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    longest, link, last = [0], [-1], 0
    for c in codes.tolist():
        new = len(moves)
        moves.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


@lru_cache(1)
def _letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


class Model:
    """Automata of all languages as one table, and the classes of characters."""

    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        letters = [c for c, _ in Counter(c for t in texts.values() for c in t.lower() if c.isalpha()).most_common()]
        self.letters, self.rarer = "".join(sorted(letters[:LETTERS])), "".join(sorted(letters[LETTERS:]))
        self.digits = 1
        while BASE**self.digits < len(self.rarer):
            self.digits += 1
        self.width = len(self.letters) + 2 + BASE * bool(self.rarer)  # no letter, the letters, any letter unknown, digits
        tables, roots, bits, at = [], [], [], 0
        for name in self.languages:
            codes, _ = self.codes(texts[name])
            moves = automaton(codes)
            table = np.full((len(moves), self.width), -1, np.int32)
            for s, m in enumerate(moves):
                if m:
                    table[s, list(m)] = np.fromiter(m.values(), np.int32, len(m)) + at
            tables.append(table)
            roots.append(at)
            bits.append(np.log2(max(2, len(codes))))
            at += len(moves)
        self.end = at  # a state that nothing leads on from: before a text, and behind a letter that the language's text lacks
        self.table = np.concatenate([*tables, np.full((1, self.width), -1, np.int32)])
        self.roots, self.bits = np.array(roots, np.int32), np.array(bits)
        self.first = np.where(self.table[self.roots] < 0, self.end, self.table[self.roots]) if tables else None

    def _classes(self) -> np.ndarray:
        if not hasattr(self, "_of"):
            self._of = _letter_table().astype(np.uint8) * (len(self.letters) + 1)
            for i, c in enumerate(self.letters):
                self._of[ord(c)] = i + 1
            self._rank = np.zeros(0x110000 if self.rarer else 0, np.int32)
            for i, c in enumerate(self.rarer):
                self._of[ord(c)], self._rank[ord(c)] = 255, i
        return self._of

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_of", "_rank")}

    def codes(self, text: str) -> tuple[np.ndarray, bool]:
        """Character classes, runs of other characters than letters being one; whether there is a letter."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        of = self._classes()[points]
        if not len(of):
            return of, False
        keep = of != 0
        keep[1:] |= of[:-1] != 0
        of, points = of[keep], points[keep]
        rare = of == 255
        if rare.any():
            sizes = np.where(rare, self.digits, 1)
            of, places = np.repeat(of, sizes), np.flatnonzero(np.repeat(rare, sizes)).reshape(-1, self.digits)
            ranks = self._rank[points[rare]]
            for i in range(self.digits):
                of[places[:, -1 - i]] = len(self.letters) + 2 + ranks // BASE**i % BASE
        return of, bool(of.any())

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text in each language."""
        sizes = np.array([len(t) for t in texts])
        order = np.argsort(-sizes, kind="stable")
        length, begin = sizes[order], (np.cumsum(sizes) - sizes)[order]
        flat, flat_table, n = np.concatenate(texts), self.table.ravel(), len(self.languages)
        state = np.full((n, len(order)), self.end, np.int32)
        count = np.zeros((n, len(order)), np.int64)
        side_by_side = int(length[FEW - 1]) if len(length) >= FEW else 0
        live = np.searchsorted(-length, -np.arange(side_by_side), "left")  # texts longer than i
        for i in range(side_by_side):
            k = live[i]
            c = flat[begin[:k] + i]
            to = flat_table[state[:, :k] * self.width + c]
            ended = to < 0
            count[:, :k] += ended
            state[:, :k] = np.where(ended, self.first[:, c], to)
        moves, width = memoryview(flat_table), self.width
        for j in np.flatnonzero(length > side_by_side).tolist():
            rest = flat[begin[j] + side_by_side : begin[j] + length[j]].tobytes()
            for k in range(n):
                first, at, more = self.first[k].tolist(), int(state[k, j]), 0
                for c in rest:
                    at = moves[at * width + c]
                    if at < 0:
                        at, more = first[c], more + 1
                count[k, j] += more
        out = np.zeros((len(texts), n), np.int64)
        out[order] = count.T
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        held, rows, total = [], [], 0

        def flush() -> None:
            nonlocal held, rows, total
            if held:
                cost = self.phrases(held) * self.bits
                best = cost.argmin(1)
                for row, b, own in zip(rows, best.tolist(), cost, strict=True):
                    rest = np.delete(own, b)
                    out[row] = (self.languages[b], float(1 - own[b] / rest.min()) if len(rest) else 1.0)
            held, rows, total = [], [], 0

        if self.languages:
            for row, t in enumerate(texts):
                codes, letter = self.codes(t or "")
                if letter:
                    held.append(codes)
                    rows.append(row)
                    total += len(codes)
                    if total > AT_ONCE:
                        flush()
            flush()
        return out


def train(docs: DataFrame, learn, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    return Model(labelled(docs, learn, key, text, lang))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score of each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by ROWS and PASSAGE
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = sent.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [key, "lang_pred", "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")
