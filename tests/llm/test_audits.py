"""Source divergence, fill-in-the-middle and license scans against brute force in plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from test_llm import LONG, ROWS, documents, prose

lower = lambda s: s.translate({c: c + 32 for c in range(65, 91)})


# -- source divergence


def divergence_by_hand(rows, least=3, top=200):
    docs = [tuple(x or "" for x in r) for r in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t)) for t, _, _ in docs]
    have, total, own = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for (_, lang, source), w in zip(docs, terms, strict=True):
        have[lang].update(set(w))
        total[lang].update(w)
        own[lang, source].update(w)
    out = set()
    for lang in {d[1] for d in docs}:
        kept = [t for t, n in have[lang].items() if n >= least]
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept}  # noqa: B023, E731
        groups = {s: p(own[lang, s]) for g, s in own if g == lang}
        whole = p(total[lang])
        for s, a in groups.items():
            pairs = [(sum((a[t] - b[t]) ** 2 // b[t] for t in kept), o) for o, b in groups.items() if o != s]
            over = [((a[t] - whole[t]) ** 2 // whole[t], t) for t in kept if own[lang, s][t] and a[t] > whole[t]]
            for part, found, most in (("pair", pairs, math.inf), ("term", over, top)):
                for k, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if k <= most:
                        out.add((lang, s, part, item, v, k))
    return out


def groups_of(spark, rows):
    return spark.createDataFrame([(i, *r, 7, True, "x") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n long, kept boolean, term string")


def audited(frame, **how):
    from telemill.llm.divergence import audit

    rows = audit(frame, **how).collect()
    assert rows == [] or set(rows[0].asDict()) == {"lang", "source", "part", "item", "value", "rank"}
    out = {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_divergence(spark, monkeypatch):
    from telemill.llm import divergence

    r = random.Random(5)
    pool = ["The", "the", "été", "ÉTÉ", "x1y", "漢字", "a", "b", "ZZ", "\U0001f600q", *[f"w{chr(97 + i)}" for i in range(20)]]
    rows = [(" ".join(r.choices(pool, k=r.randint(0, 60))), r.choice(["en", "de", None]), r.choice(["s1", "s2", "S3", None, "é"])) for _ in range(60)]
    rows += [(None, "en", "nothing"), ("", "solo", "one"), ("rare words only", "few", "a"), ("other ones", "few", "b"), (rows[0][0], rows[0][1], rows[0][2])] * 2
    want = divergence_by_hand(rows)
    assert any(x[2] == "pair" and x[4] == 0 and x[0] == "few" for x in want) and any(x[0] == "" for x in want)
    monkeypatch.setattr(divergence, "GROUPS", 2)  # several blocks of groups and of terms
    monkeypatch.setattr(divergence, "TERMS", 3)
    assert audited(groups_of(spark, rows)) == want
    assert audited(groups_of(spark, rows), least=1, top=2) == divergence_by_hand(rows, 1, 2)
    assert audited(groups_of(spark, [])) == set()


def test_divergence_counts_long_texts_in_pieces(spark, monkeypatch):
    import pyarrow as pa

    from telemill.llm import divergence

    text = "Ab,cDé " * 500 + "end"
    batch = pa.RecordBatch.from_pydict({"text": [text, text], "lang": ["x", "x"], "source": ["s", "t"]})
    for piece, gathered in ((1, 1), (7, 3), (1 << 20, 1 << 20)):
        monkeypatch.setattr(divergence, "PIECE", piece)
        monkeypatch.setattr(divergence, "GATHERED", gathered)
        got = Counter()
        for b in divergence._counted(iter([batch])):
            for row in b.to_pylist():
                got[row["source"], row["term"]] += row["n"]
                assert row["docs"] == 1
        assert got == {(s, t): n for s in "st" for t, n in (("ab", 500), ("cdé", 500), ("end", 1))}


def test_rates_are_exact_where_products_overflow():
    import numpy as np

    from telemill.llm.divergence import matrix, rates

    r = random.Random(1)
    for _ in range(200):
        total = r.choice([1, 7, 10**6, 8 * 10**15])
        c = r.randint(0, total - 1)
        assert rates(np.array([c]), np.array([total]))[0] == 1 + 10**9 * (c + 1) // total
    p = np.array([[10**9 + 1, 1], [1, 10**9 + 1], [5, 5]])
    assert matrix(p, p).tolist() == [[sum(int(a - b) ** 2 // int(b) for a, b in zip(x, y, strict=True)) for y in p] for x in p]


# -- fill-in-the-middle


def fim_by_hand(doc_id, text, unit=r"(?s)."):
    text = text or ""
    cut = re.findall(unit, text)
    n = len(cut)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, e = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    x, y = sorted((a % (n + 1), b % (n + 1)))
    if not text or "".join(cut) != text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    p, m, s = ("".join(z) for z in (cut[:x], cut[x:y], cut[y:]))
    return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if e % 100 < 20 else (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


FIM_ROWS = [*ROWS, *[(i, prose(i, i % 40)) for i in range(100, 160)], (200, "x<P>y"), (201, "a<S>"), (202, "<M>"), (203, "<P<S<M>"[:5]), (204, "\U0001f600" * 3000), *[(300 + i, "same text\nfor all of them") for i in range(40)]]


def test_fill_in_middle(spark):
    from telemill.llm import fim

    for unit in (fim.POINTS, fim.WORDS, fim.LINES, r"[a-z]+ ?"):  # the last leaves gaps
        rows = [(d, t) for d, t in FIM_ROWS if unit != fim.WORDS or "\x1c" not in (t or "")]
        got = fim.fill_in_middle(documents(spark, rows), unit).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
        seen = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got]
        assert sorted(seen, key=repr) == sorted((fim_by_hand(d, t, unit) for d, t in rows), key=repr), unit
        assert all(r["back"] == r["text"] for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(documents(spark, [])).count() == 0
    assert fim.fill_in_middle(documents(spark, FIM_ROWS), plain=0).where("form <> 'plain'").count() == 0


def test_cuts_lie_in_runs_of_any_length(spark, monkeypatch):
    from telemill.llm import fim

    monkeypatch.setattr(fim, "RUN", 3)
    rows = [(d, t) for d, t in FIM_ROWS if len(t or "") < 5000]
    got = fim.fill_in_middle(documents(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["prefix_chars"], r["output"]) for r in got), key=repr) == sorted(((d, w[3], w[5]) for d, t in rows for w in [fim_by_hand(d, t)]), key=repr)


# -- license scans


def scan_by_hand(rows, looked_up=8, slack=8, share=0.75):
    from telemill.llm.licenses import PHRASES, TEMPLATES

    texts = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or "")) for _, t in rows]
    vocabulary = {w for t in TEMPLATES for w in t.text.split()}
    seen = Counter(w for words in texts for w in set(words) & vocabulary)
    stands = lambda words, phrase: [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
    out = []
    for (d, _), words in zip(rows, texts, strict=True):
        at = {p: stands(words, p.split()) for p in PHRASES}
        places = [i for x in at.values() for i in x]
        base = {PHRASES[p] for p, x in at.items() if x}
        best = {}
        for t in TEMPLATES:
            have, own = set(words), t.text.split()
            if not {w for k in t.keys for w in k.split()} <= have:
                continue
            look = sorted(set(own) & have, key=lambda w: (seen[w], w))[:looked_up]
            bands = defaultdict(set)
            votes = [(w, i - j) for w in look for i, x in enumerate(words) if x == w for j, y in enumerate(own) if y == w]
            votes += [(k, i - stands(own, k.split())[0]) for k in t.keys for i in stands(words, k.split())]
            for what, delta in votes:
                for grid in (0, slack):
                    bands[grid, (delta + grid) // (2 * slack)].add(what)
            for found in bands.values():
                score = len(found & set(look)) / min(looked_up, len(set(own)))
                if set(t.keys) <= found and score >= share:
                    best[t.label] = max(best.get(t.label, 0), score)
        score = 1.0 if base else max(best.values(), default=0.0)
        out.append((d, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(best))), score))
    return out


NOTICE = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
LICENSED = [
    *ROWS, (20, "Released under the MIT License."), (21, "UNDER THE MIT-LICENSE and under the mit license"), (22, "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0."),
    (23, "This work is licensed under the GNU General Public License, version 3."), (24, "This work is licensed under the GNU Lesser General Public License, version 3."), (25, "the general public was told of version 3 of a license, gnu or not, as this work under review is licensed"),
    (26, NOTICE), (27, prose(9, 3000) + " " + NOTICE.upper() + " " + prose(8, 30)), (28, NOTICE.replace("granted, free", "granted free").replace("obtaining a copy", "now and then obtaining one copy")), (29, "without restriction permission " * 40), (30, "cc by\nnc" * 3),
    (31, "version 3 " * 50 + "gnu general public license"), (32, "Under the é mit license under the mit licenses"), (33, " ".join(["This work is licensed under the GNU General Public License, version 3. Under the MIT license."] * 30)), (23, "This work is licensed under the GNU General Public License, version 3."),
    *[(400 + i, "Released under the MIT License. " + LONG[:200]) for i in range(20)],
]


def test_license_scan(spark):
    from telemill.llm.licenses import scan

    got = scan(documents(spark, LICENSED)).collect()
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert sorted((tuple(r[c] for c in names) for r in got), key=repr) == sorted(scan_by_hand(LICENSED), key=repr)
    by_id = {r["doc_id"]: r["labels"] for r in got}
    assert [by_id[i] for i in (20, 22, 23, 24, 25, 26, 27, 28, 29, 8)] == ["mit", "apache-2,cc-by-nc", "gpl-3", "lgpl-3", "", "mit", "mit", "mit", "", ""]
    at = {r["doc_id"]: [(x["label"], x["at"]) for x in r["notices"]] for r in got}
    assert at[27] == [("mit", 3000)] and at[25] == []
    assert scan(documents(spark, [])).count() == 0


def test_license_templates_hold_their_phrases(spark):
    from telemill.llm.licenses import Template, scan

    with pytest.raises(ValueError):
        scan(documents(spark, []), (Template("x", "some words", ("other",)),))
    with pytest.raises(ValueError):
        scan(documents(spark, []), looked_up=32)
    mine = (Template("own", "you may share this", ("share this",)),)
    rows = scan(documents(spark, [(1, "You may share this!"), (2, "share it")]), mine, {"you may": "may"}).orderBy("doc_id").collect()
    assert [(r["labels"], r["base_labels"], r["n_base"]) for r in rows] == [("may,own", "may", 1), ("", "", 0)]


# -- kept pieces of texts


def test_recent_entries_outlive_a_turn():
    from telemill.llm.pretokens import Recent

    made = []
    kept = Recent(lambda k: made.append(k) or (k,), 3)
    for k in [1, 2, 3, 1, 4, 1, 5, 1, 6, 1, 2]:
        assert kept[k] == (k,) and len(kept) <= 3 and len(kept.old) <= 3
    assert made == [1, 2, 3, 4, 5, 6, 2]
