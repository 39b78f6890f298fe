"""The operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, piece int, length long, kept boolean, doc long, sig long, digest string, tokens string, n long"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=True):
    full = [(d, t, "en", "src0", len(t or "")) for d, t in rows]
    return spark.createDataFrame([(*r, 7, 7, True, 7, 7, "x", "y", 7) for r in full], EXTRA) if extra else spark.createDataFrame(full, DOC)


def prose(seed, n, pool=400):
    r = random.Random(seed)
    words = ["w" + "".join(chr(97 + int(c)) for c in str(i)) for i in range(pool)]  # no digits
    return " ".join(r.choice(words) for _ in range(n))


BASE = prose(1, 120, 5000)
EDITED = BASE.replace(BASE.split()[60], "other", 1)
LONG = prose(2, 30_000, 3000)
ROWS = [(1, BASE), (2, BASE.upper()), (3, EDITED), (4, None), (5, ""), (6, "a b"), (7, "A  b"), (8, LONG), (9, LONG + " end"), (9, LONG + " end"), (10, "one two three four five six seven"), (11, "\u00e9\u6f22 \U0001f600 x\x1cy \u00a0z"), (None, BASE), (12, " \n\t ")]


# -- packing


def test_packing(spark):
    import public_tokenizers as P

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    from telemill.llm.packing import best_fit

    mark = "<|endoftext|>"
    rows = [*ROWS, (20, f"one{mark}two {mark} \n{mark}{mark}  three<|endoftext|"), (21, mark), (22, f"a{mark}" * 700)]
    got = best_fit(documents(spark, rows), P.path("byte_bpe_50k.json"), P.PATTERN, ids=True).collect()
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        while at < len(ids):
            n = (len(ids) - at) % 1024 or 1024
            data = b"".join(i.to_bytes(4, "little") for i in ids[at : at + n])
            want.append((d, at, n, zlib.crc32(data), data))
            at += n
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in got), key=key) == sorted(want, key=key)
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(held) <= -(-sum(w[2] for w in want) // 1024) + 1 and any(b"\x50\xc4\0\0" in w[4] for w in want)
    assert best_fit(documents(spark, []), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_sweep_is_best_fit_decreasing():
    from telemill.llm.packing import sweep

    r = random.Random(3)
    for _ in range(60):
        sizes = [min(20, int(r.paretovariate(0.7))) for _ in range(r.randint(0, 200))]
        gaps = []
        for s in sorted(sizes, reverse=True):
            fit = [g for g in gaps if g >= s]
            if fit:
                gaps.remove(min(fit))
            gaps.append((min(fit) if fit else 20) - s)
        counts = {s: sizes.count(s) for s in sizes}
        held, ranks = {}, {}
        for size, first, n, sequence, offset, fit in sweep(counts, 20):
            for k in range(n):
                held.setdefault(sequence + k // fit, []).append((offset + k % fit * size, size))
                ranks.setdefault(size, []).append(first + k)
        assert {s: sorted(x) for s, x in ranks.items()} == {s: list(range(c)) for s, c in counts.items()}
        assert len(held) == len(gaps)
        for places in held.values():
            at = 0
            for offset, n in sorted(places):
                assert offset == at
                at += n
            assert at <= 20


# -- byte-level BPE


def test_bpe_makes_states_for_what_recurs():
    """Words seen once make no states, and their tokens are the same when transitions are made afterwards."""
    import public_tokenizers as P

    from telemill.llm.bpe import Codec

    r = random.Random(8)
    words = ["".join(r.choice("abcdeéßжx") for _ in range(r.randint(8, 14))) for _ in range(300)]
    c = Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    first = c.encoder.word(words[0].encode())
    assert len(c.encoder.states) == 1
    seen = [[c.encoder.word(w.encode()) for w in words] for _ in range(16)]
    assert all(x == seen[0] for x in seen) and seen[0][0] == first
    assert all(b"".join(c.encoder.tokens[i] for i in ids) == w.encode() for w, ids in zip(words, seen[0]))
    assert all(list(ids) == [c.encoder.ranks[t] for t in c.encoder._merged(w.encode())] for w, ids in zip(words, seen[0]))
    made = len(c.encoder.states)
    assert made > 300 and [c.encoder.word(w.encode()) for w in words] == seen[0] and len(c.encoder.states) == made


def test_bpe_new_words_run_through_known_states():
    """Words of the same syllables, each of them new, need next to no states that other words haven't made."""
    import public_tokenizers as P
    import tiktoken

    from telemill.llm.bpe import Codec, read_ranks

    path, r = P.path("byte_bpe_multi_50k.tiktoken"), random.Random(9)
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    syllables = ["th", "an", "eux", "ß", "heit", "oi", "ge", "é", "ción", "nd"]
    words = list({" " + "".join(r.choice(syllables) for _ in range(r.randint(4, 9))) for _ in range(6000)})
    c = Codec(path, P.PATTERN).encoder
    for w in words[:4000]:
        c.word(w.encode())
    made = len(c.states)
    assert made < 2000
    assert all(list(c.word(w.encode())) == e.encode_ordinary(w) for w in words)
    assert len(c.states) < 1.3 * made
    dead = ["".join(r.choice("ab\u0301é=- '") for _ in range(r.randint(1, 30))).encode() for _ in range(3000)]  # steps are taken back
    assert all([c.tokens[i] for i in c.word(d)] == (c._merged(d) if d not in c.ranks else [d]) for d in dead)


def test_bpe_equals_the_library(spark):
    import public_tokenizers as P
    import tiktoken

    from telemill.llm.bpe import Codec, coded, read_ranks

    path = P.path("byte_bpe_multi_50k.tiktoken")
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    c, r = Codec(path, P.PATTERN), random.Random(4)
    pool = "aabbcde  \n\t\r\x1c\x85\xa0 éèßñ漢字か😀👍🏽́'sS'll12٣½-_=!THEing"
    for text in ["".join(r.choice(pool) for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["a" * 3000, "é" * 999, "=" * 700, " " * 50 + "x"]:
        ids = c.encode(text)[0]
        assert ids == e.encode_ordinary(text)
        assert c.decoder.text(ids) == text == "".join(c.decoder.stream(ids))
    for _ in range(500):  # ids that no text gives
        ids = [r.randrange(256) for _ in range(r.randint(1, 12))]
        data = b"".join(c.decoder.pieces[i] for i in ids)
        assert "".join(c.decoder.stream(ids)) == data.decode("utf-8", "replace") == c.decoder.text(ids)
    got = coded(documents(spark, ROWS), path, P.PATTERN).collect()
    want = sorted((repr(d), len(e.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in ROWS)
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["decoded_sha256"]) for r in got) == want
    assert got[3]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert coded(documents(spark, []), path, P.PATTERN).count() == 0


# -- Jaccard join


def brute(rows):
    from telemill.llm.jaccard import exact, linked

    sets = [(d, exact(t)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if linked(a, b):
                x, y = root(d), root(e)
                parent[max(x, y)] = min(x, y)
    return sorted((d, len(s), root(d)) for d, s in sets)


def test_jaccard_edges(spark):
    from telemill.llm.jaccard import components

    got = components(documents(spark, ROWS))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.where("doc_id is not null").collect()) == brute(ROWS)
    lone = got.where("doc_id is null").first()
    assert lone["component_id"] is None and lone["n_shingles"] == 116
    assert components(documents(spark, [])).count() == 0
    assert {r["component_id"] for r in components(documents(spark, [(1, None), (2, "")])).collect()} == {1, 2}


@pytest.mark.parametrize("light", [1, 4])
def test_jaccard_near_the_border(spark, light):
    """Short and longer texts about the threshold, with a passage that most of them share, and all stages at work."""
    from telemill.llm.jaccard import components

    r, rows = random.Random(5), []
    shared = prose(6, 30, 900).split()
    for base in range(14):
        words = [f"b{base}x{r.randrange(10**6)}" for _ in range(r.choice([3, 5, 8, 12, 30, 60]))] + (shared if base % 3 else [])
        for _ in range(9):
            w = list(words)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = f"e{r.randrange(4)}"
            rows.append((len(rows), " ".join(w)))
    got = components(documents(spark, rows, False), light=light)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_neighbourhoods_of_one_document_alone_are_not_joined(spark):
    """Only rows whose hash two classes share pass the join, one each; what bands are worth is as counted row by row."""
    from collections import Counter, defaultdict

    from telemill.llm.jaccard import LIGHT, MARKS, SPARSE, Bands, index, neighbourhoods, shared_neighbourhoods, unserved

    r, rows = random.Random(6), []
    words = [f"w{i}" for i in range(60)]
    for d in range(24):  # ever more words of their own behind those that all have
        rows.append((d, " ".join(words + [f"d{d}x{r.randrange(10**6)}" for _ in range(d)])))
    docs = spark.createDataFrame(rows, "doc long, text string")
    have = [x for x in index(docs, Bands()).collect() if x.sig > SPARSE + MARKS]
    often, skipped = Counter(x.sig for x in have), defaultdict(list)
    for x in have:
        skipped[x.doc] += [x.sig] * (often[x.sig] > LIGHT)
    asked = spark.createDataFrame([(d, d // 2, t, skipped[d]) for d, t in rows], "doc long, c long, text string, skipped array<long>")
    short = neighbourhoods(asked, Bands()).cache()
    every, by = short.collect(), defaultdict(list)
    for x in every:
        by[x.sig].append(x)
    segments, found = defaultdict(list), []
    for x in every:
        segments[x.doc, x.band, x.need, x.segment].append(x)
    for light in (LIGHT, 99):
        heavy = {k: len({x.doc for x in v}) > light for k, v in by.items() if len({x.doc for x in v}) > 1 and len({x.c for x in v}) > 1 and any(x.full for x in v)}
        near = shared_neighbourhoods(short, light)
        got = near.collect()
        assert sorted((x.sig, x.doc, x.segment, x.full, x.heavy) for x in got) == sorted((x.sig, x.doc, x.segment, x.full, heavy[x.sig]) for x in every if x.sig in heavy)
        assert 0 < len(got) < len(every)
        worth = Counter()
        for k, v in segments.items():
            hot = [x for x in v if heavy.get(x.sig)]
            worth[k[:3]] += 0 if any(x.full for x in hot) else 1 if hot or v[0].lone else 2
        found.append({doc for (doc, _, need), w in worth.items() if w < need})
        assert {x.doc for x in unserved(short, near).collect()} == found[-1]
    assert found[1] < found[0]


def test_last_stages_lose_no_link_and_compare_sizes_and_places(spark):
    """Texts of mostly common words, ids with several texts and equal ones: elements to pairs keep every link; sets without
    enough common words go first, and pairs of sizes and places don't grow with the number of texts."""
    from telemill.llm.jaccard import MARKS, SPARSE, Bands, _meeting, elements, exact, index, linked, mostly_shared, places, prefixes

    for seed in range(2):
        r, shared, rows = random.Random(seed), [f"s{i}" for i in range(14)], []
        for d in range(14):
            w = list(shared)
            for _ in range(r.randint(0, 2)):
                w.insert(r.randrange(len(w)), f"d{d}x{r.randrange(99)}") if r.random() < 0.5 else w.pop(r.randrange(len(w)))
            rows.append((d, " ".join(w)))
            if d % 2:
                rows.append((d, " ".join(w).upper() if d % 4 == 1 else " ".join(f"q{d}x{i}" for i in range(30))))
        skipped = [x.sig for x in index(spark.createDataFrame(rows, "doc long, text string"), Bands()).collect() if x.sig > SPARSE + MARKS]
        asked = spark.createDataFrame([(d, d, t, skipped) for d, t in rows], "doc long, c long, text string, skipped array<long>")
        every = elements(asked, Bands()).cache()
        sets = {(d, frozenset(exact(t))) for d, t in rows}
        assert every.count() == sum(len(x) for _, x in sets)
        left = mostly_shared(every)
        many = {(d, x) for d, x in sets if 100 * len({g for g in x if any(g in y for e, y in sets if e != d)}) >= 75 * len(x)}
        assert left.select("doc", "own").distinct().count() == len(many) < len(sets)
        got = {(x.a, x.b) for x in _meeting(prefixes(left), 75).collect()}
        want = {(a, b) for a, x in sets for b, y in sets if a < b and linked(x, y)}
        assert want and want <= got
    # the same sizes and places, held by ever more documents
    one = prefixes(left)
    more = one.unionByName(one.withColumns({"doc": F.col("doc") + 100, "c": F.col("c") + 100})).unionByName(one.withColumns({"doc": F.col("doc") + 200, "c": F.col("c") + 200}))
    twice = one.unionByName(one.withColumns({"doc": F.col("doc") + 100, "c": F.col("c") + 100}))
    assert places(more, 75).count() == places(twice, 75).count() > 0


def test_jaccard_of_ids_with_several_texts(spark):
    """Texts of mostly common words under few ids, all stages at work."""
    from telemill.llm.jaccard import components

    r, rows, shared = random.Random(3), [], [f"s{i}" for i in range(16)]
    for d in range(60):
        for _ in range(r.choice([1, 1, 2])):
            w = list(shared) + [f"d{d}x{i}" for i in range(r.choice([0, 1, 2, 3, 4, 20]))]
            for _ in range(r.randint(0, 3)):
                w.insert(r.randrange(len(w)), f"e{r.randrange(9)}") if r.random() < 0.5 else w.pop(r.randrange(len(w)))
            rows.append((d, " ".join(w)))
    got = components(documents(spark, rows, False), light=1)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_distance_bounds():
    from telemill.llm.jaccard import Bands

    b = Bands()
    for x in range(1, 120):
        for y in range(x, 160):
            least = -(-75 * (x + y) // 175)  # of the intersection
            if least > x:
                continue
            assert y <= b.most(x)
            roles = {k: (m, h) for k, m, h in b.roles(x)}
            both = [(k, m, h) for k, m, h in b.roles(y) if k in roles]
            assert any(m > x + y - 2 * least and h >= x + y - 2 * least and roles[k][1] >= x + y - 2 * least for k, m, h in both)


def varied(seed, n, least=1, most=400):
    """Sets of shingles as texts, every other one with some words of the one before replaced, dropped or doubled."""
    r, out = random.Random(seed), []
    for i in range(n):
        if i % 2:
            w = out[-1].split()
            for _ in range(r.randint(0, 1 + len(w) // 40)):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[f"e{r.randrange(9)}"], [], [w[k]] * 2])
            out.append(" ".join(w))
        else:
            out.append(" ".join(f"w{i}x{r.randrange(10**6)}" for _ in range(r.randint(least, most))))
    return out


def test_index_holds_few_rows_a_shingle(spark):
    """At most 0.6 rows a shingle: 0.75 before only leading segments were indexed and bands were wider."""
    from telemill.llm.jaccard import Bands, exact, index

    r = random.Random(8)
    texts = [" ".join(f"w{i}x{r.randrange(10**6)}" for _ in range(int(60 * 1.06**i))) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    total, rows = sum(len(exact(t)) for t in texts), index(docs, Bands()).count()
    assert 0.3 * total < rows < 0.6 * total


def test_leading_segments_meet_whatever_is_skipped():
    """Linked sets have an indexed segment in common that isn't skipped, if one of them isn't short; alone and among
    others, a set has the same segments."""
    import numpy as np
    import pyarrow as pa

    from telemill.llm.jaccard import MARKS, SPARSE, Bands, _short, exact, leading, linked, shingle_sets, shingles

    texts, bands, n = varied(4, 1200), Bands(), 0
    sets = list(shingle_sets(pa.array(texts)))
    assert [len(s) for s in sets] == [len(exact(t)) for t in texts]
    found = []
    for s in sets:
        sig, _ = leading(s, np.array([len(s)]), bands)
        found.append({x for x in sig.tolist() if x > SPARSE + MARKS})
    at, every = 0, [set() for _ in texts]
    for flat, size in shingles(pa.array(texts)):
        for x, i in zip(*(v.tolist() for v in leading(flat, size, bands)), strict=True):
            every[at + i] |= {x} - set(range(SPARSE, SPARSE + MARKS + 1))
        at += len(size)
    assert found == every and at == len(texts)
    r, served = random.Random(5), 0
    for i in range(0, len(texts), 2):
        if linked(exact(texts[i]), exact(texts[i + 1])):
            n += 1
            common = found[i] & found[i + 1]
            assert common
            for share in (0.1, 0.5, 0.9):
                skipped = r.sample(sorted(common), int(share * len(common)))
                short = [{x[0] for x in _short(s, skipped, bands)} for s in sets[i : i + 2]]
                roles = [{x[0] for x in bands.roles(len(s))} for s in sets[i : i + 2]]
                if (roles[0] & roles[1]) - (short[0] & short[1]):
                    served += 1
                    assert common - set(skipped)
    assert n > 100 and served > 100


# -- WARC


def test_warc(spark):
    from telemill.llm import warc

    rows = [(5, "http://a/", "same"), (3, "http://b/\r\nx", "same"), (7, None, None), (2, "u", ""), (4, "v", "é" * 5000), (4, "v", "é" * 5000)]
    pages = spark.createDataFrame([(p, u, h, "x", 1) for p, u, h in rows], "page_id long, url string, html string, record_type string, payload_bytes long")
    folder = warc.archive(pages)
    got = warc.read(spark, folder)
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got.collect()) == [(2, "response", None), (3, "response", None), (4, "response", None), (4, "response", None), (5, "revisit", 3), (7, "revisit", 2)]
    for r in got.collect():
        body = {p: (h or "").encode() for p, _, h in rows}[r["page_id"]]
        assert (r["payload_bytes"], r["actual_digest"], r["payload_digest"]) == (len(body), warc.digest(body), warc.digest(body))
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == body
    some = got.where("record_type = 'revisit' and refers_to in (3, 9)")
    assert [r["page_id"] for r in some.select("page_id").collect()] == [5]
    assert warc.read(spark, warc.archive(pages.limit(0))).count() == 0
    assert warc.read(spark, warc.archive(pages, 3)).where("record_type = 'revisit'").count() == 1


def test_warc_query(spark, tmp_path):
    """The registered query against a brute-force version, with both kinds of joins."""
    from telemill.llm.queries import op3_warc
    from telemill.llm.warc import digest
    from telemill.plans import lineage

    rows = [(i, f"http://h/{i}", [None, "", "same", "other é", f"own {i}"][i % 5]) for i in range(40)] + [(3, "twice", "other é"), (3, "again", "x")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    want = []
    for p, _, h in rows:
        body = (h or "").encode()
        first = min(q for q, _, g in rows if (g or "").encode() == body)
        want.append((p, len(body), digest(body), "revisit" if p > first else "response", first if p > first else None))
    for limit in (lineage.BROADCAST_ROWS, -1):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(lineage, "BROADCAST_ROWS", limit)
            assert sorted(map(tuple, op3_warc(spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)


def test_warc_passes_over_payloads():
    """Records that a filter rules out are jumped over: no byte of their payload is inflated, and few are read."""
    from telemill.llm import warc

    data = warc.member(warc.record(1, "u", "response", os.urandom(8 << 20), "D", 8 << 20, None))
    assert int.from_bytes(data[16:20], "little") == len(data)
    data += warc.member(warc.record(2, "u", "revisit", b"", "D", 8 << 20, 1))

    class File:
        read = 0

        def size(self):
            return len(data)

        def read_at(self, n, at):
            self.read += n
            return data[at : at + n]

    file = File()
    got = list(warc.blocks(warc.Inflated(warc.Ahead(file), 0), len(data), lambda x: x["warc-type"] == "revisit"))
    assert [(x["warc-type"], b is None) for x, b in got] == [("response", True), ("revisit", False)] and file.read <= 3 * warc.BLOCK


@pytest.mark.parametrize("size", [10, 9 << 20])
def test_warc_members_of_several_records(size):
    """A member of known length may hold more records: whatever is wanted of them, none is lost, nor if the archive is cut."""
    import struct
    import zlib

    from telemill.llm import warc

    class File:
        def __init__(self, data):
            self.data = data

        def size(self):
            return len(self.data)

        def read_at(self, n, at):
            return self.data[at : at + n]

    own = warc.member(b"")

    def member(*records):
        made = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = b"".join(records)
        inner = made.compress(body) + made.flush() + struct.pack("<II", zlib.crc32(body), len(body))
        return own[:16] + struct.pack("<I", 20 + len(inner)) + inner

    one = lambda i: warc.record(i, "u", "response", os.urandom(size), "D", size, None)
    data = member(one(1), one(2)) + member(one(3)) + member(one(4).rstrip(b"\r\n")) + member(one(5), one(6), one(7))
    for wanted in (set(), {1}, {2}, {6}, {7}, {1, 3, 5}, set(range(1, 8))):
        number = lambda x: int(re.search(r"\d+", x["warc-record-id"])[0])
        got = [(number(x), b and len(b) >= size) for x, b in warc.blocks(warc.Inflated(warc.Ahead(File(data)), 0), len(data), lambda x: number(x) in wanted)]  # noqa: B023
        assert got == [(i, True if i in wanted else None) for i in range(1, 8)]
    with pytest.raises(ValueError, match="ends within"):
        list(warc.blocks(warc.Inflated(warc.Ahead(File(data[:-3])), 0), len(data) - 3, lambda x: True))


def _foreign():
    """Records as other tools write them."""
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    body = "<p>é</p>".encode() * 5000
    heads = [
        ("warcinfo", [("WARC-Filename", "x")], b"software: y\r\n"),
        ("response", [("warc-target-uri", "<http://a/>"), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", "sha1:ABC")], http + body),
        ("request", [("WARC-Target-URI", "http://a/"), ("Content-Type", "application/http;msgtype=request")], b"GET / HTTP/1.1\r\n\r\n"),
        ("revisit", [("WARC-Target-URI", "http://b/"), ("WARC-Refers-To", "<urn:uuid:1>")], http),
        ("resource", [("WARC-Target-URI", "http://c/"), ("X-Long", "one\r\n two")], b"\r\n\r\nraw\r\n\r\n"),
        ("metadata", [], b""),
    ]
    out = []
    for i, (kind, more, block) in enumerate(heads):
        lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID:<urn:uuid:{i}>", *[f"{k}: {v}" for k, v in more], f"CONTENT-LENGTH:  {len(block)}"]
        out.append("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")
    return out, body


@pytest.mark.parametrize("form", ["plain", "members", "one member"])
def test_warc_from_elsewhere(spark, tmp_path, form):
    import gzip

    from telemill.llm import warc

    records, body = _foreign()
    name = "a.warc" if form == "plain" else "a.warc.gz"
    data = b"".join(records) if form == "plain" else b"".join(map(gzip.compress, records)) if form == "members" else gzip.compress(b"".join(records))
    for sub in ("", "deep/"):
        (tmp_path / sub).mkdir(exist_ok=True)
        (tmp_path / sub / name).write_bytes(data)
    got = sorted((r["record_id"], r["record_type"], r["url"], r["page_id"], r["payload_bytes"], r["refers_to_id"]) for r in warc.read(spark, str(tmp_path)).collect())
    want = [("<urn:uuid:0>", "warcinfo", None, None, 13, None), ("<urn:uuid:1>", "response", "http://a/", None, len(body), None), ("<urn:uuid:2>", "request", "http://a/", None, 0, None), ("<urn:uuid:3>", "revisit", "http://b/", None, None, "<urn:uuid:1>"), ("<urn:uuid:4>", "resource", "http://c/", None, 11, None), ("<urn:uuid:5>", "metadata", None, None, 0, None)]
    assert got == sorted(want * 2)
    one = warc.read(spark, str(tmp_path / name))
    assert [bytes(r["payload"]) for r in one.where("record_type = 'response'").collect()] == [body]
    assert [r["url"] for r in one.where("record_type in ('resource', 'x')").select("url").collect()] == ["http://c/"]


def test_warc_fails_loudly(spark, tmp_path):
    from telemill.llm import warc

    (tmp_path / "empty").mkdir()
    with pytest.raises(Exception, match="no manifest and no archives"):
        warc.read(spark, str(tmp_path / "empty")).count()
    (tmp_path / "bad.warc").write_bytes(b"HTTP/1.1 200 OK\r\n\r\n")
    with pytest.raises(Exception, match="not a WARC record"):
        warc.read(spark, str(tmp_path / "bad.warc")).count()
    odd = ["http://b/\r\nx", " http://c/ ", "http://d/%0Dé", None]
    pages = spark.createDataFrame([(i, u, f"h{i}") for i, u in enumerate(odd)], "page_id long, url string, html string")
    assert {r["page_id"]: r["url"] for r in warc.read(spark, warc.archive(pages)).collect()} == dict(enumerate(odd))


def test_warc_split_files(spark, monkeypatch):
    from telemill.llm import warc

    monkeypatch.setattr(warc, "SPLIT", 1)
    writer, rows = warc.WarcWriter(warc.new_path(spark, "warc")), [(i, f"u{i}", "response", b"x" * i, "D", i, None) for i in range(9)]
    warc.make_folder(writer.folder)
    import pyarrow as pa

    names = ["page_id", "url", "record_type", "payload", "payload_digest", "payload_bytes", "refers_to"]
    writer.commit([writer.write(iter([pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])]))])
    reader = warc.WarcReader(writer.folder, ["page_id", "payload_bytes"])
    spans = reader.partitions()
    assert len(spans) > 3
    assert sorted(x for s in spans for b in reader.read(s) for x in zip(*b.to_pydict().values(), strict=True)) == [(i, i) for i in range(9)]


# -- lines


def test_lines(spark):
    from telemill.llm.lines import line_dedup

    a, b = "All rights reserved by the authors 2019", "a passage of words that comes again and again in texts"
    rows = [(1, f"{a}\nown line one\n{b}"), (2, f"{a.replace('2019', '2024')}\nfoo bar\n{b.replace('texts', 'books')}"), (3, f"{b}\n{b}"), (4, None), (5, ""), (6, "bar foo"), (6, "bar foo"), (None, f"{a}\nlast"), (7, "x\n" + "\n".join(prose(i, 12) for i in range(300)))]
    got = {(r["doc_id"], r["text"]): (r["n_lines"], r["n_dropped"]) for r in line_dedup(documents(spark, rows)).collect()}
    assert got == {(1, rows[0][1]): (3, 0), (2, "foo bar"): (3, 2), (3, ""): (2, 2), (4, None): (0, 0), (5, ""): (1, 0), (6, "bar foo"): (1, 0), (None, "last"): (2, 1), (7, rows[8][1]): (301, 0)}
    assert line_dedup(documents(spark, [])).count() == 0


def _left(spark, texts):
    """The text that line dedup leaves of each document, by number."""
    from telemill.llm.lines import line_dedup

    return {r["doc_id"]: r["text"] for r in line_dedup(documents(spark, list(enumerate(texts)), False)).collect()}


def test_lines_short_and_numeric(spark):
    """Short lines, rows of numbers and log lines of mostly numbers go where they recur; other rows of numbers stay."""
    log = "2024 10 11 12 session 13 14 closed"
    texts = [f"All rights reserved.\n{log}\n1 2 3 4 5 6\nown{chr(97 + i)}\n7 8 {i} 9 10 11" for i in range(20)]
    got = _left(spark, texts)
    assert got[0] == texts[0]
    assert [got[i] for i in range(1, 20)] == [f"own{chr(97 + i)}\n7 8 {i} 9 10 11" for i in range(1, 20)]
    assert _left(spark, ["} \t\n\n", "}\n\n"]) == {0: "} \t\n\n", 1: "\n"}  # white space doesn't tell lines apart, and lines without a word stay


def test_lines_templates_of_one_leaf(spark):
    """Templates that share their length and leading words are told apart, whatever else their leaf holds."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(9))
    visit = lambda: f"we thank you for your visit to {word()} and the shop of {word()} today"
    delay = lambda: f"we thank you for {word()} patience while our team in {word()} mends the lines"
    other = lambda: "we thank you for " + " ".join(word() for _ in range(10))
    kinds = [visit] * 30 + [delay] * 20 + [other] * 40
    texts = [f"{k()}\n{word()}" for k in kinds]
    got = _left(spark, texts)
    kept = [i for i in range(len(texts)) if got[i] == texts[i]]
    assert kept == [0, 30, *range(50, 90)]
    assert all(got[i] == texts[i].split("\n")[1] for i in range(90) if i not in kept)


def test_lines_clashing_columns(spark):
    from telemill.llm.lines import line_dedup

    rows = spark.createDataFrame([(1, "a b c", 5, "k", "t", "d"), (2, "a b c", 6, "l", "u", "e")], "doc_id long, text string, n_lines long, __key string, __t string, __drop string")
    got = line_dedup(rows)
    assert got.columns == ["doc_id", "text", "__key", "__t", "__drop", "n_lines", "n_dropped"]
    assert sorted(map(tuple, got.collect())) == [(1, "a b c", "k", "t", "d", 1, 0), (2, "", "l", "u", "e", 1, 1)]


@pytest.mark.parametrize("rows", [500_000, -1])
def test_lines_equal_the_sql(spark, tmp_path, monkeypatch, rows):
    """Both kinds of joins, against the query's SQL."""
    import duckdb

    from telemill.llm.lines import ORACLE
    from telemill.llm.queries import op4_line_dedup
    from telemill.plans import lineage

    monkeypatch.setattr(lineage, "BROADCAST_ROWS", rows)
    r = random.Random(12)
    some = [prose(i, 14, 60) for i in range(12)]
    change = lambda x: " ".join(w if r.random() > 0.1 else f"n{r.randrange(30)}" for w in x.split(" "))
    texts = ["\n".join(change(r.choice(some)) if r.random() < 0.7 else prose(r.randrange(10**6), r.randrange(12), 8) for _ in range(8)) for _ in range(60)]
    documents(spark, [(i, t) for i, t in enumerate(texts)] + [(99, None), (98, "")], False).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, op4_line_dedup(spark, str(tmp_path)).collect())) == sorted(con.sql(ORACLE).fetchall())


# -- media


def test_media(spark):
    from telemill.llm.media import payload, store, with_features, with_metadata

    rows = store(documents(spark, ROWS))
    got = {(r["doc_id"], r["payload_sha256"]): r for r in with_features(rows).collect()}
    for d, t in ROWS:
        p = payload(t)
        r = got[d, hashlib.sha256(p).hexdigest()]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len((t or "").encode()), len(p), zlib.crc32(p[-32:]))
    assert rows.count() == len(ROWS) and rows.select("digest").distinct().count() == len({payload(t) for _, t in ROWS})
    assert {(r["width"], r["height"]) for r in with_metadata(rows.where("doc_id in (5, 1)")).collect()} == {(576, 1), (576, -(-len(BASE) // 576))}
    assert store(documents(spark, [])).count() == 0


def test_media_query_equals_brute_force(spark, tmp_path):
    """All columns of the query, recomputed from the texts; lengths about whole rows, and many copies of one text."""
    from telemill.llm.media import ROW, described, encode, payload
    from telemill.llm.queries import op5_media_columns

    texts = ["", None, "x" * ROW, "x" * (ROW - 1), "x" * (ROW + 1), "é" * ROW, *["same"] * 40, *[prose(i, 300) for i in range(9)]]
    documents(spark, list(enumerate(texts)), False).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in op5_media_columns(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        data, r = (t or "").encode(), got[i]
        p = data + b"\xff" * (-len(data) % ROW if data else ROW)
        image = encode(p)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])) and p == payload(t)
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(image), hashlib.sha256(image).hexdigest(), described(image)["feature"])
        assert (r["width"], r["height"], r["depth"]) == (ROW, len(p) // ROW, 8)
        bins = [0] * 16
        for b in p:
            bins[b >> 4] += 1
        assert r["feature"].split(" bins ")[1] == ",".join(map(str, bins)) and r["feature"].startswith(f"{ROW}x{len(p) // ROW} mean {sum(p) * 1000 // len(p)} ")


def test_media_query_reads_headers(spark, tmp_path):
    from telemill.llm.media import ROW, payload
    from telemill.llm.queries import op5_media_columns

    documents(spark, ROWS, False).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((repr(r["doc_id"]), r["payload_sha256"], r["width"], r["height"], r["depth"]) for r in op5_media_columns(spark, str(tmp_path)).collect())
    assert got == sorted((repr(d), hashlib.sha256(payload(t)).hexdigest(), ROW, len(payload(t)) // ROW, 8) for d, t in ROWS)


# -- URLs


def test_urls(spark):
    from telemill.llm.urls import Segmenter, judge

    rows = [(1, "http://A.Example.net/en/x?q#f"), (2, "https://example.net/de"), (3, "http://b.example.com/de/1"), (4, "http://notnet/"), (5, "x.org/fr/"), (6, None), (7, "http://q.org/fr/?a"), (8, "http://cheap-pills.example.com"), (9, "a://b://c/d"), (10, "http://EXAMPLE.NET?x"), (11, "http://" + "a" * 5000 + ".example.org/"), (1, "http://A.Example.net/en/x?q#f")]
    pages = spark.createDataFrame([(p, u, "<title>cheap pills</title>" if p % 2 else None, "h") for p, u in rows], "page_id long, url string, html string, host string")
    got = {r["page_id"]: (r["host"][:20], r["path"], r["rule"], r["verdict"]) for r in judge(pages, known={"cheap": "block", "pills": "block"}).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2] == ("example.net", "/de", "net/", "block") and got[3][2:] == ("example.com/de/", "block")
    assert got[4][2] is None and got[5][:3] == ("", "", None) and got[6][:3] == ("", "", None) and got[7][2:] == ("org/fr/", "allow")
    assert got[8][2:] == (None, "block") and got[9][:2] == ("b:", "//c/d") and got[10][:3] == ("example.net", "", None)
    assert judge(pages.limit(0)).count() == 0
    assert Segmenter({"cheap": 5, "pills": 5, "che": 1}).words["cheappills"] == ("cheap", "pills")


def test_urls_segment_hosts(spark):
    """A run-together host is cut whatever the size of the table, and meets the words that are known."""
    from telemill.llm.urls import Segmenter, judge

    prose = "<html><head><title>Offers</title><style>p{}</style></head><body><p>cheap offers of pills, and the <b>together</b> of a wiki</p></body></html>"
    hosts = ["cheappills.x.com", "cheappills.com", "cheappills.x.com", "wikilibrary.x.com", "wikilibrary.io", "together.x.com"]
    rows = [(i, f"http://{h}/", prose) for i, h in enumerate(hosts)] + [(20 + i, f"http://q{i}.org/fr/", prose) for i in range(3)] + [(30, "http://z.example.com/de/", prose)]
    known = {"cheap": "block", "pills": "block", "wiki": "allow", "library": "allow"}
    got = {r["page_id"]: r["verdict"] for r in judge(spark.createDataFrame(rows, "page_id long, url string, html string"), known=known).collect()}
    assert [got[i] for i in range(5)] == ["block", "block", "block", "allow", "allow"]
    assert Segmenter({"together": 3, "to": 50, "get": 9, "her": 9}).words["together"] == ("together",)
    assert Segmenter({"cheappills": 1, "cheap": 900, "pills": 900}).words["cheappills"] == ("cheap", "pills")


def _cuts(name):
    """All ways to cut a name."""
    for k in range(1, len(name)):
        for rest in _cuts(name[k:]):
            yield (name[:k], *rest)
    yield (name,)


def test_urls_equal_brute_force(spark, tmp_path):
    """The registered query against plain Python: all cuts of every name, and naive Bayes over counted words. Verdicts of
    unruled hosts rest on words inside run-together names, with no words known beforehand."""
    from collections import Counter
    from math import log

    from telemill.llm.queries import op6_url_filters
    from telemill.llm.urls import UNIT, Segmenter

    r = random.Random(3)
    bad, good = ["cheap", "pills", "spin", "win"], ["wiki", "books", "maps", "tea"]
    join = lambda words: "".join(r.choice(words) for _ in range(2))
    html = "<title>Wiki Books</title><script>var pillscheap</script><body>cheap pills spin to win <b>maps</b> of tea &amp; books</body>"
    urls = [(f"http://{join(bad)}.net/a", "net/", "block") for _ in range(30)] + [(f"http://{join(good)}.org/fr/{r.choice(good)}", "org/fr/", "allow") for _ in range(30)]
    urls += [(f"http://{join(bad)}.io/", None, "block") for _ in range(9)] + [(f"http://www.{join(good)}.de/x/{i}", None, "allow") for i in range(9)] + [(None, None, None), ("http://", None, None), ("http://[::1]:80/", None, None), ("http://u:p@häuser.de:8080/ä", None, None)]
    spark.createDataFrame([(i, u, html if i % 3 else None) for i, (u, _, _) in enumerate(urls)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {x["page_id"]: x for x in op6_url_filters(spark, str(tmp_path)).collect()}

    said = "wiki books  cheap pills spin to win maps of tea books".split() * sum(i % 3 > 0 for i in range(len(urls)))
    counts, total = Counter(said), len(said)
    cost = lambda w: log(total) - log(counts[w]) if counts[w] else log(total) + 1 + 2.5 * len(w)
    best = lambda name: min(_cuts(name), key=lambda c: (round(sum(map(cost, c)), 9), [-len(w) for w in c[::-1]])) if name.isalpha() and len(name) > 1 else (name,)

    def words(url):
        host, path = (re.match(r"[^/?#]*", url.split("://", 1)[1])[0].lower(), re.sub(r"^[^/?#]*|[?#].*", "", url.split("://", 1)[1])) if url and "://" in url else ("", "")
        names = [("", x) for n in host.split(".") if n not in ("net", "org", "example", "com") for x in re.findall(r"[^\W\d_]+|[0-9]+", n)]
        names += [("/", "#" if x.isdigit() else x) for x in re.findall(r"[^\W\d_]+|[0-9]+", path.lower()) if x not in ("en", "de", "fr")]
        return [sign + w for sign, x in names for w in best(x)]

    by = {"block": Counter(), "allow": Counter()}
    for u, rule, v in urls:
        if rule:
            by[v].update(words(u))
    every = set(by["block"]) | set(by["allow"])
    odds = {w: log((by["block"][w] + 1) / (sum(by["block"].values()) + len(every))) - log((by["allow"][w] + 1) / (sum(by["allow"].values()) + len(every))) for w in every}
    for i, (u, rule, v) in enumerate(urls):
        score = sum(round(odds.get(w, 0) * UNIT) for w in words(u))
        assert (got[i]["rule"], got[i]["verdict"]) == (rule, v if rule else "block" if score > 0 else "allow"), u
        assert v is None or got[i]["verdict"] == v
    names = {x for u, _, _ in urls[60:78] for x in re.findall("[a-z]{6,}", u)}
    assert all(len(Segmenter(dict(counts), total).words[x]) == 2 for x in names) and len(names) > 5


def test_urls_long_words_and_other_letters(spark, monkeypatch):
    """Words and names of any length and any letters are cut, by joins of either kind; hot heads don't mix words up."""
    from telemill.llm.urls import lexicon, named, segmented
    from telemill.plans import lineage

    long, other, giant = "donaudampfschifffahrtsgesellschaft", "donaudampfschifffahrtskapitän", "x" * 3000 + "y" * 500
    html = f"<p>{long} {other} {giant} café münchen москва hotel bar the same</p>" * 3
    hosts = [f"hotel{long}bar.de", f"{long}{other}.de", f"{giant}hotel.de", "münchencafé.de", "москваhotel.рф", "a" * 4000 + "hotel.de", "u:p@hotelbar.de:8080", "xn--mnchen-3ya.de", f"{other}" * 40 + ".de"]
    pages = spark.createDataFrame([(i, f"http://{h}/Straße{i}", html) for i, h in enumerate(hosts)], "page_id long, url string, html string")
    seen = []
    for rows in (lineage.BROADCAST_ROWS, -1):
        monkeypatch.setattr(lineage, "BROADCAST_ROWS", rows)
        uses = named(pages).select(F.explode("names").alias("name"), F.lit(1).cast("long").alias("b"), F.lit(0).cast("long").alias("a")).distinct()
        got = {r["name"]: tuple(r["words"]) for r in segmented(uses, lexicon(pages)).collect()}
        assert got[f"hotel{long}bar"] == ("hotel", long, "bar") and got[long + other] == (long, other) and got[giant + "hotel"] == (giant, "hotel")
        assert got["münchencafé"] == ("münchen", "café") and got["москваhotel"] == ("москва", "hotel") and got["a" * 4000 + "hotel"] == ("a" * 4000, "hotel")
        assert got["hotelbar"] == ("hotel", "bar") and got["u"] == ("u",) and got["8080"] == ("8080",) and got["/straße"] == ("/straße",) and got["mnchen"] == ("mnchen",) and got[other * 40] == (other,) * 40
        seen.append(got)
    assert seen[0] == seen[1]


def test_urls_rare_words_count(spark, monkeypatch):
    """A word seen once speaks for its verdict, however many words there are, and joins of either kind give the same."""
    from telemill.llm.urls import judge
    from telemill.plans import lineage

    name = F.concat(F.lit("a"), F.translate(F.lpad(F.col("id").cast("string"), 6, "0"), "0123456789", "bcdfghjklm"))
    many = spark.range(110_000).select(F.col("id").alias("page_id"), F.concat(F.when(F.col("id") % 2 == 0, "http://q.net/").otherwise("http://q.org/fr/"), name).alias("url"), F.lit(None).cast("string").alias("html"))
    few = spark.createDataFrame([(200_000, "http://q.net/zzblock", None), (200_001, "http://q.org/fr/zzallow", None), (200_002, "http://x.io/zzblock", "<p>x</p>"), (200_003, "http://x.io/zzallow", None)], "page_id long, url string, html string")
    got = {}
    for rows in (lineage.BROADCAST_ROWS, -1):
        monkeypatch.setattr(lineage, "BROADCAST_ROWS", rows)
        out = judge(many.where("page_id < 110000").union(few))
        assert out.count() == 110_004
        got[rows] = sorted(map(tuple, out.where("page_id >= 109990").collect()))
        assert [r[4] for r in got[rows][-4:]] == ["block", "allow", "block", "allow"]  # zzblock, zzallow
    assert len(got) == 2 and len(set(map(tuple, got.values()))) == 1


# -- languages


def test_automaton_and_phrases():
    import numpy as np

    from telemill.llm.language import Model

    m, r = Model({"a": "abcabcdabcde " * 3, "b": "edcba edc"}), random.Random(7)
    for _ in range(100):
        text = "".join(r.choice("abcdez ") for _ in range(r.randint(1, 60)))
        codes = m.codes(text)[0]
        want = []
        for name in m.languages:
            sample, n, at = bytes(m.codes({"a": "abcabcdabcde " * 3, "b": "edcba edc"}[name])[0]), 0, 0
            while at < len(codes):
                k = 1
                while at + k < len(codes) and bytes(codes[at : at + k + 1]) in sample and bytes(codes[at : at + 1]) in sample:
                    k += 1
                n, at = n + 1, at + k
            want.append(max(1, n))
        if len(codes):
            assert m.phrases([np.array(codes)])[0].tolist() == want


def test_phrases_of_long_texts():
    """Texts of many lengths side by side, the longest of them walked to their ends alone, against a plain parse."""
    from telemill.llm.language import FEW, Model

    r = random.Random(8)
    said = {"a": "".join(r.choice("abcd ") for _ in range(400)), "b": "".join(r.choice("bcde") for _ in range(300))}
    m = Model(said)
    texts = [m.codes("".join(r.choice("abcdez ") for _ in range(n)))[0] for n in [1, 9000, 700, 7000, *[r.randint(1, 90) for _ in range(2 * FEW)]]]

    def plain(codes: bytes, sample: bytes) -> int:
        n = at = 0
        while at < len(codes):
            k = 1
            while at + k < len(codes) and codes[at : at + k + 1] in sample:
                k += 1
            n, at = n + 1, at + k
        return n

    samples = [bytes(m.codes(said[k])[0]) for k in m.languages]
    assert m.phrases(texts).tolist() == [[plain(bytes(t), s) for s in samples] for t in texts]


def test_languages_edges(spark):
    """One language wins with score 1, ties go to the first by name, and equal rows get equal results."""
    from telemill.llm.language import Model

    assert Model({"x": "abc"}).predict(["cab", None, "", "1 2"]) == [("x", 1.0), ("und", 0.0), ("und", 0.0), ("und", 0.0)]
    assert Model({"y": "abcabc", "x": "abcabc"}).predict(["abcab", "abcab"]) == [("x", 0.0)] * 2


def test_language_query(spark, tmp_path):
    from telemill.llm.queries import op8_language_id

    en, fr = "the quick brown fox jumps over the lazy dog and runs away ", "le vif renard brun saute par dessus le chien paresseux et court "
    rows = [(i, (en if i % 2 else fr) * 3, "en" if i % 2 else "fr") for i in range(60)] + [(60, None, "en"), (None, en, "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op8_language_id(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    for r in got.collect():
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and (r["doc_id"] in (None, 60) or r["lang_pred"] == ("en" if r["doc_id"] % 2 else "fr"))


def test_languages(spark):
    from telemill.llm.language import predict, train

    en, fr = "the quick brown fox jumps over the lazy dog and runs away ", "le vif renard brun saute par dessus le chien paresseux et court "
    rows = [(i, (en if i % 2 else fr) * 3, "en" if i % 2 else "fr") for i in range(40)] + [(40, None, "en"), (41, "123 !?", "fr"), (42, en * 2000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict(docs, train(docs, F.col("doc_id") < 20)).collect()}
    assert all(got[i][0] == ("en" if i % 2 else "fr") and 0 < got[i][1] <= 1 for i in range(40))
    assert got[40] == got[41] == ("und", 0.0) and got[42][0] == "en"
    assert {r["lang_pred"] for r in predict(docs, train(docs, F.lit(False))).collect()} == {"und"}


def test_languages_behind_a_header(spark):
    """Documents that open alike, and copies of one text, teach their language all the same."""
    from telemill.llm.language import predict, train

    header = "all of this is shared by every document of the house " * 12
    en, fr = "the quick brown fox jumps over lazy dogs and runs away".split(), "le vif renard saute par dessus un chien paresseux et court".split()
    r = random.Random(11)
    body = lambda words, n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, header + body(en if i % 2 else fr, 300), "en" if i % 2 else "fr") for i in range(40)] + [(40 + i, header, "en" if i % 2 else "fr") for i in range(400)]
    rows += [(1000 + i, body(en if i % 2 else fr, 12), None) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in predict(docs, train(docs, F.col("doc_id") < 1000)).collect()}
    assert all(got[1000 + i] == ("en" if i % 2 else "fr") for i in range(20))


def test_letters_of_many_scripts_are_told_apart():
    from telemill.llm.language import Model

    r = random.Random(12)
    pools = {"aa": [c for c in map(chr, range(0x100, 0x250)) if c.isalpha() and c.lower() == c and len(c.lower()) == 1][:100], "ja": [chr(0x3041 + i) for i in range(80)], "ko": [chr(0xAC00 + 7 * i) for i in range(300)], "zh": [chr(0x4E00 + 5 * i) for i in range(300)]}
    text = lambda name, n: "".join(r.choice(pools[name]) for _ in range(n))
    m = Model({k: text(k, 10_000 if k == "aa" else 2_000) for k in pools})
    assert [x[0] for x in m.predict([text(k, 60) for k in pools])] == list(pools)
    some = pools["zh"][:5] + pools["ko"][:5] + pools["ja"][:5]
    assert len({bytes(m.codes(c)[0]) for c in some}) == len(some)


# -- secrets


def test_secrets(spark):
    from telemill.llm.secrets import MARK, redacted, scan

    key = "64be24439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(1, f'see token = "{key}" and token = "{key}" here'), (2, "sha1 = 0123456789abcdef0123456789abcdef01234567 of commit"), (3, "card 4785380592391139 paid"), (4, None), (5, ""), (6, "plainwordswithoutanydigitsinthem"), (7, LONG + f' api_key="AKIA{"Q7" * 8}"')]
    got = {r["doc_id"]: [(f["value"], f["occurrences"], f["secret"]) for f in r["findings"]] for r in scan(documents(spark, rows)).collect()}
    assert got[1] == [(key, 2, True)] and got[4] == got[5] == got[6] == []
    assert [x[2] for x in got[2] + got[3]] == [False, False] and got[7] == [(f"AKIA{'Q7' * 8}", 1, True)]
    clean = {r["doc_id"]: r["text"] for r in redacted(documents(spark, rows)).collect()}
    assert clean[1] == f'see token = "{MARK}" and token = "{MARK}" here' and clean[2] == rows[1][1] and clean[4] is None
    assert scan(documents(spark, [])).count() == 0


def test_secrets_edges(spark):
    """Ties and findings within one another, no path column, a column of the result's name, and the registered query."""
    from telemill.llm.secrets import MARK, redacted, scan

    key = "64be24439e3e49cf46b2d7c90f3602a3d0b907ff"
    docs = spark.createDataFrame([(1, f'token = "{key}" and token = "{key}aa"', 3), (1, f'token = "{key}" and token = "{key}aa"', 3), (2, None, 4)], "doc_id long, text string, findings long")
    got = scan(docs)
    assert got.columns == docs.columns and sorted(len(r["findings"]) for r in got.collect()) == [0, 2, 2]
    p = min(f["probability"] for r in got.collect() for f in r["findings"])
    assert all(f["secret"] for r in scan(docs, least=p).collect() for f in r["findings"])
    clean = redacted(docs)
    assert clean.columns == docs.columns and sorted(map(repr, clean.collect())) == sorted(map(repr, spark.createDataFrame([(1, f'token = "{MARK}" and token = "{MARK}"', 3)] * 2 + [(2, None, 4)], docs.schema).collect()))


def test_secrets_query(spark, tmp_path):
    from telemill.llm.queries import op9_secret_scans

    rows = [(i, f'{prose(i, 30)} token = "{hashlib.sha1(str(i).encode()).hexdigest()}" {prose(i, 5)}') for i in range(20)] + [(50, None)]
    documents(spark, rows, False).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(op9_secret_scans(spark, str(tmp_path)).collect())
    assert [(r["doc_id"], r["nth"], r["value_sha256"], r["length"], r["occurrences"], r["secret"]) for r in got] == [(i, 0, hashlib.sha256(hashlib.sha1(str(i).encode()).hexdigest().encode()).hexdigest(), 40, 1, True) for i in range(20)]


def test_secrets_features(spark):
    """The features of the forest against plain Python: transitions, dictionary coverage, neighbouring words."""
    from math import log2

    from telemill.llm.secrets import covered, features, lexicon, transitions

    docs = spark.createDataFrame([(1, "Getter, getter user users user.\nab1c user"), (2, "name Name xx x"), (3, None)], "doc_id long, text string")
    words = lexicon(docs)
    assert sorted(map(tuple, words.collect())) == [("getter", 2), ("name", 2), ("user", 3)]
    pairs = transitions(words)
    assert abs(pairs[4 * 26 + 17] + log2((5 + 1) / (2 + 5 + 26))) < 1e-12  # e: te-t once a getter, er in getter and user
    rows = spark.createDataFrame([("getterUserXy_9", "set the token = \"", " of name", "src/tests/a.py")], "value string, before string, after string, path string")
    rows = rows.join(covered(rows, words), "value", "left")
    got = rows.select(*[c.alias(k) for k, c in features(pairs, {"token": 2.0, "name": -1.0, "set": 0.5}, {"tests": -3.0}).items()]).first()
    v = "getteruserxy"
    bits = [pairs[(ord(a) - 97) * 26 + ord(b) - 97] for a, b in zip(v, v[1:])]
    assert (got["length"], got["before"], got["after"], got["path"], got["assigned"]) == (14.0, 2.5, -1.0, -3.0, 1.0)
    assert abs(got["words"] - 1000 / 14) < 1e-9 and abs(got["transitions"] - sum(bits) / len(bits)) < 1e-9


def test_secrets_precision_and_recall(spark):
    """Findings that the forest hasn't seen, drawn from another seed and other words."""
    from telemill.llm.secrets import drawn, train

    r = random.Random(1)
    words = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4))) for _ in range(600)]
    docs = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(200))) for i in range(60)], "doc_id long, text string")
    test = spark.createDataFrame(drawn(words[300:], 3000, 99), "value string, before string, after string, path string, label int")
    got = train(docs).judged(test, 0.5).select("label", "secret").collect()
    right = sum(x["label"] and x["secret"] for x in got)
    precision, recall = right / sum(x["secret"] for x in got), right / sum(x["label"] for x in got)
    assert precision > 0.95 and recall > 0.95, (precision, recall)


def test_forest_is_what_trees_say(spark):
    import numpy as np

    from telemill.llm.secrets import forest, probability

    rng = np.random.default_rng(1)
    x = rng.random((200, 3))
    trees = forest(x, (x[:, 0] > 0.5).astype(float), 5, 3)

    def walk(t, row):
        return t if isinstance(t, float) else walk(t[2] if row[t[0]] <= t[1] else t[3], row)

    frame = spark.createDataFrame([tuple(map(float, r)) for r in x[:40]], "a double, b double, c double")
    got = [r[0] for r in frame.select(probability(trees, ["a", "b", "c"], F.col)).collect()]
    assert np.allclose(got, [np.mean([walk(t, r) for t in trees]) for r in x[:40]], atol=1e-5)


def test_plan_of_the_forest_is_small(spark):
    """A forest of any size and transitions are a few literals: the driver doesn't copy a plan of thousands of nodes."""
    import numpy as np

    from telemill.llm.secrets import features, forest, probability

    rng = np.random.default_rng(2)
    x = rng.random((3000, 14))
    trees = forest(x, (rng.random(3000) < x[:, 3]).astype(float), 16, 6)
    rows = spark.createDataFrame([("getterUserXy_9", "set the token = ", " of name", "src/a.py", 6)], "value string, before string, after string, path string, covered int")
    made = features([0.5] * 676, {"token": 2.0}, {"tests": -3.0})
    out = rows.select(*[c.alias(k) for k, c in made.items()]).select(probability(trees, list(made), F.col))
    assert len(out._jdf.queryExecution().analyzed().toString()) < 60_000
    assert 0 <= out.first()[0] <= 1
    assert rows.select(probability([0.25, 0.75], [], F.col)).first()[0] == 0.5 == rows.select(probability([(0, 6.0, 0.5, 1.0)], ["covered"], F.col)).first()[0]


# -- quality


def repeats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    return w, len({j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 8)})


def test_quality_features(spark):
    from telemill.llm.quality_rules import features

    rows = [*ROWS, (20, "a b c d e f g h " * 5), (21, "x " * 30), (22, prose(8, 40) + " " + prose(8, 40)), (23, "l one\nl one\n\nl one\n#*$"), (24, prose(9, 3000, 3))]
    for r in features(documents(spark, rows)).collect():
        t = r["text"] or ""
        w, n = repeats(t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), n)
        assert r["base_failed"] == (len(w) < 20 or 100 * n > 30 * len(w))
    assert features(documents(spark, [])).count() == 0


def test_thresholds():
    from math import comb

    from telemill.llm.quality_rules import GRID, binomial_cdf, passed, path

    assert abs(binomial_cdf(3, 50, 0.1) - sum(comb(50, i) * 0.1**i * 0.9 ** (50 - i) for i in range(4))) < 1e-12
    flat = lambda *steps: [steps[min(i, len(steps) - 1)] for i in range(len(GRID))]
    assert path({"a": flat((0, 10), (2, 90), (900, 400)), "b": flat((0, 0), (1, 60))}) == [("a", GRID[0]), ("b", GRID[1]), ("a", GRID[1])]
    assert path({"a": flat((0, 0))}) == []
    assert passed(5000, {1: 0, 2: 2, 3: 500}, 3, 0.001, 0.01) == 2 and passed(5000, {}, 3, 0.001, 0.01) == 3
    assert passed(20, {}, 2, 0.001, 0.01) == 0 and passed(0, {}, 2, 0.05) == 0


def test_union_of_cutoffs_holds_the_risk():
    """Draws of labelled documents whose scores don't tell good from bad well: the chosen sets of cutoffs reject more
    than RISK of all good documents in no more than ALPHA of the draws."""
    import numpy as np

    from telemill.llm.quality_rules import ALPHA, GRID, RISK, passed, path

    rng, failed, used = np.random.default_rng(5), 0, 0
    draw = lambda n, good: np.where(rng.random((n, 3)) < (0.004 if good else 0.25), rng.integers(0, 1001, (n, 3)), rng.integers(0, 20, (n, 3)))
    every = draw(400_000, True)
    for _ in range(200):
        good, bad, hold = draw(1500, True), draw(600, False), draw(3000, True)
        steps = path({k: [((good[:, k] > c).sum(), (bad[:, k] > c).sum()) for c in GRID] for k in range(3)})
        first = np.full(len(hold), 0)
        for i, (k, c) in reversed(list(enumerate(steps, 1))):
            first[hold[:, k] > c] = i
        n = passed(len(hold), dict(zip(*map(list, np.unique(first, return_counts=True)), strict=True)), len(steps), ALPHA)
        cut = dict(steps[:n])
        used += n > 0
        failed += bool(cut) and np.any([every[:, k] > c for k, c in cut.items()], axis=0).mean() > RISK
    assert used > 100 and failed <= 20  # 200 * ALPHA, with room for chance


def test_quality(spark):
    from telemill.llm.quality_rules import judge, quality_rules

    good, bad = [(i, prose(i, 40)) for i in range(1500)], [(2000 + i, prose(i, 40).replace("w", "W# ")) for i in range(300)]
    docs = documents(spark, good + bad + [(5000, None), (None, prose(1, 30))])
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad[:200]] + [(0, None, 1)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in judge(docs, labels).collect()}
    assert all(kept[i] for i, _ in good) and not any(kept[i] for i, _ in bad) and not kept[5000]
    out = quality_rules(docs, labels)
    assert out.columns == docs.columns and out.count() == 1501
    assert judge(docs.limit(0), labels.limit(0)).count() == 0
    twice = documents(spark, [(1, prose(1, 40)), (1, "short"), (1, "short"), (None, None)], False)
    assert [r["text"] for r in quality_rules(twice, labels).collect()] == [prose(1, 40)]
    assert sorted(r["kept"] for r in judge(twice, labels).collect()) == [False] * 3 + [True]


# -- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    note = "Released for all readers under the usual licence of the house"
    rows = [(i, prose(100 + i, 80, 4000) + (f"\n{note}" if i < 4 else "")) for i in range(8)] + [(20, prose(103, 80, 4000).replace(" ", " new ", 1)), (21, "too short"), (22, None), (23, prose(104, 80, 4000)), (24, prose(300, 40) + ' token = "64be24439e3e49cf46b2d7c90f3602a3d0b907ff"')]
    spark.createDataFrame([(i, 1, 0) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = documents(spark, rows, False)
    ids = lambda f: sorted(r["doc_id"] for r in f.select("doc_id").collect())
    one = p.quality(spark, docs, str(tmp_path))
    assert ids(one) == [*range(8), 20, 23, 24] and one.columns == docs.columns
    two = p.line_dedup(spark, one, "")
    texts = {r["doc_id"]: r["text"] for r in two.collect()}
    assert note in texts[0] and note not in texts[1] and 23 not in texts and two.columns == docs.columns
    near = documents(spark, [(1, BASE), (2, EDITED), (3, LONG), (1, BASE), (None, "x")], False)
    three = p.near_duplicates(spark, near, "")
    assert sorted(repr(r["doc_id"]) for r in three.collect()) == ["1", "3", "None"]
    four = p.secret_scan(spark, two, "")
    assert "[SECRET]" in {r["doc_id"]: r["text"] for r in four.collect()}[24] and four.columns == docs.columns
    five = p.pack(spark, four, "")
    assert set(ids(five)) == set(ids(four))
    assert [s[0] for s in p.STAGES] == ["quality rules", "line dedup", "near duplicates", "secret scan", "best-fit packing"]


def test_near_duplicates_keep_rows_of_one_id(spark):
    """Different texts of one id stay, of equal ones the least row does, whatever the order of the rows."""
    import corpus_pipeline as p

    rows = [(1, BASE, "en", "b", 5), (1, LONG, "en", "a", 6), (1, BASE, "en", "a", 5), (2, EDITED, "en", "a", 5), (3, None, "fr", None, None), (3, None, "de", None, None), (None, BASE, "en", "z", 5), (None, BASE, "en", "z", 5)]
    want = sorted(map(repr, [rows[1], rows[2], rows[5], rows[6], rows[7]]))
    for order in (rows, rows[::-1]):
        got = p.near_duplicates(spark, spark.createDataFrame(order, DOC), "")
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted(repr(tuple(r)) for r in got.collect()) == want


def test_pipeline_equals_brute_force(spark, tmp_path):
    """run() against plain Python: base rules, the SQL of line dedup, all pairs, known secrets, and the library's tokens."""
    import duckdb
    import public_tokenizers as P
    from tokenizers import Tokenizer

    import corpus_pipeline as p
    from telemill.llm.lines import ORACLE
    from telemill.llm.secrets import MARK

    r = random.Random(21)
    key = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    line = lambda n: " ".join(f"w{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}" for _ in range(n))
    texts = ["\n".join(line(r.randint(3, 40)) for _ in range(r.randint(1, 9))) for _ in range(60)]
    note = "All rights reserved."
    for i in range(0, 60, 6):
        texts[i] += f"\n{note}"
    for i in range(1, 60, 7):
        texts[i] += f'\n{line(4)} token = "{key(i)}" {line(3)}'
    for i in range(0, 20):
        words = texts[i].split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words).replace("\n", " \n"))
    texts += [texts[3], texts[5], None, "", "too short", line(25) * 1 + " " + ("again and again we say the very same words " * 6)]
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOC).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = p.run(spark, str(tmp_path)).collect()

    def good(t):
        w, n = repeats(t)
        return len(w) >= 20 and 100 * n <= 30 * len(w)

    docs = [(i, t) for i, t in enumerate(texts) if good(t)]
    con = duckdb.connect()
    con.sql("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    left = {i: (t, n) for i, t, n in con.sql(ORACLE.replace("case when d.text is null then null else sha256(coalesce(k.text, '')) end as text_sha256", "coalesce(k.text, '') as t, n_dropped").replace("select d.doc_id, coalesce", "select d.doc_id, t, n_dropped from (select d.doc_id, coalesce") .replace("as t, n_dropped\nfrom documents d left join kept k on k.doc_id = d.doc_id", "as t\nfrom documents d left join kept k on k.doc_id = d.doc_id) d")).fetchall()}
    docs = [(i, left[i][0]) for i, _ in docs if left[i][1] == 0 or left[i][0].split()]
    assert any(left[i][1] for i in left)
    docs = [(i, t) for (i, t), (j, _, c) in zip(docs, brute(docs), strict=True) if i == j == c]
    docs = [(i, re.sub("[0-9a-f]{40}", MARK, t)) for i, t in docs]
    assert any(MARK in t for _, t in docs) and len(docs) < 62
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for i, t in docs:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, 0, 0, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
    assert all(w[3] <= 1024 for w in want)
    assert sorted((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in got) == sorted(want)
    held = {}
    for x in got:
        held.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for places in held.values():
        assert sum(n for _, n in places) <= 1024 and all(o == sum(n for q, n in places if q < o) for o, _ in places)
    assert len(held) <= -(-sum(w[3] for w in want) // 1024) + 1


def test_other_registered_queries(spark, tmp_path):
    """op1, op2, op7 and op10 as they are registered: their columns, and rows against plain Python."""
    import public_tokenizers as P
    import tiktoken

    from telemill.llm import queries as q
    from telemill.llm.bpe import read_ranks

    rows = [r for r in ROWS if r[0] is not None]
    documents(spark, rows, False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = str(tmp_path)
    one, two, seven, ten = q.op1_best_fit_packing(spark, d), q.op2_jaccard_join(spark, d), q.op7_byte_bpe(spark, d), q.op10_quality_rules(spark, d)
    assert one.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert one.where("start = 0 and piece = 0").count() == len(rows) and dict(one.dtypes)["piece"] == "int"
    assert two.columns == ["doc_id", "n_shingles", "component_id"] and sorted(map(tuple, two.collect())) == brute(rows)
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(i, len(e.encode_ordinary(t or "")), sha(",".join(map(str, e.encode_ordinary(t or "")))), sha(t or "")) for i, t in rows]
    assert seven.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and sorted(map(tuple, seven.collect())) == sorted(want)
    assert ten.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    for r, (i, t) in zip(sorted(ten.collect()), sorted(rows, key=lambda r: (r[0], len(repeats(r[1])[0]))), strict=True):
        w, n = repeats(t)
        failed = len(w) < 20 or 100 * n > 30 * len(w)
        assert (r["doc_id"], r["n_words"], r["n_repeat_words"], r["base_failed"], r["kept"]) == (i, len(w), n, failed, not failed)
