"""Collocations, source divergence and SimHash near-dedup against brute-force versions, and on awkward inputs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from strandlake.llm import collocations, divergence, simhash
from strandlake.llm._shared import Scratch

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
AWKWARD = [None, "", " ", "\n\n", "word", "a b c", "é ü ß", "x" * 5000, "the same text again and again " * 400, "a b c", "日本語 テキスト", "1234 !!", "\x00 nul", "!a.b,c!", "A a A a A a"]
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, (t, lang, source) in enumerate(rows)], DOCS)


def prose(seed, n=120):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "Tabk" for b in ("o", "é", "3x", "-", "n't")]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words[: 6 if i % 3 else 20]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ","]) for _ in range(rng.randrange(60)))
        rows.append((text, rng.choice(["en", "en", "en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", "s2", None])))
    return rows + [(t, rng.choice(["en", None, "und", ""]), rng.choice(["s1", ""])) for t in AWKWARD]


# Collocations


def phrases_by_force(rows, least, longest, inside, top):
    f = defaultdict(Counter)
    for text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, longest + 1):
                f[lang if lang is not None else "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, found in f.items():
        n, kept = sum(c for p, c in found.items() if len(p) == 1), []
        long = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        for p, a in long.items():
            score, k = min((1000000 * a * a // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
            holds = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))  # noqa: B023, E731
            if not any(holds(q) and 100 * b >= inside * a for q, b in long.items()):
                kept.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, le, r, n, -s) for i, (s, a, p, le, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("least", "longest", "cells", "top"), [(10, 3, 20, 2000), (3, 4, 16, 7), (2, 2, 16, 5000), (12, 3, 26, 2000)])
def test_collocations_against_brute_force(spark, monkeypatch, least, longest, cells, top):
    monkeypatch.setattr(collocations, "CHUNK", 2000)
    rows = prose(least)
    got = collocations.collocations(spark, frame(spark, rows), least, longest, 50, top, cells)
    want = phrases_by_force(rows, least, longest, 50, top)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20


def test_texts_over_a_chunk_are_cut_between_pieces_only():
    rng = random.Random(2)
    text = "".join(rng.choice(["ab ", "c", ". ", "\n"]) for _ in range(5000)) + "x" * 3000
    for most in (1, 17, 1000, 10**6):
        parts = list(collocations.parts_of(text, most))
        assert "".join(parts) == text and all(re.search(r"[.,;:!?\n]$", p) for p in parts[:-1])
    assert list(collocations.parts_of("", 5)) == [] and list(collocations.parts_of("no end here", 3)) == ["no end here"]


def test_collocations_when_the_sketch_is_full_or_saturated(spark):
    rows = [("the cat sat on the mat " * 2000, "en", "s"), ("the cat. sat", "en", "s")] * 2
    few = collocations.counts(frame(spark, rows), 10, 3, 16)
    want = {("the",): 8002, ("the", "cat"): 4002, ("mat", "the"): 3998, ("sat", "on", "the"): 4000}
    got = {tuple(r["phrase"].split()): r["f"] for r in few.collect() if r["phrase"]}
    assert {k: got[k] for k in want} == want
    many = [(" ".join(f"w{i}x{j}" for j in range(3000)), "en", "s") for i in range(40)] + rows  # more phrases than counters
    got = {tuple(r["phrase"].split()): r["f"] for r in collocations.counts(frame(spark, many), 10, 3, 16).collect() if r["phrase"]}
    assert {k: got[k] for k in want} == want and not any(k[0].startswith("w") for k in got)


def test_automata_hold_a_stretch_of_a_chunk_and_rows_go_out_in_parts(monkeypatch):
    """As where a corpus fills the sketch, and every phrase is kept."""
    made, real = [], collocations.ahocorasick.Automaton

    def automaton(*args):
        made.append(real(*args))
        return made[-1]

    monkeypatch.setattr(collocations.ahocorasick, "Automaton", automaton)
    monkeypatch.setattr(collocations, "ROWS", 50)
    rng = random.Random(4)
    words = [rng.choice([b"!", b"a", b"a", b"ab", b"b", b"\xc3\xa9", *(b"w%d" % i for i in range(300))]) for _ in range(3000)]
    want = Counter()
    for piece in b" ".join(words).decode().split("!"):
        w = piece.split()
        want.update(" ".join(w[i : i + n]) for n in (1, 2, 3, 4) for i in range(len(w) - n + 1))
    p = collocations.Phrases("en", words, 4)
    found = p.candidates(np.full(1 << 13, 255, np.uint8), 16)
    for stretch in (1, 2, 7, 500, 10**6):
        made.clear()
        f = collocations.counted(p.ids, len(p.words), found, stretch)
        got = {b" ".join(p.words[i] for i in row).decode(): int(n) for (rows, _), many in zip(found, f, strict=True) for row, n in zip(rows, many, strict=True)}
        assert got == want
        assert max(map(len, made)) <= 4 * stretch
    batches = list(collocations.phrase_rows("en", p, found))
    assert max(b.num_rows for b in batches) == 50
    assert {r["phrase"]: r["f"] for b in batches[:-1] for r in b.to_pylist()} == want
    assert batches[-1].to_pylist() == [{"lang": "en", "phrase": None, "f": sum(w != b"!" for w in words)}]
    assert list(collocations.phrase_rows("en", collocations.Phrases("en", [b"!"], 3), []))[0].to_pylist()[0]["f"] == 0


def test_a_chunk_counts_bytes_and_holds_words_of_one_language():
    batch = pa.RecordBatch.from_pylist([{"lang": "a", "text": "\u65e5\u672c. " * 100}, {"lang": "b", "text": "x y"}, {"lang": "a", "text": ""}, {"lang": "c", "text": " "}])
    got = list(collocations.chunks(iter([batch]), 70))
    assert max(sum(map(len, words)) for _, words in got) < 350  # a text is cut beyond 70 characters, here of three bytes
    assert Counter(w for lang, words in got for w in words if lang == "a")["\u65e5\u672c".encode()] == 100
    assert [words for lang, words in got if lang == "b"] == [[b"x", b"y"]]


def test_collocations_score_beyond_64_bits_and_empty_tables(spark):
    big = 3 * 10**12
    found = spark.createDataFrame([("en", "a b", big), ("en", "a", big + 7), ("en", "b", big * 2), ("en", None, 9 * big)], "lang string, phrase string, f bigint")
    assert [r["score"] for r in collocations.scored(found).collect()] == [1000000 * big * big // ((big + 7) * 2 * big)]
    docs = frame(spark, prose(1))
    assert collocations.collocations(spark, docs.limit(0)).count() == 0
    assert collocations.collocations(spark, docs.filter("text is null")).count() == 0
    clash = docs.withColumns({c: F.lit("x") for c in ("phrase", "f", "rank", "a", "score", "block")})
    assert sorted(collocations.collocations(spark, clash).collect()) == sorted(collocations.collocations(spark, docs).collect())
    assert {r["n"] for r in collocations.collocations(spark, docs.union(docs)).select("n").collect()} >= {2 * r["n"] for r in collocations.collocations(spark, docs).select("n").collect()}


# Divergence of sources


def divergence_by_force(rows, least_docs, top):
    rows = [((t or "").translate(LOW), lang or "", source or "") for t, lang, source in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t) for t, _, _ in rows]
    df, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for (_, lang, source), t in zip(rows, terms, strict=True):
        df[lang].update(set(t))
        groups[lang].add(source)
        count[lang, source].update(t)
        count[lang].update(t)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least_docs]

        def share(key, kept=kept):
            n = sum(count[key][t] for t in kept)
            return {t: 1 + 10**9 * (count[key][t] + 5) // (n + 5 * len(kept)) for t in kept}

        whole = share(lang)
        p = {s: share((lang, s)) for s in sources}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)]
            above = sorted((whole[t] - p[s][t], t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > whole[t])
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(above[:top])]
    return sorted(out)


@pytest.mark.parametrize(("least_docs", "top", "block", "bucket"), [(30, 50, 200_000, 200_000), (2, 3, 4, 10), (1, 50, 3, 1), (10**6, 50, 5, 5)])
def test_divergence_against_brute_force(spark, monkeypatch, least_docs, top, block, bucket):
    monkeypatch.setattr(divergence, "BUCKET", bucket)
    monkeypatch.setattr(divergence.recounted, "__defaults__", (block,))
    monkeypatch.setattr(divergence, "HELD", 64)
    monkeypatch.setattr(divergence, "CHUNK", 500)
    rows = prose(least_docs + 3)
    got = divergence.audit(spark, frame(spark, rows), least_docs, top)
    assert sorted(map(tuple, got.collect())) == divergence_by_force(rows, least_docs, top)


def test_divergence_of_rows_repeated_empty_tables_and_clashing_columns(spark):
    rows = prose(4)
    docs = frame(spark, rows)
    assert divergence.audit(spark, docs.limit(0)).count() == 0
    assert sorted(map(tuple, divergence.audit(spark, docs.union(docs), 6).collect())) == divergence_by_force(rows * 2, 6, 50)
    clash = docs.withColumns({c: F.lit("x") for c in ("term", "count", "p", "item", "block", "v", "terms")})
    assert sorted(map(tuple, divergence.audit(spark, clash, 6).collect())) == divergence_by_force(rows, 6, 50)
    none = divergence.audit(spark, frame(spark, [(None, None, "a"), ("", "", None), ("1 2", "xx", "a")]), 1)
    assert sorted(map(tuple, none.collect())) == [("", "", "pair", "a", 0, 1), ("", "a", "pair", "", 0, 1)]


def test_shares_are_exact_beyond_64_bits(spark):
    row = spark.createDataFrame([(10**13, 3 * 10**14, 10**9)], "c bigint, n bigint, v bigint")
    assert row.select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).first()[0] == 1 + 10**9 * (10**13 + 5) // (3 * 10**14 + 5 * 10**9)


# SimHash


def fingerprint_by_force(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_force(nodes, threshold=2):
    nodes, root = sorted(set(nodes)), {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= threshold:
                root[find(a)] = find(b)
    return {x: find(x) for x in nodes}


def test_simhash_against_brute_force(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()
    rng, texts = random.Random(1), [r["text"] for r in base]
    for t in [t for t in texts if t and len(t.split()) > 150][:10]:
        for _ in range(12):
            w = t.split(" ")
            w[rng.randrange(len(w))] = "edited"
            texts.append(" ".join(w))
    texts += [*AWKWARD, "one two", "ONE two", "one  two\n", "É é", None]
    docs = frame(spark, [(t, "en", "s") for t in texts])
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark, docs).collect()}
    prints = {i: fingerprint_by_force(t) for i, t in enumerate(texts)}
    root = components_by_force(prints.values())
    least = {}
    for i, p in prints.items():
        least.setdefault(root[p], i)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{p:016x}", least[root[p]]) for i, p in prints.items()}
    assert sum(r["component_id"] != i for i, r in got.items()) > 20
    n_links = {r["fingerprint"]: r["n_links"] for r in got.values()}
    assert all((n_links[f"{a:016x}"] > 0) == any(0 < (a ^ b).bit_count() <= 2 for b in root) for a in root)


def test_codes_are_perfect_and_each_linked_pair_meets_at_an_anchor():
    for bits, radius, generator in simhash.BLOCKS:
        reach = simhash.reaches(bits, radius, generator, 2)
        assert len(reach) == 1 << generator.bit_length() - 1 and all(len(r[0]) == 1 for r in reach)
        assert all(simhash.remainder(p, generator) == s for s, r in enumerate(reach) for patterns in r for p in patterns)
    rng, anchors = random.Random(6), simhash.Anchors(2)
    sizes = []
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for i in rng.sample(range(64), rng.randrange(3)):
            y ^= 1 << i
        (ax, hx), (ay, hy) = anchors.of(x), anchors.of(y)
        assert hx in ay and hy in ax and (x ^ hx).bit_count() <= 8 and len(set(ax.tolist())) == len(ax)
        assert all((x ^ a).bit_count() <= 10 for a in ax.tolist())
        sizes.append(len(ax))
    assert sum(sizes) / len(sizes) < 200


@pytest.mark.parametrize("crowd", [1024, 3, 0])
def test_links_between_crowded_and_scattered_fingerprints(spark, crowd):
    rng = random.Random(crowd)
    nodes = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for i in rng.sample(range(64), rng.randrange(6)):
                x ^= 1 << i
            nodes.add(x)
    nodes |= {0, (1 << 64) - 1, 1 << 63, 3, (1 << 63) | 1, *(rng.getrandbits(64) for _ in range(200))}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in nodes], "node bigint")
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links_between(df, Scratch(spark, "test"), crowd).collect()]
    assert all(0 < (a ^ b).bit_count() <= 2 for a, b in links)
    linked = defaultdict(set)
    for a, b in links:
        linked[a].add(b)
        linked[b].add(a)
    seen = {}
    for x in nodes:
        todo = [x]
        while todo:
            y = todo.pop()
            if y not in seen:
                seen[y] = x
                todo += linked[y]
    groups = lambda root: {frozenset(k for k in root if root[k] == v) for v in root.values()}
    assert groups(seen) == groups(components_by_force(nodes))
    if crowd == 1024:
        want = {frozenset((a, b)) for a in nodes for b in nodes if 0 < (a ^ b).bit_count() <= 2}
        assert {frozenset(x) for x in links} == want and len(links) == len(want)


def test_simhash_of_awkward_rows(spark):
    docs = frame(spark, [(t, None, None) for t in AWKWARD])
    assert simhash.near_duplicates(spark, docs.limit(0)).count() == 0
    nulls = docs.withColumn("doc_id", F.when(F.col("doc_id") > 4, F.col("doc_id")))
    got = simhash.near_duplicates(spark, nulls).collect()
    assert len(got) == len(AWKWARD)
    zero = [r for r in got if r["fingerprint"] == "0" * 16]
    assert len(zero) == 4 and all(r["component_id"] is None for r in zero)
    again = simhash.near_duplicates(spark, docs.union(docs).withColumns({c: F.lit(1) for c in ("node", "root", "anchor", "home", "fingerprint")})).collect()
    assert len(again) == 2 * len(AWKWARD) and {r["component_id"] for r in again if r["fingerprint"] == "0" * 16} == {0}
    long = " ".join(f"w{i}" for i in range(100_000))
    assert simhash.fingerprint(long) == fingerprint_by_force(long)
