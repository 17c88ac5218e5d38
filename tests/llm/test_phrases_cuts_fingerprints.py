"""Collocations, fill-in-middle and SimHash against brute force, with the defined cases."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelforge.llm import collocations, fill_in_middle, queries, simhash

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, row string, cell bigint, n bigint, phrase string, fp bigint"
EDGES = [(900, None), (901, ""), (902, "   \n\t "), (903, "word"), (904, "a a a a a a a a a a a a"), (None, "no id at all here"), (None, None), (905, "x" * 300_000), (906, "Ünïcode — 你好   ß\x1c\x00 end 😀 \n"), (907, "marked <S> text"), (908, " lead"), (903, "word"), (909, "y z " * 40_000)]
LOWER = {i: i + 32 for i in range(65, 91)}


def frame(spark, rows, lang=lambda i: "en"):
    """Documents with columns that clash with the operators' own names."""
    return spark.createDataFrame([(i, t, lang(i), "r", 1, 2, "p", 3) for i, t in rows], SCHEMA)


# fill in middle


def cut(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    tokens = re.findall(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    lo, hi = sorted(x % (n + 1) for x in h[:2])
    p, m, s = ("".join(tokens[a:b]) for a, b in ((0, lo), (lo, hi), (hi, n)))
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if out.startswith("<S>") else "psm", len(p), len(m), out


@pytest.mark.parametrize("rate", [50, 100])
def test_cuts(spark, prose, rate):
    docs = [(i, prose(i, i)) for i in range(60)] + EDGES + [(7, prose(7, 7)), (8, "another text of the same id")]
    made = fill_in_middle.transform(frame(spark, docs), rate=rate)
    got = made.select("row.doc_id", "row.text", "n", "form", "prefix_chars", "middle_chars", "output", fill_in_middle.restore(F.col("output"), F.col("form")).alias("back"), "row.cell").collect()
    want = sorted((str(i), t or "", *map(str, cut(i, t, rate=rate))) for i, t in docs)
    assert sorted((str(r.doc_id), r.text or "", *map(str, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output))) for r in got) == want
    assert all(r.back == (r.text or "") and r.cell == 1 for r in got)
    assert len({r.form for r in got}) == 3


def test_cuts_of_an_empty_table(spark):
    assert fill_in_middle.transform(frame(spark, [])).count() == 0


# SimHash


def brute_fingerprint(text):
    words = re.findall(r"[^ \t-\r]+", (text or "").translate(LOWER))
    k = min(3, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)] if k else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    names = list(range(len(fps)))

    def root(i):
        while names[i] != i:
            i = names[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            a, b = root(i), root(j)
            names[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def near(text, r, n):
    words = text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = "changed" + str(r.randrange(99))
    return " ".join(words)


def test_simhash_of_documents(spark, prose):
    r = random.Random(3)
    docs = [(i, prose(i, 60)) for i in range(20)] + [(100 + i, near(prose(i % 5, 400), r, i % 4)) for i in range(40)] + [(200 + i, prose(1, 60)) for i in range(5)] + EDGES
    got = simhash.components(frame(spark, docs)).collect()
    fps = [brute_fingerprint(t) for _, t in docs]
    names = brute_components(fps)
    low = {}
    for (i, _), c in zip(docs, names):
        low[c] = min((x for x in (low.get(c), i) if x is not None), default=None)
    want = sorted((str(i), fp, str(low[c])) for (i, _), fp, c in zip(docs, fps, names))
    assert sorted((str(x.doc_id), x.fp % 2**64, str(x.component_id)) for x in got) == want
    assert simhash.components(frame(spark, [])).count() == 0


def test_simhash_on_a_table(spark):
    import duckdb

    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    fps = [brute_fingerprint(t) for _, t in rows]
    names = brute_components(fps)
    low = {}
    for (i, _), c in zip(rows, names):
        low[c] = min(low.get(c, i), i)
    want = sorted((i, f"{fp:016x}", low[c]) for (i, _), fp, c in zip(rows, fps, names))
    assert sorted(tuple(x) for x in queries.op13_simhash(spark, DATA).collect()) == want
    assert any(i != c for i, _, c in want)


@pytest.mark.parametrize("cell", [3, 40, 10**6])
def test_every_link_of_the_trie(spark, cell):
    """Random, clustered and extreme fingerprints: components equal brute force however small a cell may be."""
    r = random.Random(cell)
    fps = {0, 2**64 - 1, 1, 2**63, 3} | {r.getrandbits(64) for _ in range(100)}
    for centre in [r.getrandbits(64) for _ in range(6)]:
        x = centre
        for _ in range(25):
            x ^= sum(1 << b for b in r.sample(range(64), r.randrange(1, 5)))
            fps.add(x if r.random() < 0.5 else centre ^ (1 << r.randrange(64)))
    fps = sorted(fps)
    table = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp bigint")
    found = [(x.a % 2**64, x.b % 2**64) for x in simhash.links(table, cell=cell).collect()]
    at = {x: i for i, x in enumerate(fps)}
    low = simhash.least_of_each(len(fps), np.array([at[a] for a, _ in found]), np.array([at[b] for _, b in found]))
    assert low.tolist() == brute_components(fps)


# collocations


def brute_collocations(docs, least=10, share=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    rows = []
    for (lang, *p), a in f.items():
        if a < least or len(p) < 2:
            continue
        score, _, l, r = min((10**6 * a * a // (f[lang, *p[:k]] * f[lang, *p[k:]]), k, f[lang, *p[:k]], f[lang, *p[k:]]) for k in range(1, len(p)))
        over = [f[lang, *q] for (other, *q) in f if other == lang and len(q) > len(p) and f[lang, *q] >= least and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if not any(100 * x >= share * a for x in over):
            rows.append((lang, -score, -a, " ".join(p).encode(), l, r))
    out = []
    for lang, own in itertools.groupby(sorted(rows), key=lambda x: x[0]):
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (_, s, a, p, l, r) in enumerate(itertools.islice(own, top), 1)]
    return out


@pytest.fixture(scope="module")
def phrases():
    r = random.Random(5)
    words = "new york city of the é in hot dog ice Cream 你好 \x1cx a\x00b 1,2 e.g. wait! so\tand z".split(" ")
    texts = [" ".join(r.choice(words) if r.random() < 0.5 else "New York City" for _ in range(r.randrange(1, 60))) + r.choice(["", ". ", "\n", "\x0b tail"]) for _ in range(120)]
    texts += ["ha ha ha ha ha ha ha ha ha ha ha ha ha"] * 3 + [None, "", " . ! \n", "x" * 100_000, "very long " * 30_000]
    return [(["en", "de", None, "und", ""][i % 5], t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("top", [2000, 4])
def test_collocations(spark, phrases, top):
    docs = spark.createDataFrame([(i, t, lang, "r", 1, 2, "p", 3) for i, (lang, t) in enumerate(phrases)], SCHEMA).repartition(5)
    got = collocations.collocations(docs, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(x) for x in got.collect()) == sorted(brute_collocations(phrases, top=top))


def test_collocations_of_few_words(spark):
    assert collocations.collocations(frame(spark, [])).count() == 0
    assert collocations.collocations(frame(spark, [(1, None), (2, "...")])).count() == 0
    assert collocations.collocations(frame(spark, [(1, "ab cd"), (2, "ab cd")]), least=2).count() == 1


def test_full_sketch_changes_nothing(spark, phrases, monkeypatch):
    monkeypatch.setattr(collocations, "_size_of", lambda _: 14)  # few buckets: many phrases below the frequency are candidates
    docs = spark.createDataFrame(phrases, "lang string, text string")
    assert sorted(tuple(x) for x in collocations.collocations(docs).collect()) == sorted(brute_collocations(phrases))


def test_small_shards_hold_whole_texts(phrases):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([a or "und" for a, _ in phrases]), pa.array([t for _, t in phrases])], names=["lang", "text"])
    for size in (1, 50, 10**9):
        got = Counter((lang, w) for lang, words in collocations._shards(iter([batch]), size) for w in words)
        assert got == Counter((lang or "und", w) for lang, t in phrases for w in [*collocations.words_of((t or "").encode()), b"\xff"])


def test_exact_beyond_64_bits(spark):
    big = spark.createDataFrame([(3_000_000_000_000_001, 3_000_000_000_000_002, 4_000_000_000_000_003)], "a bigint, l bigint, r bigint")
    d = {x: F.col(x).cast("decimal(16,0)") for x in "alr"}
    got = big.select((d["a"] * d["a"] * F.lit(1_000_000).cast("decimal(7,0)")).alias("t"), (d["l"] * d["r"]).alias("b")).select(F.expr("t div b")).first()[0]
    assert got == 10**6 * 3_000_000_000_000_001**2 // (3_000_000_000_000_002 * 4_000_000_000_000_003)
