"""Operators with an exact contract against brute force, with nulls, empty texts, ties and repeats."""

import base64
import hashlib
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from panelforge.llm import byte_bpe, decontaminate, ngram_join, substring_dedup

LOWER = {i: i + 32 for i in range(65, 91)}
EDGES = [(900, None), (901, ""), (902, "   \n\t "), (903, "word"), (904, "a a a a a a a a a a a a"), (None, "no id at all here"), (905, "x" * 5000), (906, "Ünïcode — 你好   ß\x1c\x00 end")]


def near(text, every):
    return " ".join(w if i % every else w + "x" for i, w in enumerate(text.split(), 1))


@pytest.fixture(scope="module")
def corpus(prose):
    rows = [(i, prose(i, 40 + 17 * i)) for i in range(12)]
    rows += [(100 + i, rows[5][1]) for i in range(3)] + [(200 + i, near(rows[6][1], 60 + i)) for i in range(6)] + [(300 + i, near(rows[7][1], 9 + i)) for i in range(4)]
    passage = prose(77, 70)
    rows += [(400 + i, prose(50 + i, 30) + " " + passage + " " + prose(60 + i, 30)) for i in range(5)]
    rows += [(5, rows[5][1])]  # a repeated row
    return rows + EDGES


def test_ngram_join(docs, corpus):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.components(docs(corpus)).collect()}
    sets = []
    for i, t in corpus:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        k = min(5, len(w))
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if k else frozenset())
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= 80 * len(sets[a] | sets[b]):
                ra, rb = root[a], root[b]
                root = [rb if r == ra else r for r in root]
    least = {}
    for (i, _), r in zip(corpus, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    assert got == {(i, len(s), least.get(r, i)) for (i, _), s, r in zip(corpus, sets, root)}


def test_pairs_are_verified_by_texts(docs, spark):
    """Texts, not token arrays, are shuffled to their pairs; verdicts just at, over and under the threshold are exact."""
    words = [f"w{i}" for i in range(54)]
    texts = {1: words[:49], 2: words[:50] + ["x"], 3: words[:45], 4: [w.upper() for w in words[:49]] + ["y"] * 3, 5: ["z"] + words[5:49], 6: words[:40], 7: ["a", "b"], 8: words[:39]}
    sets = {i: frozenset(tuple(x.lower() for x in t[j : j + 5]) for j in range(max(1, len(t) - 4))) for i, t in texts.items()}
    pairs = [(i, j) for i in texts for j in texts if i < j]
    rows = spark.createDataFrame([(i, j, " ".join(texts[i]), " ".join(texts[j])) for i, j in pairs], "a bigint, b bigint, ta string, tb string")
    want = {(i, j) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert {(r.a, r.b) for r in ngram_join._linked(rows, 5, 80).collect()} == want and (1, 6) in want and (1, 8) not in want
    held = ngram_join._texts(docs([(1, "a b c d e f"), (2, "other"), (None, "g h")]), spark.createDataFrame([(0, 1, 1, 0)], "node bigint, doc_id bigint, is_a int, is_b int"), 5)
    assert held.columns == ["node", "text", "is_a", "is_b"]


def test_keep_one_keeps_columns(docs, corpus):
    kept = ngram_join.keep_one(docs(corpus))
    assert kept.columns == docs([]).columns
    ids = [r.doc_id for r in kept.collect()]
    assert 5 in ids and 100 not in ids and None in ids and 901 in ids


def test_substring_dedup(docs, corpus):
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept) for r in substring_dedup.deduplicate(docs(corpus)).collect())
    first, words = {}, []
    for i, t in corpus:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        words.append((i, w))
        for s in range(len(w) - 49):
            if i is not None:
                first[tuple(w[s : s + 50])] = min(first.get(tuple(w[s : s + 50]), i), i)
    want = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - 49):
            if i is not None and first[tuple(w[s : s + 50])] < i:
                gone.update(range(s, s + 50))
        want.append((i or -1 if i is not None else -1, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    assert got == sorted((a if a else -1, *r) for a, *r in want)
    assert sum(r[2] for r in got) > 500


def test_decontaminate(spark, docs, prose):
    items = spark.createDataFrame([(1, prose(1, 30)), (2, "Short, ITEM here"), (3, None), (4, "...") , (2, "Short, ITEM here"), (None, prose(9, 20))], "item_id bigint, text string")
    rows = [(1, "x. " + prose(1, 30).upper().replace(" ", " - ") + " y"), (2, "a short item HERE b"), (3, prose(1, 9)), (4, prose(2, 50)), *EDGES]
    found = {r.doc_id: r for r in decontaminate.find_overlaps(docs(rows), items).collect()}
    assert found[1].n_hit == 30 and found[1].item_ids == ["1"] and found[2].item_ids == ["2"] and found[2].n_hit == 3
    text, span = rows[1][1], found[2].spans[0]
    assert text[span.begin : span.end] == "short item HERE"
    assert not found[3].n_hit and not found[4].n_hit and not found[900].n_words
    split = {r.doc_id: (r.n_hit, r.item_ids) for r in decontaminate.find_overlaps(docs(rows), items, max_bytes=40).collect()}
    assert split == {k: (r.n_hit, r.item_ids) for k, r in found.items()}
    kept = decontaminate.decontaminate(docs(rows), items)
    assert kept.columns == docs([]).columns and {r.doc_id for r in kept.collect()} == set(found) - {1, 2}
    assert decontaminate.decontaminate(docs(rows), items.limit(0)).count() == len(rows)


def test_bpe_round_trip(docs, corpus):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    vocab = byte_bpe.Vocabulary(path, public_tokenizers.PATTERN)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(i, (t or "") and t + " it's 12ab!!  \n\n x y 🙂🙂 Straße aaaaaaaaaaaaaaaaaaa") for i, t in corpus]
    for more in ({}, {"block_bytes": 100, "dictionary_words": 5}):
        ids = byte_bpe.encode(docs(rows), vocab, **more)
        assert sorted((r.doc_id or -1, list(r.ids)) for r in ids.collect()) == sorted((i or -1, other.encode_ordinary(t)) for i, t in rows)
        assert sorted((r.doc_id or -1, bytes(r.decoded).decode()) for r in byte_bpe.decode(ids, vocab).collect()) == sorted((i or -1, t) for i, t in rows)
    odd = docs([]).sparkSession.createDataFrame([(1, [-1, 60000, None]), (2, None)], "doc_id bigint, ids array<int>")
    assert [bytes(r.decoded) for r in byte_bpe.decode(odd, vocab).collect()] == [b"", b""]


def test_registered_digests(spark):
    """The registered query against another tokenizer library, over a whole table."""
    from panelforge.llm import queries

    path, data = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "/root/testdata/sf0.001"
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in queries.table(spark, data, "documents").collect():
        ids = other.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    got = queries.op3_byte_bpe(spark, data)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_empty_tables(docs, spark):
    none = docs([])
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert ngram_join.components(none).count() == substring_dedup.deduplicate(none).count() == decontaminate.find_overlaps(none, items).count() == 0
    vocab = byte_bpe.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert byte_bpe.encode(none, vocab).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_long_documents_in_pieces(docs, corpus, prose, monkeypatch):
    """Documents over PIECE_WORDS have the same result: a lowered bound stands in for 16 million words."""
    rows = corpus + [(1000, prose(1, 300) + " " + prose(7, 159) + " " + prose(2, 300)), (1001, prose(3, 20) + " " + prose(1, 300))]
    want = sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept) for r in substring_dedup.deduplicate(docs(rows)).collect())
    monkeypatch.setattr(substring_dedup, "PIECE_WORDS", 128)
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept) for r in substring_dedup.deduplicate(docs(rows)).collect())
    assert got == want and sum(r[2] for r in got) > 0
    starts = [b + i for b, e in substring_dedup._pieces(1000, 128) for i in range(e - b - substring_dedup.WINDOW + 1)]
    assert starts == list(range(1000 - substring_dedup.WINDOW + 1))
    pieces = list(substring_dedup._pieces((1 << 24) + 5, 1 << 20))
    assert pieces[-1][1] == (1 << 24) + 5 and max(e - b for b, e in pieces) <= 1 << 20


def test_long_words(spark):
    """Unbroken words of up to a megabyte encode as tiktoken does, and merges from a heap equal folded ones."""
    import random

    import numpy as np

    from panelforge.llm import queries

    r = random.Random(4)
    vocab = queries.vocabulary()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    letters = lambda n, of: "".join(r.choice(of) for _ in range(n))
    long = [letters(1_000_000, "etaoinshrdlu"), "x" * 20_000, letters(6000, "äöüé"), letters(5000, "!?#-"), letters(513, "abc"), letters(512, "abc"), " " * 3000, letters(4000, "0123456789")]
    long += [f"{letters(700, 'the')} and {letters(900, 'er')}", "short"]
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id bigint, text string")
    got = {x.doc_id: x.ids for x in byte_bpe.encode(docs, vocab).collect()}
    # the library takes quadratic time itself: the megabyte is held against pieces of it that no merge can cross
    for i, t in enumerate(long[1:], 1):
        assert got[i] == library.encode_ordinary(t), i
    pieces = vocab.pieces
    assert b"".join(pieces[x] for x in got[0]).decode() == long[0]
    pairs = {a << 17 | b: k for a, row in vocab.pairs().items() for b, k in row.items()}
    base = np.array([vocab.ranks[bytes([b])] for b in range(256)])
    for _ in range(200):
        w = letters(r.randrange(2, 60), "etaoin s" if r.random() < 0.5 else "aé你").strip().encode() or b"a"
        assert byte_bpe.merge_long(w, base, pairs) == library._encode_single_piece(w)
    whole = library.encode_ordinary(long[0][:30_000])
    assert got[0][: len(whole) - 20] == whole[: len(whole) - 20]  # merges are local: only the last few can differ


def test_encoding_keeps_literals_out_of_plans(spark):
    """The rank map is a broadcast row: no plan holds it as text, and the session's settings stay as they are."""
    from panelforge.llm import queries

    before = spark.conf.get("spark.sql.maxPlanStringLength")
    docs = spark.createDataFrame([(1, "an unheardofword, naïvely ①ßé\u00a0\x1c\x85 𝔘𝔫 ½²x")], "doc_id bigint, text string")
    out = byte_bpe.encode(docs, queries.vocabulary())
    assert spark.conf.get("spark.sql.maxPlanStringLength") == before
    assert len(out._jdf.queryExecution().logical().toString()) < 100_000
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=queries.vocabulary().ranks, special_tokens={})
    assert out.first().ids == library.encode_ordinary(docs.first().text)


def test_words_are_folded_once(spark):
    """A lambda's expressions are evaluated as often as they are written: the fold is written once."""
    words = F.transform("words", lambda w: byte_bpe.merge_all(w, F.col("shift"), F.col("entry")))
    df = spark.createDataFrame([], "words array<array<bigint>>, shift array<int>, entry array<bigint>").select(words.alias("ids"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("sequence(") == plan.count("array_min(") == plan.count("array_position(") == 1


def test_dictionary_words_from_ids():
    """Frequent words are put together from their ids, beside the vocabulary's own words; none is an empty dictionary."""
    import numpy as np

    from panelforge.llm import queries

    vocab = queries.vocabulary()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    for frequent in ([" unheardofword", "naïvelyé", "𝔘𝔫你好吗"], []):
        ids = [library.encode_ordinary(w) for w in frequent]
        at, values, begins = byte_bpe._dictionary(vocab, np.array(sum(ids, []), np.int32), np.array([len(x) for x in ids], np.int32))
        listed = list(at)
        assert listed[len(listed) - len(frequent) :] == frequent and len(begins) == len(listed) + 1 and list(at.values()) == list(range(len(at)))
        assert all(values[begins[i] : begins[i + 1]].tolist() == library.encode_ordinary(w) for i, w in enumerate(listed) if i % 997 == 0 or w in frequent)


def test_finder_equals_the_library():
    """Texts below U+10000 are split by another library's pattern: all characters, in several surroundings."""
    import regex

    find, general = byte_bpe._finder(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN).findall
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 97 == 0 or c in (0xFEFF, 0xFFFF, 0x10000)):
            text = f"a{chr(c)} {chr(c)}1{chr(c)}{chr(c)}! é{chr(c)}"
            assert find(text) == general(text), hex(c)


def test_parts_of_a_large_benchmark(spark, docs, prose):
    """Five parts give what one does, a worker builds one automaton a part, and each part's pass is released."""
    items = [(f"i{n}", prose(900 + n, 14)) for n in range(30)] + [("short", "two words"), ("none", "!!"), (None, "x y"), ("nul", None)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = [(n, f"{prose(n, 30)} {items[n % 30][1]} {prose(50 + n, 9)} {items[(7 * n) % 30][1]}") for n in range(40)] + [(100 + n, prose(200 + n, 60)) for n in range(20)] + EDGES + [(3, None), (5, "Two, WORDS."), (5, "Two, WORDS.")]
    size = sum(len((t or "").encode()) for i, t in items if i)
    one, five = (sorted(map(str, decontaminate.find_overlaps(docs(rows), bench, max_bytes=b).collect())) for b in (size, -(-size // 5)))
    assert one == five and sum("n_hit=0" not in r for r in one) > 40
    kept = [sorted(map(str, decontaminate.decontaminate(docs(rows), bench, max_bytes=b).collect())) for b in (size, -(-size // 5))]
    assert kept[0] == kept[1] and 0 < len(kept[0]) < len(rows)
    assert decontaminate._n_parts(decontaminate._items(bench), -(-size // 5)) == 5
    assert decontaminate.find_overlaps(docs([]), bench, max_bytes=50).count() == decontaminate.decontaminate(docs([]), bench, max_bytes=50).count() == 0
    built = decontaminate._automaton.cache_info().misses
    for part in ("a", "b", "c", "d", "e"):
        for _ in range(7):  # slices of a task
            decontaminate._automaton(((part, b"w " * 12),), 10)
    assert decontaminate._automaton.cache_info().misses - built == 5 and decontaminate._automaton.cache_info().currsize == 1
