"""The pipeline's rows against plain Python versions of its stages, on the given documents and planted ones."""

import base64
import hashlib
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_lines_urls_chats import brute_components

import corpus_pipeline
from panelforge.llm import queries, toxicity

DATA = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}


def line_dedup(docs):
    """Of similar lines the first by doc_id and line stays."""
    place, first = {}, []
    for i, text in sorted(docs.items()):
        for n, line in enumerate((text or "").split("\n")):
            if re.search(r"[^ \t-\r]", line):
                if line not in place:
                    place[line] = len(first)
                    first.append((line, i, n))
    names = brute_components([line for line, _, _ in first])
    keep = {}
    for k, root in enumerate(names):
        keep.setdefault(root, (first[k][1], first[k][2]))  # the distinct lines are in the order of their first places
    out = {}
    for i, text in docs.items():
        if text is None:
            out[i] = None
            continue
        lines = text.split("\n")
        out[i] = "\n".join(x for n, x in enumerate(lines) if x not in place or keep[names[place[x]]] == (i, n))
    return out


def one_of_each(docs):
    """The smallest doc_id of each group of documents whose 5-word shingle sets reach 0.8."""
    sets = {}
    for i, t in docs.items():
        w = re.findall(r"[^ \t-\r]+", (t or "").translate(LOWER))
        k = min(5, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                small, large = sorted((len(sets[a]), len(sets[b])))
                common = len(sets[a] & sets[b]) if 100 * small >= 80 * large else 0
                if common and 100 * common >= 80 * (small + large - common):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: t for i, t in docs.items() if find(i) == i}


def clean_of(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for t in items:
        w = words(t)
        k = min(10, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            windows.setdefault(k, set()).add(tuple(w[j : j + k]))
    out = {}
    for i, t in docs.items():
        w = words(t)
        if not any(tuple(w[j : j + k]) in own for k, own in windows.items() for j in range(len(w) - k + 1)):
            out[i] = t
    return out


@pytest.fixture(scope="module")
def tables(spark, prose, tmp_path_factory):
    """The given tables with planted documents: copies, near copies, repeated lines, passages, nulls, toxic texts."""
    top = f"{tmp_path_factory.mktemp('pipeline')}"
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("labels", "benchmark"))
    toxic = docs.join(labels.where("toxic = 1"), "doc_id").orderBy("doc_id").first().text
    passage = benchmark.where("text is not null").orderBy(F.desc(F.length("text"))).first().text
    a, b = prose(500, 120), prose(501, 90)
    broken = lambda n: "\n".join(" ".join(prose(507, 200).split()[i : i + n]) for i in range(0, 200, n))  # noqa: E731  no line alike, all words
    planted = [
        (90_000, a), (90_001, a), (90_002, a.replace(a.split()[60], "other")), (90_003, f"{b}\n{prose(502, 80)}"), (90_004, f"{b}\n{prose(503, 80)}"), (90_005, f"{prose(504, 40)} {passage} {prose(505, 40)}"),
        (90_006, toxic), (90_007, None), (90_008, ""), (90_009, "\n\n"), (90_010, "short one"), (90_011, "short one"), (90_012, prose(506, 3000)), (90_013, f"{b.replace(b.split()[40], 'altered')}\nand an own line"),
        (90_014, broken(9)), (90_015, broken(23)),
    ]
    extra = spark.createDataFrame([(i, t, "en", "planted", len(t or "")) for i, t in planted], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.unionByName(extra.select(docs.columns)).write.parquet(f"{top}/documents.parquet")
    labels.write.parquet(f"{top}/labels.parquet")
    benchmark.write.parquet(f"{top}/benchmark.parquet")
    return top


def test_rows_equal_brute_force(spark, tables):
    docs = queries.table(spark, tables, "documents")
    lexicon = toxicity.train(docs, queries.table(spark, tables, "labels"), "toxic", queries.toxicity_train_rows())
    scores = {r.doc_id: r.score for r in toxicity.score(docs, lexicon).select("doc_id", "score").collect()}
    kept = {r.doc_id: r.text for r in docs.collect() if scores[r.doc_id] < toxicity.REJECT_AT}
    assert 90_006 not in kept and {90_000, 90_003, 90_008} <= set(kept)
    left = line_dedup(kept)
    singles = one_of_each(left)
    clean = clean_of(singles, [r.text for r in queries.table(spark, tables, "benchmark").collect()])
    assert 90_005 not in clean and len(clean) < len(singles) < len(left)
    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = set()
    for i, t in clean.items():
        ids = coder.encode_ordinary(t or "")
        want.add((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    got = {tuple(r) for r in corpus_pipeline.run(spark, tables).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    assert got == want


def test_stages_bear_clashing_columns_and_empty_tables(spark, tables):
    """Every filtering stage keeps all columns, whatever their names, and takes a table without rows."""
    docs = queries.table(spark, tables, "documents").where("doc_id >= 90000")
    odd = docs.select("*", *(F.lit(i).alias(x) for i, x in enumerate(["_pf_slot", "_pf_maybe", "node", "key", "row", "th", "line", "score", "component_id", "id"])))
    n = odd.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, tables)
        assert out.columns == odd.columns, name
        assert 0 < out.where("key = 3 and th = 5 and id = 9").count() <= n, name
        assert stage(spark, odd.where("false"), tables).count() == 0, name
        assert stage(spark, docs.unionByName(docs), tables).count() >= out.count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, odd.where("false"), tables).count() == 0
