"""Learned operators: held-out quality on the synthetic tables, base statistics, edges, disguises."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import doc_features, gam_quality, ngram_quality, queries, toxicity
from panelforge.llm.words import WordHashes

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet").toPandas().set_index("doc_id")


def test_gam_held_out(spark, labels):
    got = queries.op1_gam_quality(spark, DATA).toPandas().set_index("doc_id").join(labels, how="inner")
    held = got[got.held_out]
    assert ((held.predicted == 1) == (held.quality == 1)).mean() > 0.9 and got.score.between(0, 1).all()


def test_toxicity_held_out(spark, labels):
    got = queries.op4_toxicity(spark, DATA).toPandas().set_index("doc_id").join(labels, how="inner")
    held = got[got.held_out]
    assert ((held.predicted == 1) == (held.toxic == 1)).mean() > 0.9


def test_quality_rules_base_statistics(spark):
    got = queries.op10_ngram_quality(spark, DATA).toPandas().set_index("doc_id")
    for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(200).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        lines = [x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        hit = {i + j for i, x in enumerate(wins) if wins.count(x) > 1 for j in range(5)} if len(wins) < 400 else None
        g = got.loc[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)))
        assert hit is None or g.n_repeat_words == len(hit)
        assert not (g.base_failed and g.kept)


def test_edges(spark, docs):
    rows = [(1, None), (2, ""), (3, "x"), (None, "a b c"), (3, "x"), (4, "word " * 3000)]
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    d = docs(rows)
    gam, gram, lex = gam_quality.train(d, none, "quality"), ngram_quality.train(d, none), toxicity.train(d, none)
    assert gam_quality.score(d, gam).where("score between 0 and 1").count() == len(rows)
    judged = ngram_quality.judge(d, gram)
    assert judged.count() == len(rows) and judged.where("kept").count() == 0
    assert toxicity.score(d, lex).where("score < 0.7").count() == len(rows)
    assert toxicity.reject(d, lex).columns == d.columns and toxicity.reject(d.limit(0), lex).count() == 0


def test_disguises_and_exceptions():
    lex = toxicity.Lexicon({"idiot": 3.0, "trash": 3.0, "zarg*": 2.0})
    a = lex.automaton()
    for text in ("an IDIOT!", "an 1d1ot", "an іdіоt", "id​iot", "zargment", "ｉｄｉｏｔ"):
        assert toxicity.total(a, text)[0] > 0, text
    for text in ("the trash can", "idiotic", "unidiot", "azargs", None, ""):
        assert toxicity.total(a, text)[0] == 0, text


def test_features_of_empty_text():
    h = WordHashes()
    assert doc_features.features(b"", h) == [0.0] * len(doc_features.NAMES) and doc_features.base_stats(b" \n", h) == (0, 0, 0, 0, 0)


def test_gam_learns_a_pair():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = gam_quality.fit(x, y)
    assert (1, 0) in m.pairs and ((m.score(x) > 0.5) == (y > 0)).mean() > 0.85


def test_training_sample_is_bounded(spark):
    from panelforge.llm.labelled import labelled_sample

    docs, labels = (queries.table(spark, DATA, t) for t in ("documents", "labels"))
    one, two = (labelled_sample(d, labels, "quality", 50) for d in (docs, docs.repartition(7)))
    assert one.count() == 50 and not set(one.select("doc_id").collect()) ^ set(two.select("doc_id").collect())
    assert labelled_sample(docs, labels, "quality", 50, F.lit(False)).count() == 0


def test_labelled_sample_is_bounded(docs, spark):
    from panelforge.llm.labelled import labelled_sample

    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, None), (None, 1)], "doc_id bigint, quality int")
    rows = docs([(1, "b"), (1, "a"), (1, "b"), (2, None), (3, "c")])
    assert sorted(map(tuple, labelled_sample(rows, labels, "quality", 10).collect())) == [(1, "a", 1), (2, "", 1)]
    assert labelled_sample(rows, labels, "quality", 1).count() == 1


def test_character_grams_are_characters():
    grams = ngram_quality.character_grams
    assert [len(grams(x.encode())) for x in ("", "abc", "abcd", "数据质量", "a数据😀é")] == [0, 0, 1, 1, 2]
    whole, part = grams("x数据质量 abcd".encode()), grams("数据质量".encode())
    assert whole[1] == part[0] and whole[-1] == grams(b"abcd")[0] and len(set(whole.tolist())) == len(whole)
    assert len(grams(b"\xff\xfeabc")) == 2


def test_explained_base_words_keep_a_weight():
    y = np.array([1.0] * 8 + [0.0] * 40)
    found = [np.array([0, 1]) if i < 4 else np.array([1]) if i < 8 else np.array([], int) for i in range(48)]
    assert toxicity.choose(["idiot", "zargle"], found, y).keys() == {"idiot", "zargle"}
    assert toxicity.choose(["idiot", "idio*"], found, y).keys() == {"idio*"}


def test_exceptions_cover_what_lies_in_them():
    lex = toxicity.Lexicon({"trash": 1.0, "idiot": 2.0}, exceptions=("trash can", "the trash", "idiot proof trash can"))
    a = lex.automaton()
    cases = {"trash can trash": 1.0, "the trash": 0.0, "idiot proof trash can idiot": 2.0, "idiot proof trash": 3.0, "trash trash can": 1.0}
    assert {t: toxicity.total(a, t)[0] for t in cases} == cases
    assert toxicity.total(a, "trash can trash " * 20000)[0] == 20000.0
