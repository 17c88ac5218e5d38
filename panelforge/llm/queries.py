"""The registered queries: each applies one operator with production parameters to whole tables."""

from __future__ import annotations

import functools
import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, collocations, decontaminate, fill_in_middle, gam_quality, line_dedup, ngram_join, ngram_quality, simhash, substring_dedup, toxicity, url_filters
from .labelled import fold_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(mod: int):
    return F.coalesce(fold_of(F.col("doc_id"), mod), F.lit(-1))


def op1_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = gam_quality.train(docs, labels, "quality", _fold(5) != 0)
    return gam_quality.score(docs, model).select(
        "doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@functools.cache
def vocabulary() -> byte_bpe.Vocabulary:
    return byte_bpe.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def encoded_digests(docs: DataFrame) -> DataFrame:
    vocab = vocabulary()
    digits = [str(i) for i in range(vocab.size)]

    def digests(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(1)
        listed = [hashlib.sha256(",".join(map(digits.__getitem__, x)).encode()).hexdigest() for x in byte_bpe.id_lists(ids)]
        decoded = [hashlib.sha256(x).hexdigest() for x in byte_bpe.decode_batch(ids, vocab)]
        columns = [batch.column(0), ids.value_lengths().cast(pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return byte_bpe.encode(docs, vocab, each=digests, schema="doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(table(spark, sf_dir, "documents"))


def toxicity_train_rows():
    return _fold(3) != 1


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.train(docs, labels, "toxic", toxicity_train_rows())
    return toxicity.score(docs, lexicon).select(
        "doc_id", (_fold(3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.REJECT_AT).cast("int").alias("predicted")
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"))
    n_left = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n")))
    return line_dedup.deduplicate(docs).select("doc_id", "n_lines", n_left.cast("bigint").alias("n_left"), F.sha2("text", 256).alias("kept_sha256"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Pages as captures: the synthetic table has no fetch date, so one is derived from the page_id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7919 % 366).cast("int")).alias("fetched_at"))


def page_list_events(pages: DataFrame) -> DataFrame:
    """A dated list history over the pages' hosts, derived from a digest of each host."""
    hosts = pages.select(url_filters.host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    hosts = hosts.withColumn("h", F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("int"))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    parent = F.regexp_replace("host", r"^[^.]*\.", "")
    h = F.col("h")
    event = lambda name, rule, action, n: F.struct(F.lit(name).alias("list_name"), rule.alias("rule"), F.lit(action).alias("action"), day(n).alias("at"))
    spam = F.array(event("spam", F.col("host"), "add", h % 200), event("spam", F.col("host"), "remove", h % 200 + 60 + h % 100))
    adult = F.array(event("adult", parent, "add", h % 330))
    none = F.array().cast("array<struct<list_name:string,rule:string,action:string,at:date>>")
    events = F.concat(F.when(h % 3 == 0, spam).otherwise(none), F.when((h % 50 == 0), adult).otherwise(none))
    return hosts.select(F.inline(events))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = url_filters.evaluate(page_captures(pages), page_list_events(pages))
    lists = F.array_join(F.array_sort(F.array_distinct(F.transform("_active", lambda e: e["list_name"]))), ",")
    return found.select("page_id", F.coalesce("_host", F.lit("")).alias("host"), "fetched_at", F.size("_active").cast("bigint").alias("n_active"), lists.alias("lists"), (F.size("_active") > 0).alias("blocked"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.read_back(chat_format.format_messages(chat_format.reconstruct(chat_format.from_turns(turns))))


def op10_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ngram_quality.judge(docs, ngram_quality.train(docs, table(spark, sf_dir, "labels"))).drop("probability")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transform(table(spark, sf_dir, "documents"))
    return made.select(
        F.col("row.doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return simhash.components(table(spark, sf_dir, "documents")).select("doc_id", digits.alias("fingerprint"), "component_id")


QUERIES = {
    "op1_gam_quality": op1_gam_quality,
    "op2_decontaminate": op2_decontaminate,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_line_dedup": op5_line_dedup,
    "op6_url_filters": op6_url_filters,
    "op7_ngram_join": op7_ngram_join,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_chat_format": op9_chat_format,
    "op10_ngram_quality": op10_ngram_quality,
    "op11_collocations": op11_collocations,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_simhash": op13_simhash,
}
#: DuckDB SQL for the same rows.
ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": r"""
WITH items AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
wins AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM (SELECT item_id, w, least(10, len(w)) AS k FROM items WHERE len(w) > 0))),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
starts AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM docs, (SELECT DISTINCT k FROM wins) WHERE len(w) >= k)),
hits AS (SELECT s.doc_id, s.i, s.k, x.item_id FROM starts s JOIN wins x ON s.k = x.k AND s.win = x.win),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS pos FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
""",
    "op6_url_filters": r"""
WITH caps AS (
  SELECT page_id, regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '\.+$', '') AS host,
    DATE '2024-01-01' + CAST(page_id * 7919 % 366 AS INTEGER) AS fetched_at FROM pages),
hosts AS (SELECT host, CAST('0x' || substr(md5(host), 1, 6) AS INTEGER) AS h FROM (SELECT DISTINCT host FROM caps WHERE host IS NOT NULL AND host != '')),
events AS (
  SELECT 'spam' AS list_name, host AS rule, DATE '2024-01-01' + h % 200 AS valid_from, DATE '2024-01-01' + (h % 200 + 60 + h % 100) AS valid_to FROM hosts WHERE h % 3 = 0
  UNION ALL
  SELECT 'adult', regexp_replace(host, '^[^.]*\.', ''), min(DATE '2024-01-01' + h % 330), NULL FROM hosts WHERE h % 50 = 0 GROUP BY 2),
active AS (
  SELECT page_id, list_name, rule FROM caps c JOIN events e ON (c.host = e.rule OR ends_with(c.host, '.' || e.rule))
  WHERE valid_from <= fetched_at AND (valid_to IS NULL OR fetched_at < valid_to)),
each AS (SELECT page_id, count(DISTINCT list_name || ' ' || rule) AS n_active, string_agg(DISTINCT list_name, ',' ORDER BY list_name) AS lists FROM active GROUP BY 1)
SELECT c.page_id, coalesce(host, '') AS host, fetched_at, coalesce(n_active, 0) AS n_active, coalesce(lists, '') AS lists, coalesce(n_active, 0) > 0 AS blocked
FROM caps c LEFT JOIN each USING (page_id)
""",
    "op8_substring_dedup": r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 49], ' ')) AS win FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS s FROM docs WHERE len(w) >= 50)),
firsts AS (SELECT win, min(doc_id) AS first FROM wins GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 49)) AS i FROM wins JOIN firsts USING (win) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS i, unnest(w) AS word FROM docs),
kept AS (SELECT x.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY x.i) AS t FROM words x ANTI JOIN gone g ON x.doc_id = g.doc_id AND x.i = g.i GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs d LEFT JOIN kept USING (doc_id)
""",
    "op7_ngram_join": r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + least(5, len(w)) - 1], ' ')) AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - least(5, len(w)) + 1)) AS i FROM docs WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2)
  JOIN n nx ON nx.doc_id = a JOIN n ny ON ny.doc_id = b WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM docs d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1) USING (doc_id)
""",
    "op11_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, k, phrase, a, c, array_to_string(w[1 : c], ' ') AS x, array_to_string(w[c + 1 : k], ' ') AS y FROM (SELECT *, unnest(generate_series(1, k - 1)) AS c FROM cand)),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, c, l.f AS l, r.f AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
longer AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS phrase FROM cand WHERE k = 3) GROUP BY 1, 2),
kept AS (SELECT low.* FROM low LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
""",
    "op12_fill_in_middle": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tok, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT *, len(tok) AS n, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2, CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM t),
f AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi FROM h),
c AS (SELECT *, array_to_string(tok[1 : lo], '') AS p, array_to_string(tok[lo + 1 : hi], '') AS m, array_to_string(tok[hi + 1 : n], '') AS s FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form != 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form != 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM c
""",
}
