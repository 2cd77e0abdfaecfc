"""One query for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import decontaminate, hmm, language, lines, minhash, packing, passages, topk, toxicity, warc
from .common import id_remainder, table

QUERIES: dict[str, Callable[..., DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    out = language.predict(docs, language.fit(language.training_rows(docs)))
    return out.withColumn("held_out", id_remainder("doc_id", 4) == 2)


@query
def op2_line_dedup(spark, sf):
    return lines.report(table(spark, sf, "documents"))


@query
def op3_warc(spark, sf):
    return warc.captures(table(spark, sf, "pages"))


@query
def op4_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    out = toxicity.score(docs, toxicity.fit(docs, table(spark, sf, "labels")))
    return out.withColumns({"held_out": id_remainder("doc_id", 5) == 0, "predicted": (F.col("score") >= 0.5).cast("int")})


@query
def op5_passages(spark, sf):
    return passages.report(table(spark, sf, "documents"))


@query
def op6_minhash(spark, sf):
    return minhash.classes(table(spark, sf, "documents"))


@query
def op7_hmm(spark, sf):
    docs = table(spark, sf, "documents")
    out = hmm.score(docs, *hmm.fit(hmm.training_rows(docs)))
    return out.withColumn("held_out", id_remainder("doc_id", 7) == 2)


@query
def op8_topk(spark, sf):
    return topk.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op9_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"), tokenizer_path())


@query
def op10_decontaminate(spark, sf):
    return decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("spans", "items")


_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES["op10_decontaminate"] = f"""WITH d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format('text')} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bp AS (SELECT item, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i, w FROM b WHERE len(w) > 0),
pat AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS p FROM bp),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
hit AS (SELECT dp.doc_id, dp.i, pat.m, pat.item FROM (SELECT DISTINCT m FROM pat) l JOIN dp ON dp.i + l.m - 1 <= len(dp.w)
  JOIN pat ON pat.m = l.m AND pat.p = array_to_string(dp.w[dp.i:dp.i + l.m - 1], ' ')),
cov AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS x FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"""

ORACLES["op8_topk"] = """WITH v AS (SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 20"""
