"""One registered query for each operator, over its whole table, and its DuckDB text where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf, pieces, warc
from .common import shared_path
from .divergence import source_divergence
from .kdtree import kd_shards
from .mixing import mix_sources
from .multi_index import near_duplicates
from .ngram_join import similar_groups
from .phrases import collocations
from .rabitq import nearest
from .repair import encode_and_read
from .suffix_dedup import remove_repeats
from .term_search import top_products


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


def op2_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    if pages.isEmpty():
        return spark.createDataFrame([], "page_id long, volume int, `offset` long, length long, sha256 string, status string")
    first = warc.write_warc(pages, shared_path(spark, "warc"))
    second = warc.copy_warc(spark, first, shared_path(spark, "warc"), warc.bit_rot)
    out = warc.audited(spark, first, second)
    return out.select(F.expr("try_cast(record_id AS long)").alias("page_id"), "volume", "offset", "length", "sha256", "status")


def op3_repair_ids(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    return encode_and_read(_table(spark, sf_dir, "documents"), public_tokenizers.path(tokenizer))


def op4_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = crf.fit(docs.where(~crf.held_out() & F.col("doc_id").isNotNull()))
    return crf.predict(docs, model).select("doc_id", crf.held_out().alias("held_out"), "lang_pred", "score")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards(_table(spark, sf_dir, "documents"), n_shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(_table(spark, sf_dir, "documents"), width=3, threshold=0.9)


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.93).select("vec_id", "n_links", "component_id", "kept")


def op9_sentence_pieces(spark: SparkSession, sf_dir: str, model: str = "piece_bpe_32k.model") -> DataFrame:
    vocabulary = pieces.Vocabulary(public_tokenizers.path(model))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.decode(pieces.encode(docs, vocabulary), vocabulary)
    return out.select("doc_id", "n_pieces", "ids_crc32", F.octet_length("decoded").cast("long").alias("decoded_bytes"), F.crc32("decoded").alias("decoded_crc32"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_epochs=3)
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents").select("text", "lang"), least=100, factor=1000, top=2000)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents").select("text", "lang", "source"), min_docs=3, top_terms=200)


def op13_term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(_table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_one_bit_codes": op1_one_bit_codes,
    "op2_merkle_audit": op2_merkle_audit,
    "op3_repair_ids": op3_repair_ids,
    "op4_crf_language": op4_crf_language,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_kd_tree_shards": op6_kd_tree_shards,
    "op7_ngram_join": op7_ngram_join,
    "op8_multi_index": op8_multi_index,
    "op9_sentence_pieces": op9_sentence_pieces,
    "op10_mix_sources": op10_mix_sources,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_source_divergence": op12_source_divergence,
    "op13_term_search": op13_term_search,
}

ORACLE: dict[str, str] = {
    "op7_ngram_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 90 * (p.n + q.n - k)),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN reached r ON r.a = d.doc_id GROUP BY d.doc_id""",
    "op8_multi_index": """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a),
least_reached AS (SELECT a, min(b) AS m FROM reached GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN counted c ON c.a = vec_id LEFT JOIN least_reached l ON l.a = vec_id""",
    "op10_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 3 AS cap FROM sums),
levels AS (  -- sources by the level at which they reach their cap
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before,
         sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left,
         sum(source_size) OVER () AS total FROM weighed),
level AS (
  SELECT coalesce(arg_min((total - caps_before)::DOUBLE / weights_left::DOUBLE, cap::DOUBLE / weight), 'inf'::DOUBLE) AS level FROM levels
  WHERE (total - caps_before)::DOUBLE / weights_left::DOUBLE < cap::DOUBLE / weight),
targets AS (
  SELECT source, source_size, CASE WHEN cap <= weight * level THEN cap::DOUBLE ELSE weight * level END AS target FROM weighed, level),
split AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
ordered AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.whole, t.target - t.whole * t.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size / 2.0 AS middle
  FROM sized s JOIN split t ON s.source IS NOT DISTINCT FROM t.source),
taken AS (SELECT *, whole + CASE WHEN rest > 0 AND middle <= rest THEN 1 ELSE 0 END AS copies FROM ordered)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies::BIGINT AS copies FROM taken""",
    "op11_phrase_collocations": r"""
WITH pieces AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase
  FROM words, range(1, 6) s(m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
often AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE f >= 100),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM often WHERE m >= 2) c
  JOIN often x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : k], ' ')
  JOIN often y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1 : c.m], ' ') JOIN n ON n.lang = c.lang),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (
  SELECT lang, array_to_string(w[i : i + j - 1], ' ') AS phrase, f FROM (
    SELECT *, unnest(range(1, m - j + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS j FROM often WHERE m >= 3))),
covered AS (SELECT lang, phrase, max(f) AS cover FROM parts GROUP BY ALL),
ranked AS (
  SELECT x.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest x LEFT JOIN covered USING (lang, phrase) WHERE cover IS NULL OR 100 * cover < 100 * a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000""",
    "op12_source_divergence": r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
words AS (SELECT lang, source, id, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT id) >= 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c,
         (1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (sum(coalesce(c, 0)) OVER (PARTITION BY g.lang, g.source) + v))::BIGINT AS p
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN counts x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
pairs AS (
  SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p)::HUGEINT * (x.p - y.p)) // y.p)::BIGINT AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
all_pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs z ON z.lang = a.lang AND z.source = a.source AND z.item = b.source),
whole AS (
  SELECT lang, term, (1 + (1000000000::HUGEINT * (c + 1)) // (sum(c) OVER (PARTITION BY lang) + v))::BIGINT AS q
  FROM (SELECT lang, term, sum(c) AS c FROM counts GROUP BY ALL) JOIN v USING (lang)),
terms AS (
  SELECT p.lang, source, term AS item, (((p - q)::HUGEINT * (p - q)) // q)::BIGINT AS value FROM p JOIN whole USING (lang, term) WHERE c > 0 AND p > q),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM all_pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts QUALIFY part = 'pair' OR rank <= 200""",
    "op13_term_search": """
WITH weights AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) IS NOT FALSE),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * d.w[i]))::BIGINT AS score
  FROM weights q JOIN weights d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 10""",
}
