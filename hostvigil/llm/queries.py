"""One query per operator over the whole given tables, and DuckDB statements where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostvigil.llm import decontaminate, fertility, filter_audit, importance, language, licenses, mixing, pii, quality, simhash, tokens, toxicity, warc
from hostvigil.llm.common import fold_of, table

Query = Callable[[SparkSession, str], DataFrame]
BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def texts(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", *more)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document; a null or empty text has none."""
    counted = tokens.count_tokens(texts(spark, sf_dir), public_tokenizers.path(BYTE_BPE))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document; texts without words share fingerprint 0."""
    return simhash.near_duplicates(texts(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document; null and empty texts are clean."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontaminate.search_benchmark(texts(spark, sf_dir), items).drop("text")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out; und without a letter."""
    docs = texts(spark, sf_dir, "lang")
    held = fold_of(F.col("doc_id"), 5) == 0
    model = language.train(docs.where(~held))
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "languages", "proportions")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed and learned identifiers of every document; null texts have none."""
    return pii.detect(texts(spark, sf_dir), columns=("doc_id",))


def op6_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, tokeniser measures and verdict of every document; null texts fail the base rules."""
    return fertility.apply_rules(texts(spark, sf_dir), public_tokenizers.path(PIECE_BPE)).drop("text")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back; null pages have empty payloads."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    kind = pages.schema["page_id"].dataType
    read = warc.round_trip(pages)
    return read.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "problem")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; a null source is a source, null texts have size 0."""
    return mixing.mix(texts(spark, sf_dir, "source"), columns=("doc_id",))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; a null text is scored as an empty one."""
    docs = texts(spark, sf_dir)
    net = quality.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), fold_of(F.col("key"), 5) != 0)
    return quality.score(docs, net).select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; a null text is scored as one without a match."""
    docs = texts(spark, sf_dir)
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), fold_of(F.col("key"), 3) != 1)
    return toxicity.score(docs, lexicon).select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted", "weight", "matches")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters keeps, removes and loses per source, for all 120 orders."""
    return filter_audit.audit(texts(spark, sf_dir, "source"), table(spark, sf_dir, "labels"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in every document."""
    return licenses.scan_licenses(texts(spark, sf_dir)).drop("text")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn by how much they resemble the benchmark."""
    return importance.resample(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_token_counts, op2_simhash, op3_decontamination, op4_language, op5_personal_data, op6_fertility, op7_warc, op8_mixing, op9_quality, op10_toxicity,
    op11_filter_audit, op12_licenses, op13_importance,
)}

_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"coalesce(regexp_extract_all({_FOLD}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), [])"

ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": f"""
WITH items AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS s FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
hits AS (SELECT r, i, k, item FROM places JOIN windows USING (k, s)),
covered AS (SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, unnest(range(i, i + k)) AS pos FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered c USING (r) LEFT JOIN found f USING (r)
""",
    "op7_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest, CASE WHEN n >= 1000 AND page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < first THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM p LEFT JOIN m ON p.d = m.d
""",
    "op8_mixing": """
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, text,
  (CAST('0x' || substr(md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u FROM documents),
drawn AS (SELECT *, pow(u, 1 / coalesce(greatest(CAST(0.25 AS DOUBLE), 1 - abs(length(text) / CAST(greatest(size, 1) AS DOUBLE) - 1 - 6) / 12), CAST(0.25 AS DOUBLE))) AS draw FROM sized),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, [CAST(5 AS DOUBLE), 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w FROM sized GROUP BY source),
poured AS (SELECT *, sum(s) OVER () - 3 * (sum(s) OVER o - s) AS rest, sum(w) OVER () - (sum(w) OVER o - w) AS open FROM sources WINDOW o AS (ORDER BY s / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
level AS (SELECT rest, open FROM poured WHERE CAST(rest AS DOUBLE) * w / open <= 3 * s ORDER BY s / w, source NULLS LAST LIMIT 1),
targets AS (SELECT source, s, CASE WHEN CAST(l.rest AS DOUBLE) * w / l.open > 3 * s THEN CAST(3 * s AS DOUBLE) ELSE CAST(l.rest AS DOUBLE) * w / l.open END AS target FROM sources, level l),
plan AS (SELECT *, CASE WHEN s > 0 THEN least(CAST(floor(target / s) AS BIGINT), 3) ELSE 0 END AS epochs FROM targets),
ordered AS (SELECT d.doc_id, d.size, p.s, p.target, p.epochs, CASE WHEN p.epochs >= 3 THEN 0 ELSE CAST(round(p.target - p.epochs * p.s) AS BIGINT) END AS rest,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw DESC, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS ahead FROM drawn d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, s AS source_size, target, CAST(epochs * size + greatest(0, least(size, rest - ahead)) AS BIGINT) AS taken FROM ordered
""",
    "op11_filter_audit": r"""
WITH RECURSIVE d AS (SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN coalesce(doc_id > least, false) THEN 'E' ELSE '' END AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d LEFT JOIN marks USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, fails),
o AS (SELECT '' AS p UNION ALL SELECT p || f FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(p, f)),
s AS (SELECT p AS filter_order, step, substr(p, step, 1) AS f, substr(p, 1, step - 1) AS done FROM o, (SELECT unnest(range(1, 6)) AS step) WHERE length(p) = 5),
r AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (free AND NOT fail), 0) AS kept, coalesce(sum(n) FILTER (free AND fail), 0) AS removed, coalesce(sum(n) FILTER (fail AND NOT free), 0) AS redundant,
  coalesce(sum(n) FILTER (fails = f), 0) AS unique_fails, coalesce(sum(good) FILTER (free AND fail), 0) AS good_lost, coalesce(sum(toxic) FILTER (free AND fail), 0) AS toxic_lost
  FROM (SELECT *, contains(fails, f) AS fail, translate(fails, done, '') = fails AS free FROM c, s) GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
""",
    "op13_importance": f"""
WITH steps AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT {_WORDS} AS w FROM benchmark),
grams AS (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM docs),
wanted AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM items),
sums AS (SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(1, octet_length(encode(f)) + 1), lambda i: 16 * (strpos('0123456789ABCDEF', substr(h, 2 * i - 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, 2 * i, 1)) - 1)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM grams UNION SELECT f FROM wanted)), steps),
s AS (SELECT b, count(*) AS n FROM grams JOIN sums USING (f) GROUP BY b), t AS (SELECT b, count(*) AS n FROM wanted JOIN sums USING (f) GROUP BY b),
gains AS (SELECT s.b, CAST(floor(1000 * ln((coalesce(t.n, 0) + CAST(1 AS DOUBLE)) * ((SELECT sum(n) FROM s) + CAST(10000 AS DOUBLE)) / ((s.n + CAST(1 AS DOUBLE)) * (coalesce((SELECT sum(n) FROM t), 0) + CAST(10000 AS DOUBLE))))) AS BIGINT) AS g FROM s LEFT JOIN t USING (b)),
weights AS (SELECT r, count(*) AS n, CAST(sum(g) AS BIGINT) AS g FROM grams JOIN sums USING (f) JOIN gains USING (b) GROUP BY r),
scored AS (SELECT d.r, doc_id, len(w) AS words, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN g // n - CASE WHEN g % n < 0 THEN 1 ELSE 0 END ELSE 0 END AS weight,
  CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM docs d LEFT JOIN weights USING (r)),
final AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM scored),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS rank, count(*) OVER () AS n FROM final WHERE words >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM final LEFT JOIN placed USING (r)
""",
}
