"""The contract queries of the operators, with SQL where SQL can express them."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from logspark.llm import decontamination, extraction, licenses, lm, merkle, mixing, near_duplicates as near, quality, repeats, secrets, topk, vector_codes, warc
from logspark.llm.frames import bounded_batches, table
from logspark.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_near_duplicates")
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near.class_ids(table(spark, sf_dir, "documents"), rule=near.Similarity(words=3, percent=85))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


@query("op2_secret_scan")
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("secrets.base").cast("binary"), 256)
    return found.select(
        "doc_id", "secrets.n_assign", "secrets.n_access", "secrets.n_hex", digest.alias("base_sha256"), "secrets.spans"
    )


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM_WORDS = f"coalesce(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"


@query("op3_decontamination", f"""
WITH items AS (SELECT DISTINCT item_id, {_ALNUM_WORDS} AS w FROM benchmark),
docs AS (SELECT row_number() OVER () AS rid, doc_id, {_ALNUM_WORDS} AS w FROM documents),
sized AS (SELECT item_id, w, least(10, len(w)) AS k FROM items WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)
),
grams AS (
  SELECT rid, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM sized) WHERE len(w) >= k)
),
found AS (SELECT rid, i, k, item_id FROM grams JOIN windows USING (k, g)),
words AS (SELECT rid, count(DISTINCT spot) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS spot FROM found) GROUP BY rid),
named AS (
  SELECT rid, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS name FROM found WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (rid) LEFT JOIN named USING (rid)
""")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id", "found.n_words", "found.n_hit", "found.n_items", "found.items_sha256",
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


@query("op4_mixing", """
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
),
banded AS (SELECT *, len(bin(size)) AS band FROM docs),
dealt AS (
  SELECT *, coalesce(doc_id, 0) % CAST(ceil(count(*) OVER (PARTITION BY source, band) / 256.0) AS BIGINT) AS bucket FROM banded
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY band, bucket, size, doc_id NULLS FIRST) AS n FROM dealt
),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighted AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sources
),
summed AS (
  SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (
           ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
         row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place
  FROM weighted
),
limited AS (SELECT *, 3 * source_size * free < rest * weight AS is_limited FROM summed),
level AS (SELECT rest, free FROM limited WHERE NOT is_limited ORDER BY place LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN is_limited THEN CAST(3 * source_size AS DOUBLE)
    ELSE CAST(level.rest * weight AS DOUBLE) / CAST(level.free AS DOUBLE) END AS target,
    CAST(concat('0x', substr(md5(coalesce(source, chr(0))), 1, 8)) AS BIGINT) / 4294967296.0 AS u
  FROM limited LEFT JOIN level ON true
),
shares AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS share FROM targets)
SELECT doc_id, size, source_size, target,
       size * CAST(floor(n * share + u) - floor((n - 1) * share + u) AS BIGINT) AS taken
FROM placed JOIN shares ON placed.source IS NOT DISTINCT FROM shares.source
""")
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken")
    )


@query("op9_warc", """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest
  FROM pages
),
typed AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS first
  FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN coalesce(first, page_id) IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM typed
""")
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), folder).write.format("noop").mode("overwrite").save()
    return warc.read(spark, folder, payloads=False).drop("url", "payload")


@query("op8_top_k", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e, true), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 10
""")
def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    found = quality.scored(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", quality.is_held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"),
    )


@query("op5_extraction")
def op5_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars"))


@query("op7_lm_scores")
def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm.scores(docs, lm.is_held_out(F.col("doc_id"))).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query("op10_repeats")
def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed_bytes(table(spark, sf_dir, "documents"), length=100).drop("spans")


@query("op11_license_scan")
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    found = licenses.licensed(table(spark, sf_dir, "documents"))
    fields = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return found.select("doc_id", *[f"licences.{f}" for f in fields])


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds of op12, one behind the other."""
    apart = "CAST(list_sum(list_transform(list_zip(x, c), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) AS BIGINT)"
    sql = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, embedding,
         list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
wide AS (SELECT coalesce(max(len(e)), 0) // {parts} AS step FROM v),
p AS MATERIALIZED (
  SELECT rid, part, e[part * step + 1 : (part + 1) * step] AS x FROM v, wide, (SELECT unnest(range({parts})) AS part)
),
firsts AS (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS n FROM v),
c0 AS MATERIALIZED (SELECT part, n AS entry, x AS c FROM p JOIN firsts USING (rid) WHERE n < {entries})"""
    for r in range(rounds + 1):
        sql += f""",
a{r} AS MATERIALIZED (
  SELECT rid, part, CAST(min({apart} * {entries} + entry) AS BIGINT) AS m FROM p JOIN c{r} USING (part) GROUP BY rid, part
)"""
        if r < rounds:
            sql += f""",
s{r} AS (
  SELECT part, m % {entries} AS entry, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT a.part, m, x, unnest(range(1, len(x) + 1)) AS i FROM a{r} a JOIN p USING (rid, part)) GROUP BY 1, 2, 3
),
c{r + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(u.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
    SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY 1, 2) u USING (part, entry)
)"""
    return sql + f""",
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', m % {entries}), '' ORDER BY part) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error
  FROM a{rounds} JOIN v USING (rid) GROUP BY rid, vec_id, label
),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, books
"""


@query("op12_vector_codes", _codes_sql())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


_FIELD = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"



@query("op13_merkle_manifest", f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t
),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, lang, {_leaf_sql('n_chars')} AS leaf,
    CASE WHEN list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295) IS NULL THEN {_leaf_sql('n_chars')}
         WHEN xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 7 = 0 THEN {_leaf_sql('(CAST(n_chars AS HUGEINT) + 1)')}
         ELSE {_leaf_sql('n_chars')} END AS other
  FROM documents, crc
),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM d),
up AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY rank) AS nodes FROM r GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
  FROM up WHERE len(nodes) > 1
),
tree AS MATERIALIZED (SELECT * FROM up),
subs AS MATERIALIZED (
  SELECT lang, nodes[1] AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank FROM tree WHERE len(nodes) = 1
),
top_up AS (
  SELECT 0 AS level, list(subroot ORDER BY rank) AS nodes FROM subs
  UNION ALL
  SELECT level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
  FROM top_up WHERE len(nodes) > 1
),
top_tree AS MATERIALIZED (SELECT * FROM top_up),
root AS (SELECT nodes[1] AS root FROM top_tree WHERE len(nodes) = 1),
ways AS MATERIALIZED (
  SELECT r.rid, t.level, (r.rank >> t.level) & 1 AS bit, t.nodes[xor(r.rank >> t.level, 1) + 1] AS other
  FROM r JOIN tree t ON r.lang IS NOT DISTINCT FROM t.lang AND len(t.nodes) > 1
  UNION ALL
  SELECT r.rid, s.height + t.level, (s.rank >> t.level) & 1, t.nodes[xor(s.rank >> t.level, 1) + 1]
  FROM r JOIN subs s ON r.lang IS NOT DISTINCT FROM s.lang JOIN top_tree t ON len(t.nodes) > 1
),
paths AS (
  SELECT rid, coalesce(string_agg(other, '' ORDER BY level), '') AS path, list({{'bit': bit, 'other': coalesce(other, '')}} ORDER BY level) AS steps
  FROM ways GROUP BY rid
),
folded AS (
  SELECT r.*, coalesce(path, '') AS path,
    coalesce(list_reduce(steps, lambda h, s: CASE WHEN s.bit = 1 THEN {{'bit': s.bit, 'other': sha256(s.other || h.other)}}
      ELSE {{'bit': s.bit, 'other': sha256(h.other || s.other)}} END, {{'bit': CAST(0 AS BIGINT), 'other': r.other}}).other, r.other) AS folded_root
  FROM r LEFT JOIN paths USING (rid)
)
SELECT doc_id, leaf, subroot, root, sha256(path) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded JOIN subs s ON folded.lang IS NOT DISTINCT FROM s.lang, root
""")
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, 1).otherwise(0)
    found = merkle.proofs(
        table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "lang",
        changes={"n_chars": F.col("n_chars").cast("decimal(20,0)") + more},
    )
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return found.select(
        F.col("id").alias("doc_id"), text("leaf"), text("subroot"), text("root"), text("proof").alias("proof_sha256"), text("folded_root"), "verified"
    )
