"""The operators' queries over whole tables, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skewlens.llm import (collocations, exact_dedup, language_id, license_scan, lm_score, mixture, near_dedup, packing,
                          periodic_runs, secrets, sentencepiece, topk, warc)
from skewlens.llm.common import WORD, table, text_of

#: Tokenizer files of the production queries; read once on the driver.
PIECES, WORD_PIECES = "piece_bpe_32k.model", "word_bpe_49k.json"


def tokenizer_file(spark: SparkSession, name: str) -> str:
    """A vocabulary file in the folder that the session's ``spark.skewlens.tokenizers`` names."""
    return f"{spark.conf.get('spark.skewlens.tokenizers', '/opt/tokenizers')}/{name}"


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    """Per document: pieces, byte pieces among them, hashes of the ids and of the decoded text, exact round trip."""
    v = sentencepiece.read_vocabulary(model_file or tokenizer_file(spark, PIECES))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    low, high = min(v.bytes_), max(v.bytes_)
    is_byte = lambda x: x.between(low, high) if high - low < len(v.bytes_) else x.isin(*v.bytes_)
    out = sentencepiece.decode(sentencepiece.encode(docs, v), v)
    return out.select(
        "doc_id", F.size("piece_ids").cast("long").alias("n_pieces"),
        F.size(F.filter("piece_ids", is_byte)).cast("long").alias("n_byte_pieces"),
        F.xxhash64("piece_ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"))


def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised("embedding").alias("v"))
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"), "vec_id", "v")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < secrets.BASE)
    return out.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
                      F.sha2(secrets.as_text(base), 256).alias("base_sha256"), secrets.as_text(F.col("spans")).alias("spans"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = language_id.held_out("doc_id", 7)
    trie = lm_score.train(docs.where(~held_out), least_count=1)
    return lm_score.score(docs, trie).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens",
                                             "base_score", "score")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest and size of a response are those of the payload read back; a revisit's stand in its record."""
    index, folder = warc.archive(spark, table(spark, sf_dir, "pages"))
    out = warc.read_records(index, folder)
    own = F.col("payload").isNotNull()
    return out.select("page_id", F.when(own, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
                      F.when(own, F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"),
                      "record_type", "refers_to")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("licenses").cast("long").alias("n_templates"),
                      F.array_join(F.transform("licenses", lambda x: x["template"]), ",").alias("templates"),
                      F.coalesce(F.array_max(F.transform("licenses", lambda x: x["containment"])), F.lit(0.0)).alias("containment"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    guess = language_id.identify(language_id.learn_fold(docs), spark)
    out = docs.withColumn("guess", guess("text"))
    return out.select("doc_id", language_id.held_out("doc_id").alias("held_out"),
                      F.col("guess.lang").alias("lang_pred"), "guess.score")


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which the words of one document in ten repeat from some word on with some period (op11's rule)."""
    h, g = F.crc32(F.col("doc_id").cast("string")), F.expr("__h div 10")
    words = F.when(F.col("__h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    docs = docs.select("doc_id", text_of("text").alias("text")).withColumn("__h", h)
    docs = docs.withColumn("__w", words).withColumn("__n", F.size("__w")).withColumn("__g", g)
    docs = docs.withColumn("__a", F.when(F.col("__n") > 0, F.col("__g") % F.col("__n")).cast("int"))
    docs = docs.withColumn("__p", F.expr("cast(1 + (__n - __a) div (3 + __g % 8) as int)"))
    unit = F.slice("__w", F.col("__a") + 1, F.col("__p"))
    again = F.concat(F.slice("__w", F.lit(1), F.col("__a")),
                     F.flatten(F.array_repeat(unit, F.expr("cast((__n - __a) div __p as int)"))),
                     F.slice(unit, F.lit(1), F.expr("(__n - __a) % __p")))
    return docs.select("doc_id", F.when(F.col("__a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.periodic_runs(looped(table(spark, sf_dir, "documents")))
    # The greatest exact length / period; the runs come by start and period, so the first of equals is kept.
    most = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda best, x: F.when(
        best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best))
    lines = F.transform("runs", lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","),
                                                   x["period"].cast("string"), F.lit("\n")))
    out = out.withColumn("best", most)
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                      F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                      F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_packing(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    with open(model_file or tokenizer_file(spark, WORD_PIECES), encoding="utf-8") as f:
        model = f.read()
    pieces = packing.tokenised(table(spark, sf_dir, "documents"), model)
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_mixture, op3_topk, op4_secrets, op5_lm_score, op6_exact_dedup,
                                 op7_warc, op8_near_dedup, op9_licenses, op10_language_id, op11_periodic_runs, op12_packing,
                                 op13_collocations)}

_SIZES = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT >> 2) AS h FROM documents),
sizes AS (SELECT source, sum(size)::DOUBLE AS s FROM docs GROUP BY source),
listed AS (
  SELECT source, s, 2 * s AS cap,
         ([3, 1, 2])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM sizes),
levels AS (
  SELECT source, s, cap, w, cap / w AS ratio,
         (1.5 * sum(s) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM listed WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
  SELECT source, s, least(w * (SELECT arg_min(level, ratio) FROM levels WHERE level * w < cap), cap) AS target FROM levels),
need AS (
  SELECT source, s, target, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS whole FROM goal),
sums AS (
  SELECT d.doc_id, d.size, n.s, n.target, n.whole, n.target - n.whole * n.s AS need, d.h,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS same
  FROM docs d JOIN need n ON d.source IS NOT DISTINCT FROM n.source)
"""

ORACLE_SQL = {
    "op2_mixture": _SIZES + """
SELECT doc_id, size, s::BIGINT AS source_size, CASE WHEN s = 0 THEN 0 ELSE target END AS target,
       size * times AS taken, times
FROM (SELECT *, least(2, whole + CASE WHEN upto <= need THEN 1
                                      WHEN upto - same <= need AND need > 0 AND 2 * (need - upto + same) >= same THEN 1
                                      ELSE 0 END)::BIGINT AS times FROM sums)
""",
    "op3_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
""",
    "op9_licenses": r"""
WITH templates(template, body) AS (VALUES """ + ", ".join(
    "('{}', '{}')".format(k, v.replace("'", "''")) for k, v in license_scan.TEMPLATES.items()) + r"""),
words AS (SELECT template, regexp_extract_all(lower(body), '[a-z0-9]+') AS w FROM templates),
known AS (
  SELECT DISTINCT template, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT template, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM words)),
sized AS (SELECT template, count(*) AS n, (2 ** ceil(log2(count(*))))::BIGINT AS p FROM known GROUP BY template),
texts AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
placed AS (
  SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM texts WHERE len(w) > 0)),
hits AS (SELECT doc_id, template, p, n, pos, s FROM placed JOIN known USING (s) JOIN sized USING (template)),
windows AS (
  SELECT doc_id, template, n, pos // p AS w, s FROM hits
  UNION ALL SELECT doc_id, template, n, pos // p - 1, s FROM hits WHERE pos // p >= 1),
held AS (SELECT doc_id, template, w, count(DISTINCT s) / n::DOUBLE AS c FROM windows GROUP BY doc_id, template, w, n),
best AS (SELECT doc_id, template, max(c) AS c FROM held WHERE c >= 0.8 GROUP BY doc_id, template)
SELECT d.doc_id, count(template) AS n_templates, coalesce(string_agg(template, ',' ORDER BY template), '') AS templates,
       coalesce(max(c), 0)::DOUBLE AS containment
FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id GROUP BY d.doc_id
""",
    "op7_warc": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM g
""",
    "op13_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS k))
  GROUP BY lang, k, phrase HAVING count(*) >= 100),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, x, array_to_string(string_split(phrase, ' ')[1:x], ' ') AS one,
         array_to_string(string_split(phrase, ' ')[x + 1:], ' ') AS two
  FROM (SELECT *, unnest(range(1, k)) AS x FROM f WHERE k > 1) c),
scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.x, p.a AS l, q.a AS r, n,
         ((1000::HUGEINT * c.a * n) // (p.a::HUGEINT * q.a))::BIGINT AS score
  FROM cuts c JOIN f p ON p.lang = c.lang AND p.phrase = c.one JOIN f q ON q.lang = c.lang AND q.phrase = c.two
  JOIN total t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, x) = 1),
stay AS (
  SELECT * FROM lowest s WHERE NOT EXISTS (
    SELECT 1 FROM f y WHERE y.lang = s.lang AND y.k > s.k AND contains(' ' || y.phrase || ' ', ' ' || s.phrase || ' ') AND y.a >= s.a))
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM stay) WHERE rank <= 2000
""",
    "op6_exact_dedup": r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
""",
}
