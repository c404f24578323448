"""Named queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import scratch_path

from . import chat, decontaminate, itq, language, lines, manifest, minhash, mixing, negatives, substrings, toxicity, urls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: five-word shingles of lower-cased texts, as rows (id, s) of view `src` (id, text)
SHINGLES_SQL = r"""cut AS (
  SELECT id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM src),
shingles AS (
  SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5
    THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM cut)"""

NEAR_DUPLICATES_SQL = rf"""WITH RECURSIVE src AS (SELECT doc_id AS id, text FROM documents),
{SHINGLES_SQL},
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
common AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.id <> y.id
         GROUP BY 1, 2),
links AS (SELECT a, b FROM common c JOIN sizes p ON p.id = a JOIN sizes q ON q.id = b
          WHERE 100 * c.n >= 75 * (p.n + q.n - c.n)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_shingles,
       least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes ON sizes.id = d.doc_id LEFT JOIN least ON least.a = d.doc_id"""


@query("op1_bbit_minhash", NEAR_DUPLICATES_SQL)
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


@query("op3_ftrl_toxicity")
def toxic(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


SUBSTRINGS_SQL = r"""WITH cut AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM cut WHERE len(w) >= 50),
hashed AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM windows),
least AS (SELECT h, min(doc_id) AS m FROM hashed GROUP BY h),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM hashed JOIN least USING (h) WHERE m < doc_id),
gone_list AS (SELECT doc_id, count(*) AS n, list(k) AS ks FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_transform(
    list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(ks, k)), lambda k: w[k]), ' ') END) AS kept_sha256
FROM cut LEFT JOIN gone_list USING (doc_id)"""


@query("op6_fm_substrings", SUBSTRINGS_SQL)
def repeated_words(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    cut = substrings.remove_repeated(docs, removed_col="n_removed")

    def run(batches):
        for batch in batches:
            kept = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
            lost = batch.column("n_removed").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(k) + int(n) for k, n in zip(kept, lost)], pa.int64()),
                    batch.column("n_removed"),
                    pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for k in kept]),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return cut.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


@query("op2_soft_mixing")
def mixture(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    mixed = mixing.mix_by_quality(docs, table(spark, folder, "labels"))
    return mixed.select("doc_id", "domain", "n_tokens", "rate")


LEAKS_SQL = rf"""WITH src AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark),
{SHINGLES_SQL},
items AS (SELECT -1 - id AS item_id, s FROM shingles WHERE id < 0),
sizes AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id)
SELECT d.id AS doc_id, item_id, count(*) AS n_shared, any_value(n) AS n_item, count(*) / any_value(n) AS containment
FROM shingles d JOIN items USING (s) JOIN sizes USING (item_id) WHERE d.id >= 0
GROUP BY d.id, item_id HAVING count(*) * 100 >= any_value(n) * 75"""


@query("op5_minhash_containment", LEAKS_SQL)
def leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


CHAT_SQL = r"""WITH src AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
clean AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM src),
marked AS (SELECT *, regexp_replace(replace(text, '\', '\\'), '(<\||</s>|<s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>)', '~\1', 'g') AS e FROM clean),
texts AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS t,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS l,
    sum(12 + length(role) + 1 + length(e) + 11) AS f
  FROM marked GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(t) AS turns_sha256, length(l) AS loss_chars, sha256(l) AS loss_sha256,
  CAST(f AS BIGINT) AS formatted_chars FROM texts"""


@query("op7_schema_chat", CHAT_SQL)
def chats(spark: SparkSession, folder: str) -> DataFrame:
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    formatted = chat.format_turns(chat.canonical_turns(chat.as_records(rows)))
    turns, loss = chat.read_turns(F.col("formatted")), chat.masked_text(F.col("formatted"), F.col("loss_mask"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    back = formatted.select("conv_id", "fingerprint", "formatted", turns.alias("turns"), loss.alias("loss"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


WARC_SQL = """WITH rows AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
sized AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM rows),
owned AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS o FROM sized)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> o THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> o THEN o END AS refers_to FROM owned"""


@query("op8_warc_archive", WARC_SQL)
def archive(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archive(table(spark, folder, "pages"), path)
    records = warc.read_archive(spark, path)
    page = F.regexp_extract(warc.header_field("WARC-Record-ID"), ":([0-9-]+)>", 1)
    refers = F.regexp_extract(warc.header_field("WARC-Refers-To"), ":([0-9-]+)>", 1)
    return records.select(
        F.when(page != "", page).cast("long").alias("page_id"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.when(F.col("verified"), F.col("digest")).alias("payload_digest"),
        warc.header_field("WARC-Type").alias("record_type"),
        F.when(refers != "", refers).cast("long").alias("refers_to"),
    )


@query("op9_subword_language")
def languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held = toxicity.held_out(F.col("doc_id"), 4, 2)
    model = language.fit(docs.where(~held))
    found = language.predict(docs, model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


COSINE_SQL = """WITH RECURSIVE v AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
live AS (SELECT * FROM v WHERE list_dot_product(e, e) > 0),
links AS (SELECT x.id AS a, y.id AS b FROM live x JOIN live y ON x.id <> y.id AND len(x.e) = len(y.e)
          WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN counts ON counts.a = vec_id LEFT JOIN least ON least.a = vec_id"""


@query("op10_itq_vectors", COSINE_SQL)
def near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return itq.near_duplicates(table(spark, folder, "embeddings"))


#: fixed values: rules of the contract
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


@query("op4_path_templates")
def filtered(spark: SparkSession, folder: str) -> DataFrame:
    """A page's label is that of the document whose number its url ends with: bad if toxic or of low quality."""
    labels = table(spark, folder, "labels").groupBy("doc_id").agg(
        F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)).alias("bad")
    )
    pages = table(spark, folder, "pages").select("page_id", "url")
    number = F.regexp_extract(urls.host_and_path(F.col("url"))[1], "/([0-9]{1,18})(?:\\.html)?/?$", 1)
    pages = pages.withColumn("doc_id", F.when(number != "", number).cast("long")).join(labels, "doc_id", "left")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.judge(pages, rules)


NEGATIVES_SQL = """WITH live AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.id AS anchor, b.id, a.label = b.label AS alike, CAST(coalesce(list_dot_product(a.v, b.v), 0) AS BIGINT) AS s
  FROM live a JOIN live b ON a.id % 50 = 0 AND a.id <> b.id AND len(a.v) = len(b.v)),
positives AS (SELECT anchor, id AS positive_id, s AS p FROM scores WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY s DESC, id) <= 5)
SELECT anchor AS anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor, positive_id ORDER BY s DESC, id) AS INTEGER) AS rank,
  id AS negative_id, p AS positive_score, s AS negative_score
FROM scores JOIN positives USING (anchor) WHERE NOT alike AND 50 * p <= 100 * s AND 100 * s <= 95 * p
QUALIFY row_number() OVER (PARTITION BY anchor, positive_id ORDER BY s DESC, id) <= 3"""


@query("op11_l2ap_negatives", NEGATIVES_SQL)
def mined(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.whole_vectors(rows.withColumn("label", moved))
    return negatives.hard_negatives(rows, F.col("id") % 50 == 0)


LINES_SQL = """WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
spread AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM cut),
keyed AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM spread),
often AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT doc_id, i, line, last IS NOT NULL AND last <> doc_id AS gone FROM keyed LEFT JOIN often USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query("op12_line_bitmaps", LINES_SQL)
def repeated_lines(spark: SparkSession, folder: str) -> DataFrame:
    marked = lines.mark_lines(table(spark, folder, "documents"))
    left = lines.kept_text(F.col("text"), F.col("keep"))
    return marked.select("doc_id", "n_lines", "n_dropped", F.sha2(left, 256).alias("kept_sha256"))


def _leaf_sql(text: str) -> str:
    parts = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in parts) + ")"


MANIFEST_SQL = f"""WITH RECURSIVE told AS (
  SELECT *, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
    lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
    lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc FROM documents),
rows AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
    CASE WHEN crc & 1 = 1 THEN {_leaf_sql("replace(text, chr(10), '')")} END AS claim FROM told),
nodes AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
  row_number() OVER () AS g FROM rows),
lower(source, level, l) AS (
  SELECT source, 0, list(leaf ORDER BY idx) FROM nodes GROUP BY source UNION ALL
  SELECT source, level + 1, list_transform(range(0, len(l), 3), lambda i: sha256(array_to_string(l[i + 1:i + 3], '')))
  FROM lower WHERE len(l) > 1),
subroots AS (SELECT source, level AS height, l[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place
  FROM lower WHERE len(l) = 1),
higher(level, l) AS (
  SELECT 0, list(subroot ORDER BY place) FROM subroots UNION ALL
  SELECT level + 1, list_transform(range(0, len(l), 3), lambda i: sha256(array_to_string(l[i + 1:i + 3], '')))
  FROM higher WHERE len(l) > 1),
top AS (SELECT l[1] AS root FROM higher WHERE len(l) = 1),
steps AS (
  SELECT g, level AS step, CAST(idx // CAST(pow(3, level) AS BIGINT) AS BIGINT) AS i, l
  FROM nodes JOIN lower ON nodes.source IS NOT DISTINCT FROM lower.source AND len(l) > 1 UNION ALL
  SELECT g, height + level, CAST(place // CAST(pow(3, level) AS BIGINT) AS BIGINT), l
  FROM nodes JOIN subroots ON nodes.source IS NOT DISTINCT FROM subroots.source JOIN higher ON len(l) > 1),
path AS (SELECT g, step, array_to_string(l[i - i % 3 + 1:i], '') AS a, array_to_string(l[i + 2:i - i % 3 + 3], '') AS b FROM steps),
fold(g, step, digest) AS (
  SELECT g, CAST(0 AS BIGINT), coalesce(claim, leaf) FROM nodes UNION ALL
  SELECT f.g, f.step + 1, sha256(a || digest || b) FROM fold f JOIN path p ON p.g = f.g AND p.step = f.step),
folded AS (SELECT g, arg_max(digest, step) AS folded_root FROM fold GROUP BY g),
proofs AS (SELECT g, string_agg(a || b, '' ORDER BY step) AS p FROM path GROUP BY g)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(p, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM nodes JOIN subroots ON nodes.source IS NOT DISTINCT FROM subroots.source JOIN folded USING (g)
LEFT JOIN proofs USING (g), top"""


@query("op13_merkle_manifest", MANIFEST_SQL)
def proven(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    altered = {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    return manifest.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "source", altered)
