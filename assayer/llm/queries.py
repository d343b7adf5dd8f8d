"""The operators as registered queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.llm import decontaminate, html_text, language_model, mixture, near_duplicates, personal, quality, revisits, sharding, substrings, toxicity, turns, whitening


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    found = html_text.main_text(_table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")


def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, folder, "documents"), shingle=3, threshold=(85, 100))


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substrings.without_repeats(_table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    trusted = _table(spark, folder, "labels").where("quality = 1")
    return quality.judged(_table(spark, folder, "documents"), trusted)


def op5_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    documents = _table(spark, folder, "documents")
    model = language_model.train(documents.where(~held_out))
    scored = language_model.score(documents, model)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known",
                         F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")


def op6_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    found = personal.find(documents, personal.learn(documents))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op7_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(
        _table(spark, folder, "documents"), _table(spark, folder, "benchmark")))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.shares(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The mix itself, a row per slot, of which op8_mixing has the shares of documents."""
    return mixture.packed(_table(spark, folder, "documents"))


def captures(pages: DataFrame) -> DataFrame:
    """Two captures of every page: a response, and a revisit after it (of each fourth page: before it) under another spelling of its URL.

    Of each fifth page the revisit's entity tag is another one, of each seventh it has none; of each eleventh nothing to compare.
    """
    page, tag = F.col("page_id"), F.md5("html")
    day = F.concat(F.lit("day "), (page % 28).cast("string"))
    response = pages.select(
        (page * 2).alias("record_id"), "url", (page * 10).alias("ts"), F.lit("response").alias("kind"), tag.alias("etag"),
        day.alias("last_modified"), F.sha1("html").alias("digest"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Date"), (page * 10).cast("string"),
                     F.lit("Server"), F.lit("origin")).alias("headers"))
    bare = page % 11 == 0
    again = pages.select(
        (page * 2 + 1).alias("record_id"), F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")).alias("url"),
        (page * 10 + F.when(page % 4 == 0, -5).otherwise(5)).alias("ts"), F.lit("revisit").alias("kind"),
        F.when(bare | (page % 7 == 0), None).when(page % 5 == 0, F.md5("url")).otherwise(F.concat(F.lit("W/"), tag)).alias("etag"),
        F.when(~bare, day).alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.create_map(F.lit("date"), (page * 10 + 5).cast("string"), F.lit("server"), F.lit("edge"), F.lit("Vary"), F.lit("accept")).alias("headers"))
    return response.unionByName(again)


def op9_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    return revisits.resolve(captures(_table(spark, folder, "pages")))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    documents = _table(spark, folder, "documents")
    model = toxicity.fit(documents, _table(spark, folder, "labels").where(~held_out))
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows, edits = turns.repair(turns.damaged(turns.turns(_table(spark, folder, "conversations"))))
    return turns.report(rows, edits)


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(_table(spark, folder, "embeddings")))


#: Equal weights, so that shards hold near equal numbers of keys.
SHARD_WEIGHTS = (1.0,) * 24


def op13_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.assignment(_table(spark, folder, "documents"), SHARD_WEIGHTS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_minhash_near_dedup, op3_substring_dedup, op4_quality_rules, op5_lm_scoring, op6_personal_data, op7_benchmark_decontamination, op8_mixing, mixed_blocks, op9_warc_revisits,
                                     op10_toxicity, op11_conversation_repair, op12_embedding_whitening, op13_sharding)}
#: The as-of join as SQL. Canonical URLs by the same rules, matches by DuckDB's own ASOF join.
_CANONICAL = """regexp_replace(lower(regexp_extract(b, '^([^/?]*)', 1)), '^www[0-9]*[.]|:(80|443)$', '', 'g')
  || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '^[^/?]*', ''),
  '([?&])(utm_[a-z]+|ref|sessionid)=[^&]*', '\\1', 'g'), '&&+', '&', 'g'), '[?]&+', '?', 'g'), '[?&]+$', ''), '/+$', '')"""
_BARE = "regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"

#: CRC-32 of a text's UTF-8 bytes, folded over a table of 256 remainders: {crc} stands where ``tab`` is joined and ``h`` is the text in hex.
_CRC_TABLE = """tab AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(range(8),
  lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, b) AS c FROM range(256) r(b)))"""
_CRC = """xor(list_reduce(list_transform(regexp_extract_all(h, '..'), lambda p: ('0x' || p)::BIGINT),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"

ORACLES: dict[str, str] = {
    # sets of shingles, links by counting shared ones, components by walking links from smaller ids
    "op2_minhash_near_dedup": f"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 2], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM split WHERE len(w) > 0)),
sized AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT u, v FROM shared s JOIN sized a ON a.doc_id = u JOIN sized b ON b.doc_id = v WHERE 100 * c >= 85 * (a.n + b.n - c)),
ways AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
walk(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b.v, w.root FROM walk w JOIN ways b ON b.u = w.node WHERE w.root < b.v),
least AS (SELECT node, min(root) AS root FROM walk GROUP BY 1)
SELECT s.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, root AS component_id, root = s.doc_id AS kept
FROM split s JOIN least l ON l.node = s.doc_id LEFT JOIN sized z ON z.doc_id = s.doc_id""",
    "op3_substring_dedup": f"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
window_ AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM split)),
first_ AS (SELECT g, min(doc_id) AS m FROM window_ GROUP BY 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM window_ JOIN first_ USING (g) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM split),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS body FROM word ANTI JOIN covered USING (doc_id, k) GROUP BY 1),
gone AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY 1)
SELECT s.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM split s LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)""",
    # edits by a table over the turns from the last to the first: for each state ('', s, u, a) the least (cost, audit) of what follows.
    # An insertion leads to the state after it; a second one in a row, from s or '', to the one after that
    "op11_conversation_repair": f"""
WITH RECURSIVE {_CRC_TABLE},
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h FROM conversations),
drawn AS (SELECT conv_id, turn, role, text, {_CRC} % 20 AS d FROM named, tab),
harmed AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE d WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS c FROM drawn),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), c) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, c) AS seen, count(*) OVER (PARTITION BY conv_id) AS n,
  rtrim(text, E' \t\n\x0b\x0c\r') AS body, left(role, 1) AS initial FROM harmed),
told AS (SELECT *, CASE WHEN body = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS fault,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM placed),
step(conv_id, i, z, s, u, a) AS (
  SELECT DISTINCT conv_id, n, (0, ''), (10, 'II'), (5, 'I'), (0, '') FROM told
  UNION ALL
  SELECT conv_id, i - 1, least((uu[1] + 5, 'I' || uu[2]), z), least((uu[1] + 5, 'I' || uu[2]), s), uu, aa FROM (
    SELECT conv_id, i, z, s, least((aa[1] + 5, 'I' || aa[2]), u) AS uu, least((u[1] + 5, 'I' || u[2]), aa) AS aa FROM (
      SELECT p.conv_id, p.i, least(drop_z, CASE WHEN initial = 's' THEN keep_s ELSE to_u END, to_u) AS z, least(drop_s, to_u) AS s, least(drop_u, to_a) AS u, least(drop_a, to_u) AS aa FROM (
        SELECT t.conv_id, t.i, t.initial, (x.z[1] + 2, 'D' || x.z[2]) AS drop_z, (x.s[1] + 2, 'D' || x.s[2]) AS drop_s, (x.u[1] + 2, 'D' || x.u[2]) AS drop_u,
          (x.a[1] + 2, 'D' || x.a[2]) AS drop_a, (x.s[1] + stay, 'K' || x.s[2]) AS keep_s,
          CASE WHEN initial = 'u' THEN (x.u[1] + stay, 'K' || x.u[2]) ELSE (x.u[1] + stay + 1, 'R' || x.u[2]) END AS to_u,
          CASE WHEN initial = 'a' THEN (x.a[1] + stay, 'K' || x.a[2]) ELSE (x.a[1] + stay + 1, 'R' || x.a[2]) END AS to_a
        FROM step x JOIN (SELECT *, CASE fault WHEN '.' THEN 0 WHEN 't' THEN 5 ELSE 1000000000 END AS stay FROM told) t
          ON t.conv_id IS NOT DISTINCT FROM x.conv_id AND t.i = x.i) p))),
solved AS (SELECT conv_id, z[1] AS cost, z[2] AS audit FROM step WHERE i = 0),
-- the role that each edit leaves: kept ones alternate from the first, a system turn apart
edit AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM solved),
named_edit AS (SELECT conv_id, k, audit[k] AS e, (SELECT count(*) FROM range(1, k + 1) x(j) WHERE audit[j] <> 'I')::BIGINT AS i FROM edit),
kept AS (SELECT e.conv_id, e.k, e.e, t.role, t.text, row_number() OVER (PARTITION BY e.conv_id ORDER BY e.k) AS o,
  max(CASE WHEN e.e = 'K' AND t.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS led
  FROM named_edit e LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM e.conv_id AND t.i = e.i AND e.e <> 'I' WHERE e.e <> 'D'),
written AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (o - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END,
  chr(10) ORDER BY k) AS body FROM kept GROUP BY conv_id),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM told GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN solved v ON v.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN written w ON w.conv_id IS NOT DISTINCT FROM o.conv_id""",
    "op13_sharding": f"""
WITH {_CRC_TABLE},
record AS (SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, '')) + 8 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
summed AS (SELECT r, doc_id, size, {_CRC} AS text_crc32 FROM record, tab),
bid AS (SELECT r, s AS shard, -ln((('0x' || substr(md5(s::VARCHAR || coalesce(':' || doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) AS bid
  FROM record, range(25) x(s)),
won AS (SELECT r, arg_min(shard, (bid, shard)) FILTER (shard < 24) AS shard, arg_min(shard, (bid, shard)) AS grown_shard FROM bid GROUP BY r)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard::INT AS grown_shard
FROM summed JOIN won USING (r)""",
    "op7_benchmark_decontamination": """
WITH fold AS (SELECT item_id AS id, true AS item, text FROM benchmark UNION ALL SELECT doc_id, false, text FROM documents),
split AS (SELECT id, item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM fold),
word AS (SELECT id, item, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM split),
run AS (SELECT id, item, n, i, string_agg(x, ' ') OVER ten AS g, count(*) OVER ten AS m FROM word
  WINDOW ten AS (PARTITION BY item, id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
pattern AS (SELECT DISTINCT id AS item_id, g, m FROM run WHERE item AND (m = 10 OR i = 1)),
size AS (SELECT DISTINCT m FROM pattern),
part AS (SELECT r.id, r.i, s.m, array_to_string(list_slice(string_split(r.g, ' '), 1, s.m), ' ') AS g
  FROM run r JOIN size s ON s.m <= r.m WHERE NOT item),
hit AS (SELECT p.id, p.i, p.m, t.item_id FROM part p JOIN pattern t ON p.g = t.g AND p.m = t.m),
covered AS (SELECT id, count(DISTINCT k) AS n_hit FROM (SELECT id, unnest(range(i, i + m)) AS k FROM hit) GROUP BY id),
found AS (SELECT id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT id, item_id::VARCHAR AS item_id FROM hit) GROUP BY id)
SELECT s.id AS doc_id, len(s.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM split s LEFT JOIN covered c ON c.id = s.id LEFT JOIN found f ON f.id = s.id WHERE NOT item""",
    "op9_warc_revisits": f"""
WITH p AS (SELECT *, md5(html) AS tag, 'day ' || (page_id % 28)::VARCHAR AS day FROM pages),
r AS (SELECT page_id * 2 AS record_id, page_id * 10 AS ts, tag, day, {_BARE} AS b FROM p),
response AS (SELECT *, {_CANONICAL} AS site FROM r),
v AS (SELECT page_id * 2 + 1 AS record_id, page_id, regexp_replace(url, '#.*$', '') || '#again' AS url,
  page_id * 10 + CASE WHEN page_id % 4 = 0 THEN -5 ELSE 5 END AS ts,
  CASE WHEN page_id % 11 = 0 OR page_id % 7 = 0 THEN NULL WHEN page_id % 5 = 0 THEN md5(url) ELSE tag END AS tag,
  CASE WHEN page_id % 11 <> 0 THEN day END AS day FROM p),
revisit AS (SELECT *, {_CANONICAL} AS site FROM (SELECT *, {_BARE} AS b FROM v)),
joined AS (SELECT v.record_id, v.url, v.page_id, r.record_id AS rid, r.ts AS rts, r.tag AS rtag,
  coalesce(v.tag = r.tag, v.day = r.day) AS agrees
  FROM revisit v ASOF LEFT JOIN response r ON v.site = r.site AND v.ts > r.ts),
told AS (SELECT *, CASE WHEN rid IS NULL THEN 'no_earlier' WHEN agrees IS NULL THEN 'unverified' WHEN agrees THEN 'resolved' ELSE 'changed' END AS outcome FROM joined)
SELECT record_id, url, CASE WHEN outcome = 'resolved' THEN rid END AS refers_to, CASE WHEN outcome = 'resolved' THEN rts END AS refers_ts, outcome,
  CASE WHEN outcome = 'resolved' THEN 'content-type: text/html' || chr(10) || 'date: ' || (page_id * 10 + 5) || chr(10) || 'etag: ' || rtag
    || chr(10) || 'server: origin' || chr(10) || 'vary: accept'
  ELSE 'date: ' || (page_id * 10 + 5) || chr(10) || 'server: edge' || chr(10) || 'vary: accept' END AS headers FROM told""",
}
