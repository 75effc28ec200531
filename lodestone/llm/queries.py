"""The numbered queries: thin digests of the operators over whole tables, and SQL where it can tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import byte_bpe, conversations, filter_audit, itq, langid, merkle, mixing, packing, pst, quality, simhash, toxicity, url_rules
from lodestone.llm.common import table


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op1_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op4_pst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.score_documents(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)


def op9_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_edited(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conversations.repair_conversations(conversations.damage(table(spark, sf_dir, "conversations")))
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(lines, 256).alias("repaired_sha256"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    bpe = byte_bpe.ByteBpe(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    found = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), as_text="as_text")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("as_text", 256).alias("ids_sha256"), F.sha2(bpe.decode(F.col("ids")), 256).alias("decoded_sha256"))


QUERIES = {
    "op1_itq": op1_itq,
    "op2_mixing": op2_mixing,
    "op3_packing": op3_packing,
    "op4_pst": op4_pst,
    "op5_simhash": op5_simhash,
    "op6_langid": op6_langid,
    "op7_toxicity": op7_toxicity,
    "op8_url_filters": op8_url_filters,
    "op9_merkle": op9_merkle,
    "op10_quality": op10_quality,
    "op11_filter_audit": op11_filter_audit,
    "op12_conversations": op12_conversations,
    "op13_byte_bpe": op13_byte_bpe,
}

SQL_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

ORACLES = {
    "op1_itq": """
WITH RECURSIVE v AS (SELECT vec_id, embedding :: DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS i, b.vec_id AS j FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS i, vec_id AS j FROM v UNION SELECT r.i, l.j FROM r JOIN l ON r.j = l.i),
c AS (SELECT i, min(j) AS component_id FROM r GROUP BY i), n AS (SELECT i, count(*) AS n FROM l GROUP BY i)
SELECT v.vec_id, coalesce(n.n, 0) :: BIGINT AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c ON c.i = v.vec_id LEFT JOIN n ON n.i = v.vec_id""",
    "op2_mixing": f"""
WITH d AS (SELECT doc_id, source, {SQL_WORDS} :: BIGINT AS size, md5('mix:' || coalesce(doc_id :: VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size) :: BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((r - 1) % 3 + 1) :: INT] :: BIGINT AS w, (sum(source_size) OVER ()) :: BIGINT AS total FROM s),
c AS (SELECT *, 2 * coalesce(sum(source_size) OVER before, 0) :: BIGINT AS stopped,
        (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) :: BIGINT AS w_left FROM w
      WINDOW before AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, w * (3 * total - 2 * stopped) > 4 * source_size * w_left AS stops FROM c),
t AS (SELECT source, source_size, CASE WHEN stops THEN (2 * source_size) :: DOUBLE ELSE
        (w * (3 * total - 4 * (sum(CASE WHEN stops THEN source_size ELSE 0 END) OVER ()) :: BIGINT)) :: DOUBLE
        / (2 * (sum(CASE WHEN stops THEN 0 ELSE w END) OVER ()) :: BIGINT) :: DOUBLE END AS target FROM f),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target) :: BIGINT AS budget,
        (sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)) :: BIGINT - d.size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS n FROM p)
SELECT doc_id, size, source_size, target,
  (n * size + greatest(0, least(size, budget - n * source_size - before))) :: BIGINT AS taken FROM q""",
    "op8_url_filters": """
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) v(rh, rp, verdict)),
fits AS (SELECT p.*, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rh || rp) DESC) AS k
         FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT p.page_id, p.host, p.path, fits.rule, coalesce(fits.verdict, 'allow') AS verdict
FROM p LEFT JOIN fits ON p.page_id = fits.page_id AND fits.k = 1""",
    "op9_merkle": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT r, doc_id, text, length(text) AS n_chars, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text
      FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, md5(text), text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, substr(text, 1, n_chars - n_chars // 2) || substr(next_text, 1, n_chars // 2) AS edited FROM n),
x AS (SELECT r, doc_id, n_chars, k, edited, list_transform(string_split(CASE k WHEN 0 THEN text WHEN 1 THEN edited ELSE next_text END, chr(10) || chr(10)),
        lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '[^.!?]*[.!?]+|[^.!?]+'), lambda y: md5(y)))) AS tree FROM e, (VALUES (0), (1), (2)) v(k)),
y AS (SELECT *, list_transform(tree, lambda s: list_transform(s, lambda p: {'h': md5(coalesce(list_aggregate(p, 'string_agg', ''), '')), 'l': p})) AS ps FROM x),
z AS (SELECT *, list_transform(ps, lambda s: {'h': md5(list_aggregate(list_transform(s, lambda p: p.h), 'string_agg', '')), 'p': s}) AS ss FROM y),
t AS (SELECT *, sha256(list_aggregate(list_transform(ss, lambda s: s.h), 'string_agg', '')) AS root FROM z),
u AS (SELECT *, list_distinct([root] || list_transform(ss, lambda s: s.h) || list_transform(flatten(ps), lambda p: p.h) || flatten(flatten(tree))) AS nodes FROM t),
c AS (SELECT a.r, list_filter(a.ss, lambda s: NOT list_contains(list_transform(b.ss, lambda v: v.h), s.h)) AS left_s, list_filter(b.ss, lambda s: NOT list_contains(list_transform(a.ss, lambda v: v.h), s.h)) AS right_s
      FROM u a JOIN u b ON a.r = b.r AND a.k = 0 AND b.k = 1),
f AS (SELECT r, flatten(list_transform(left_s, lambda s: s.p)) AS left_p, flatten(list_transform(right_s, lambda s: s.p)) AS right_p FROM c),
g AS (SELECT r, flatten(list_transform(list_filter(left_p, lambda p: NOT list_contains(list_transform(right_p, lambda v: v.h), p.h)), lambda p: p.l)) AS left_l,
        flatten(list_transform(list_filter(right_p, lambda p: NOT list_contains(list_transform(left_p, lambda v: v.h), p.h)), lambda p: p.l)) AS right_l FROM f)
SELECT a.doc_id, a.n_chars :: BIGINT AS n_chars, sha256(a.edited) AS edited_sha256, a.root AS fingerprint, b.root AS edited_fingerprint,
  2.0 :: DOUBLE * len(list_intersect(a.nodes, b.nodes)) / (len(a.nodes) + len(b.nodes)) :: DOUBLE AS near_edited,
  2.0 :: DOUBLE * len(list_intersect(a.nodes, c.nodes)) / (len(a.nodes) + len(c.nodes)) :: DOUBLE AS near_next,
  len(a.ss) :: INTEGER AS n_sections, len(list_distinct(list_filter(left_l, lambda x: NOT list_contains(right_l, x)))) :: INTEGER AS n_edited
FROM u a JOIN u b ON a.r = b.r AND b.k = 1 JOIN u c ON a.r = c.r AND c.k = 2 JOIN g ON g.r = a.r WHERE a.k = 0""",
    "op11_filter_audit": r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max((quality = 1) :: INT) AS good, max((toxic = 1) :: INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT w.*, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        (len(ws) < 50) :: INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws)) :: INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t)) :: INT
        + 8 * regexp_matches(t, '[#$%&*|]') :: INT + 16 * coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) :: INT AS mask FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS g, sum(toxic) AS x FROM m GROUP BY ALL),
k AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, b)),
o AS (SELECT k1.f || k2.f || k3.f || k4.f || k5.f AS filter_order, [k1.b, k2.b, k3.b, k4.b, k5.b] AS bs FROM k k1, k k2, k k3, k k4, k k5 WHERE k1.b + k2.b + k3.b + k4.b + k5.b = 31 AND (k1.b | k2.b | k3.b | k4.b | k5.b) = 31),
s AS (SELECT filter_order, step :: INT AS step, bs[step] AS own, coalesce(list_sum(bs[1 : step - 1]), 0) :: INT AS before FROM o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) :: BIGINT AS kept, sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN n ELSE 0 END) :: BIGINT AS removed,
        sum(CASE WHEN mask & before > 0 AND mask & own > 0 THEN n ELSE 0 END) :: BIGINT AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) :: BIGINT AS unique_fails,
        sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN g ELSE 0 END) :: BIGINT AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN x ELSE 0 END) :: BIGINT AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own)) :: BIGINT AS shapley FROM r""",
    "op12_conversations": r"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id :: VARCHAR, ' ') || ':' || coalesce(turn :: VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT *, xor(list_reduce([4294967295] || flatten(list_transform(range(1, length(k) + 1), lambda i: list_transform(range(0, 8), lambda j: ((unicode(substr(k, i :: INT, 1)) :: BIGINT >> j) & 1)))),
        lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % 20 AS m FROM o),
g AS (SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role, CASE m WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM h, range(0, CASE WHEN m = 3 THEN 2 ELSE 1 END) WHERE m <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, substr(role, 1, 1) AS c FROM g),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault,
        lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM n),
s AS (SELECT conv_id, count(*) AS size, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
r AS (SELECT *, CASE WHEN fault IN (1, 2) THEN 1000000 WHEN fault = 3 THEN 3 ELSE 0 END AS stay FROM f),
b AS (SELECT conv_id, size AS i, 0 :: BIGINT AS b0, 6 :: BIGINT AS b1, 3 :: BIGINT AS b2, 0 :: BIGINT AS b3 FROM s
  UNION ALL SELECT conv_id, i, least(e0, 3 + least(e2, 3 + e3)), least(e1, 3 + least(e2, 3 + e3)), least(e2, 3 + e3), least(e3, 3 + e2) FROM (
    SELECT b.conv_id, b.i - 1 AS i, least(4 + b0, stay + b2 + CASE WHEN c = 'u' THEN 0 ELSE 3 END, CASE WHEN c = 's' THEN stay + b1 ELSE 1000000000 END) AS e0, least(4 + b1, stay + b2 + CASE WHEN c = 'u' THEN 0 ELSE 3 END) AS e1,
      least(4 + b2, stay + b3 + CASE WHEN c = 'a' THEN 0 ELSE 3 END) AS e2, least(4 + b3, stay + b2 + CASE WHEN c = 'u' THEN 0 ELSE 3 END) AS e3
    FROM b JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i)),
w AS (SELECT conv_id, i, unnest([0, 1, 2, 3]) AS st, unnest([b0, b1, b2, b3]) AS cost FROM b),
t AS (SELECT conv_id, 0 :: BIGINT AS i, 0 AS st, '' AS audit, '' AS lines FROM s
  UNION ALL SELECT conv_id, i + (e <> 'I') :: INT, CASE e WHEN 'D' THEN st WHEN 'K' THEN CASE WHEN c = 's' THEN 1 ELSE nx END ELSE nx END, audit || e,
    lines || CASE e WHEN 'D' THEN '' WHEN 'I' THEN em || ':' || chr(10) WHEN 'K' THEN role || ':' || text || chr(10) ELSE em || ':' || text || chr(10) END
  FROM (SELECT t.*, r.c, r.role, r.text, CASE WHEN t.st = 2 THEN 3 ELSE 2 END AS nx, CASE WHEN t.st = 2 THEN 'assistant' ELSE 'user' END AS em,
      CASE WHEN d.cost + 4 = h.cost THEN 'D' WHEN n.cost + 3 = h.cost THEN 'I' WHEN (c = 's' AND t.st = 0 AND k1.cost + stay = h.cost) OR (c = CASE WHEN t.st = 2 THEN 'a' ELSE 'u' END AND k.cost + stay = h.cost) THEN 'K' ELSE 'R' END AS e
    FROM t JOIN w h ON h.conv_id IS NOT DISTINCT FROM t.conv_id AND h.i = t.i AND h.st = t.st
      JOIN w n ON n.conv_id IS NOT DISTINCT FROM t.conv_id AND n.i = t.i AND n.st = CASE WHEN t.st = 2 THEN 3 ELSE 2 END
      LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.i = t.i + 1
      LEFT JOIN w d ON d.conv_id IS NOT DISTINCT FROM t.conv_id AND d.i = t.i + 1 AND d.st = t.st
      LEFT JOIN w k ON k.conv_id IS NOT DISTINCT FROM t.conv_id AND k.i = t.i + 1 AND k.st = CASE WHEN t.st = 2 THEN 3 ELSE 2 END
      LEFT JOIN w k1 ON k1.conv_id IS NOT DISTINCT FROM t.conv_id AND k1.i = t.i + 1 AND k1.st = 1
    WHERE r.i IS NOT NULL OR h.cost > 0)),
l AS (SELECT conv_id, max_by(audit, length(audit)) AS audit, max_by(lines, length(audit)) AS lines FROM t GROUP BY conv_id),
a AS (SELECT DISTINCT conv_id FROM conversations)
SELECT a.conv_id, coalesce(gaps, 0) :: BIGINT AS gaps, coalesce(blank, 0) :: BIGINT AS blank, coalesce(duplicate, 0) :: BIGINT AS duplicate, coalesce(truncated, 0) :: BIGINT AS truncated, coalesce(illegal, 0) :: BIGINT AS illegal,
  coalesce(b0, 0) :: BIGINT AS cost, coalesce(audit, '') AS audit, sha256(CASE WHEN coalesce(lines, '') = '' THEN '' ELSE lines[: -2] END) AS repaired_sha256
FROM a LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.i = 0 LEFT JOIN l ON l.conv_id IS NOT DISTINCT FROM a.conv_id""",
}
