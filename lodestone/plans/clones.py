"""Clone detection over documents: project = source, file = doc_id."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import rstats
from lodestone.operators import clones as C
from lodestone.operators import joins as J
from lodestone.plans import register, table

FILES_SQL = "SELECT source AS project, doc_id AS file_id, md5(coalesce(text, '')) AS hash FROM documents"
SPLIT = r"[;.\[\]()~!\-+&*/%<>^|?{}=#,\"\\:$''\t \r\n]+"
# the tables' texts hold no comments
TOKENS_SQL = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{SPLIT}'), lambda t: t <> '')"
BAG_SQL = f"""t AS (SELECT doc_id AS file_id, source AS project, unnest({TOKENS_SQL}) AS token FROM documents),
c AS (SELECT file_id, project, token, count(*) AS n FROM t GROUP BY ALL),
b AS (SELECT file_id, project, md5(string_agg(token || '@@::@@' || n, ',' ORDER BY token || '@@::@@' || n)) AS token_hash, sum(n)::BIGINT AS total_tokens, count(*)::BIGINT AS unique_tokens FROM c GROUP BY ALL)"""


def files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("project"), F.col("doc_id").alias("file_id"), F.md5(F.coalesce("text", F.lit(""))).alias("hash"))


def passages(spark, sf_dir):
    """The benchmark's passages as files of a project of their own."""
    return table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("project"), F.col("item_id").alias("file_id"), F.md5(F.coalesce("text", F.lit(""))).alias("hash"))


def bags(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("project"), F.col("doc_id").alias("file_id"), "text")
    return C.file_statistics(d).select("project", "file_id", "token_hash", "total_tokens", "unique_tokens", "file_hash").where("total_tokens > 0")


@register(f"""
WITH f AS ({FILES_SQL}), h AS (SELECT hash FROM f GROUP BY hash HAVING count(DISTINCT project) > 1)
SELECT project, count(*) AS n_files, count(h.hash) AS n_duplicated_files, count(h.hash) / count(*)::DOUBLE AS duplication
FROM f LEFT JOIN h USING (hash) GROUP BY project""")
def dup_01_project_duplication(spark, sf_dir):
    return C.project_duplication(files(spark, sf_dir))


@register(f"WITH f AS ({FILES_SQL}) SELECT hash, count(DISTINCT project) AS n_projects, count(*) AS n_files FROM f GROUP BY hash HAVING count(DISTINCT project) > 1")
def agg_06_shared_hashes(spark, sf_dir):
    return C.shared_hashes(files(spark, sf_dir)).withColumn("n_files", F.col("n_files").cast("long"))


@register(rf"""
WITH {BAG_SQL}, d AS (SELECT doc_id AS file_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT file_id, md5(text) AS file_hash, strlen(text) AS bytes, length(text) - length(replace(text, chr(10), '')) AS lines,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\t \r]', '', 'g') <> '')) AS loc FROM d)
SELECT l.file_id, file_hash, bytes, lines, loc, loc AS sloc, coalesce(total_tokens, 0) AS total_tokens, coalesce(unique_tokens, 0) AS unique_tokens, coalesce(token_hash, md5('')) AS token_hash
FROM l LEFT JOIN b USING (file_id)""")
def tok_01_file_statistics(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text")
    return C.file_statistics(d).drop("text")


COMMENTED_SQL = "replace(replace(coalesce(text, ''), ', ', ' /* a' || chr(10) || chr(10) || 'b */ '), '. ', '. // c' || chr(10))"


@register(rf"""
WITH d AS (SELECT doc_id AS file_id, {COMMENTED_SQL} AS text FROM documents),
m AS (SELECT file_id, text, regexp_replace(regexp_replace(text, '/\* a\n\nb \*/', chr(1) || chr(10) || chr(1) || chr(10) || chr(1), 'g'), '//[^\n]*', chr(1), 'g') AS marked FROM d),
t AS (SELECT *, string_split(marked, chr(10)) AS ls, {TOKENS_SQL.replace("coalesce(text, '')", "replace(marked, chr(1), ' ')")} AS ts FROM m)
SELECT file_id, strlen(text) AS bytes, len(ls) - 1 AS lines, len(list_filter(ls, lambda x: regexp_replace(x, '[\t \r\x01]', '', 'g') <> '')) AS loc, len(list_filter(ls, lambda x: regexp_replace(x, '[\t \r]', '', 'g') <> '')) AS sloc,
  len(ts)::BIGINT AS total_tokens, len(list_distinct(ts))::BIGINT AS unique_tokens FROM t""")
def tok_01_commented_files(spark, sf_dir):
    """Texts with a comment of three lines, one of them blank, behind each comma, and one to the line's end behind each sentence."""
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(", "), F.lit(" /* a\n\nb */ ")), F.lit(". "), F.lit(". // c\n"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), text.alias("text"))
    return C.file_statistics(d).select("file_id", "bytes", "lines", "loc", "sloc", "total_tokens", "unique_tokens")


@register(f"""
WITH {BAG_SQL}, s AS (SELECT b.*, md5(d.text) AS file_hash, row_number() OVER (PARTITION BY md5(d.text) ORDER BY b.file_id) AS k FROM b JOIN documents d ON d.doc_id = b.file_id)
SELECT file_hash, file_id, total_tokens, unique_tokens FROM s WHERE k = 1""")
def tok_02_statistics_once_per_hash(spark, sf_dir):
    return rstats.first_per_key(bags(spark, sf_dir), ["file_hash"], [F.col("file_id")]).select("file_hash", "file_id", "total_tokens", F.col("unique_tokens").cast("long"))


@register(f"WITH {BAG_SQL}, g AS (SELECT file_id, min(file_id) OVER (PARTITION BY token_hash) AS group_id FROM b) SELECT file_id, group_id FROM g WHERE file_id <> group_id")
def tok_03_clone_pairs(spark, sf_dir):
    return C.clone_pairs(bags(spark, sf_dir))


@register(f"""WITH {BAG_SQL} SELECT file_id, '@#@' || string_agg(md5(token) || '@@::@@' || n, ',' ORDER BY md5(token) || '@@::@@' || n) AS line FROM c GROUP BY file_id""")
def tok_04_token_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text")
    return C.token_bags(d).select("file_id", "line")


@register(f"""
WITH {BAG_SQL}, k AS (SELECT project, token_hash, count(*) AS n FROM b WHERE total_tokens >= 2 GROUP BY ALL), tt AS (SELECT project, sum(n)::BIGINT AS files FROM k GROUP BY project),
p AS (SELECT x.project AS clone, y.project AS host, sum(x.n)::BIGINT AS cloned_files, sum(y.n)::BIGINT AS affected_files FROM k x JOIN k y ON x.token_hash = y.token_hash AND x.project < y.project GROUP BY ALL),
q AS (SELECT clone, cloned_files, a.files AS total_files, cloned_files * 100 // a.files AS clone_pct, host, affected_files, h.files AS host_files, affected_files * 100 // h.files AS host_pct
  FROM p JOIN tt a ON a.project = clone JOIN tt h ON h.project = host)
SELECT * FROM q WHERE clone_pct >= 5 OR host_pct >= 5""")
def joi_26_project_clones(spark, sf_dir):
    return C.project_clones(bags(spark, sf_dir), min_percent=5)


@register(f"""
WITH f AS ({FILES_SQL}), e AS (SELECT f.*, n_chars AS created_at, d.lang AS lang FROM f JOIN documents d ON d.doc_id = f.file_id)
SELECT hash, count(*) AS size, arg_min(file_id, (created_at, file_id)) AS oldest_file_id, count(DISTINCT lang) AS n_lang FROM e GROUP BY hash HAVING count(*) > 1""")
def agg_27_hash_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.md5(F.coalesce("text", F.lit(""))).alias("hash"), F.col("n_chars").alias("created_at"), "lang")
    return C.hash_groups(d, "hash", "lang")


@register(f"WITH f AS ({FILES_SQL}) SELECT hash FROM f GROUP BY hash HAVING count(*) = 1")
def agg_30_hashes_once(spark, sf_dir):
    return files(spark, sf_dir).groupBy("hash").count().where("count = 1").select("hash")


@register(f"WITH f AS ({FILES_SQL}), c AS (SELECT hash, count(*) AS uses FROM f GROUP BY hash) SELECT uses, count(*) AS n_hashes FROM c GROUP BY uses")
def agg_33_multiplicities(spark, sf_dir):
    return files(spark, sf_dir).groupBy("hash").agg(F.count("*").alias("uses")).groupBy("uses").agg(F.count("*").alias("n_hashes"))


@register(f"WITH {BAG_SQL} SELECT token, sum(n)::BIGINT AS uses, length(token)::INTEGER AS length, md5(token) AS token_hash, token AS shown FROM c GROUP BY token")
def agg_26_token_dictionary(spark, sf_dir):
    return C.token_dictionary(table(spark, sf_dir, "documents"))


@register(f"WITH f AS ({FILES_SQL}), m AS (SELECT hash, min(file_id) AS i FROM f GROUP BY hash) SELECT hash, row_number() OVER (ORDER BY i) - 1 AS id FROM m")
def h2i_01_hash_ids(spark, sf_dir):
    return C.hash_ids(files(spark, sf_dir), "hash", "file_id")


AGG_31_PERCENT = 2  # low enough that projects of the tables host clones


@register(f"""
WITH f AS ({FILES_SQL}), u AS (SELECT hash FROM f GROUP BY hash HAVING count(*) = 1),
o AS (SELECT project, count(*) AS files, count(u.hash) AS unique_files FROM f LEFT JOIN u USING (hash) GROUP BY project),
{BAG_SQL}, k AS (SELECT project, token_hash, count(*) AS n FROM b WHERE total_tokens >= 2 GROUP BY ALL), tt AS (SELECT project, sum(n)::BIGINT AS files FROM k GROUP BY project),
p AS (SELECT x.project AS clone, y.project AS host, sum(x.n)::BIGINT AS cloned, sum(y.n)::BIGINT AS affected FROM k x JOIN k y ON x.token_hash = y.token_hash AND x.project < y.project GROUP BY ALL),
q AS (SELECT host, count(*) AS n FROM p JOIN tt a ON a.project = clone JOIN tt h ON h.project = host WHERE cloned * 100 // a.files >= {AGG_31_PERCENT} OR affected * 100 // h.files >= {AGG_31_PERCENT} GROUP BY host)
SELECT project, files, unique_files, coalesce(q.n, 0)::BIGINT AS contained_clones FROM o LEFT JOIN q ON host = project""")
def agg_31_project_originals(spark, sf_dir):
    return C.project_originals(files(spark, sf_dir), C.project_clones(bags(spark, sf_dir), min_percent=AGG_31_PERCENT)).withColumn("contained_clones", F.col("contained_clones").cast("long"))


@register(f"""
WITH f AS ({FILES_SQL}), k AS (SELECT project, hash, count(*) AS n FROM f GROUP BY ALL),
p AS (SELECT x.project AS group_id, x.hash AS file_id FROM k x WHERE n > 1),
s AS (SELECT group_id, count(*) AS n FROM p GROUP BY group_id),
i AS (SELECT a.group_id, b.group_id AS in_id, count(*) AS shared FROM p a JOIN p b ON a.file_id = b.file_id AND a.group_id <> b.group_id GROUP BY ALL)
SELECT group_id, n FROM s WHERE group_id NOT IN (SELECT i.group_id FROM i JOIN s USING (group_id) JOIN s t ON t.group_id = i.in_id WHERE shared = s.n AND (t.n > s.n OR in_id < i.group_id))""")
def agg_28_absorbed_groups(spark, sf_dir):
    pairs = files(spark, sf_dir).groupBy(F.col("project").alias("group_id"), F.col("hash").alias("file_id")).count().where("count > 1")
    return C.absorbed_groups(pairs.select("group_id", "file_id"))


@register(f"""
WITH f AS ({FILES_SQL}), h AS (SELECT hash FROM f GROUP BY hash HAVING count(DISTINCT project) > 1),
d AS (SELECT project, count(h.hash) / count(*)::DOUBLE AS dup FROM f LEFT JOIN h USING (hash) GROUP BY project)
SELECT i / 100.0::DOUBLE AS threshold, (SELECT count(*) FROM d WHERE dup >= i / 100.0::DOUBLE) AS n FROM range(1, 101) r(i)""")
def joi_23_threshold_sweep(spark, sf_dir):
    return J.threshold_sweep(C.project_duplication(files(spark, sf_dir)), "duplication")


@register(f"""
WITH f AS ({FILES_SQL}), a AS (SELECT DISTINCT md5(coalesce(text, '')) AS hash FROM benchmark), b AS (SELECT hash, count(*) AS n FROM f GROUP BY hash)
SELECT hash, 'missing' AS problem FROM a WHERE hash NOT IN (SELECT hash FROM b)
UNION ALL SELECT hash, 'unknown' FROM b WHERE hash NOT IN (SELECT hash FROM a) UNION ALL SELECT hash, 'duplicate' FROM b WHERE n > 1""")
def joi_30_reconciliation(spark, sf_dir):
    return J.reconcile(files(spark, sf_dir), passages(spark, sf_dir), "hash")


@register(f"""
WITH f AS ({FILES_SQL}), b AS (SELECT 'benchmark' AS project, item_id AS file_id, md5(coalesce(text, '')) AS hash FROM benchmark)
SELECT * FROM f UNION ALL SELECT * FROM b WHERE hash NOT IN (SELECT hash FROM f)""")
def joi_27_merged_datasets(spark, sf_dir):
    return J.merge_datasets(files(spark, sf_dir), passages(spark, sf_dir), "hash")
