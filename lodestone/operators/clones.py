"""Clone detection: token statistics, hash groups, duplication, containment of projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.names import free_names
from lodestone.functions.scalars import ratio
from lodestone.operators.lineage import materialise
from lodestone.operators.ranks import with_running_total

# Characters that separate tokens and count as such where lines are judged.
SEPARATORS = ";.[]()~!-+&*/%<>^|?{}=#,\"\\:$'"
_CLASS = "[" + "".join("\\" + c for c in SEPARATORS) + r"\t \r\n]+"
_COMMENT = r"(?s)//[^\n]*|/\*.*?(\*/|\z)"
_SEGMENT = r"(?s)//[^\n]*|/\*.*?(?:\*/|\z)|[^/]+|/"
_MARK = "\ufdd0"  # stands for a comment in a line; no character


def tokens(text: Column) -> Column:
    """array<string>: what is left between separators and white space, comments dropped."""
    return F.filter(F.split(F.regexp_replace(text, _COMMENT, " "), _CLASS), lambda t: t != "")


def _let(value: Column, body) -> Column:
    """body of a value that is made once."""
    return F.get(F.transform(F.array(value), body), 0)


def token_runs(text: Column) -> Column:
    """array<struct<token, uses>> by token: counted within the row, by where runs of the sorted tokens end."""

    def runs(t: Column) -> Column:
        ends = F.transform(F.arrays_zip(t.alias("a"), F.slice(t, 2, F.size(t)).alias("b")), lambda x, i: F.struct(x["a"].alias("token"), x["b"].alias("next"), (i + 1).alias("at")))
        ends = F.filter(ends, lambda x: ~x["token"].eqNullSafe(x["next"]))
        before = lambda e: F.slice(F.concat(F.array(F.lit(0)), e["at"]), 1, F.size(e))
        return _let(ends, lambda e: F.zip_with(e, before(e), lambda x, n: F.struct(x["token"].alias("token"), (x["at"] - n).cast("long").alias("uses"))))

    return _let(F.sort_array(tokens(text)), runs)


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column whose value is made once for each row, however often what follows reads it: a filter isn't moved before an explode."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def token_counts(files: DataFrame, text: str = "text") -> DataFrame:
    """(file_id, token, uses)."""
    return files.select("file_id", F.inline(token_runs(F.col(text))))


def _bag(runs: Column, name) -> Column:
    """Sorted `name@@::@@uses`, joined by commas."""
    return F.array_join(F.sort_array(F.transform(runs, lambda r: F.concat(name(r["token"]), F.lit("@@::@@"), r["uses"].cast("string")))), ",")


def token_bags(files: DataFrame, text: str = "text") -> DataFrame:
    """(file_id, total_tokens, unique_tokens, token_hash, line) of the files that have tokens. line: `@#@` and the
    sorted `hash@@::@@count` pairs, as the serialised form has them."""
    rows = _once(files.select("file_id", text), "runs", token_runs(F.col(text))).where(F.size("runs") > 0)
    total = F.aggregate(F.col("runs")["uses"], F.lit(0).cast("long"), lambda a, x: a + x)
    line = F.concat(F.lit("@#@"), _bag(F.col("runs"), F.md5))
    return rows.select("file_id", total.alias("total_tokens"), F.size("runs").cast("long").alias("unique_tokens"), F.md5(_bag(F.col("runs"), lambda t: t)).alias("token_hash"), line.alias("line"))


def marked_lines(text: Column) -> Column:
    """Lines of the text with a mark for each comment that a line has a part of."""

    def mark(s: Column) -> Column:
        lines = F.size(F.split(s, "\n", -1))
        return F.when(s.startswith("//"), _MARK).when(s.startswith("/*"), F.array_join(F.array_repeat(F.lit(_MARK), lines), "\n")).otherwise(s)

    return F.split(F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_SEGMENT), F.lit(0)), mark), ""), "\n", -1)


def file_statistics(files: DataFrame, text: str = "text") -> DataFrame:
    """Adds bytes, lines, loc, sloc, total_tokens, unique_tokens, token_hash and file_hash to files.

    lines: line ends. sloc: lines that hold a token, a separator or part of a comment, blank ones within a comment too; loc: those with
    a token or separator. A row's counts come from the row alone: nothing is shuffled.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    runs, marked = free_names(files, "runs", "marked")
    left = lambda blank: F.size(F.filter(marked, lambda y: F.regexp_replace(y, blank, "") != ""))
    rows = _once(files, runs, token_runs(t)).withColumn(marked, marked_lines(t))
    total = F.aggregate(F.col(runs)["uses"], F.lit(0).cast("long"), lambda a, x: a + x)
    return (
        rows.withColumn("bytes", F.octet_length(t))
        .withColumn("lines", F.size(F.split(t, "\n", -1)) - 1)
        .withColumn("loc", left(f"[\t \r{_MARK}]"))
        .withColumn("sloc", left("[\t \r]"))
        .withColumn("file_hash", F.md5(t))
        .withColumn("total_tokens", total)
        .withColumn("unique_tokens", F.size(runs).cast("long"))
        .withColumn("token_hash", F.md5(_bag(F.col(runs), lambda x: x)))
        .drop(runs, marked)
    )


def shared_hashes(files: DataFrame) -> DataFrame:
    """files: project, file, hash. Hashes found in several projects: hash, n_projects, n_files. Counted by
    (hash, project) first, so that a hash with very many files is small before it is shuffled."""
    pairs = files.groupBy("hash", "project").agg(F.count("*").alias("n"))
    return pairs.groupBy("hash").agg(F.count("*").alias("n_projects"), F.sum("n").alias("n_files")).where("n_projects > 1")


def project_duplication(files: DataFrame) -> DataFrame:
    """project, n_files, n_duplicated_files, duplication: files whose hash another project has too."""
    pairs = files.groupBy("project", "hash").agg(F.count("*").alias("n"))
    spread = pairs.groupBy("hash").agg(F.count("*").alias("n_projects"))
    marked = pairs.join(spread, "hash")
    dup = F.sum(F.when(F.col("n_projects") > 1, F.col("n")).otherwise(0))
    out = marked.groupBy("project").agg(F.sum("n").alias("n_files"), dup.alias("n_duplicated_files"))
    return out.withColumn("duplication", ratio(F.col("n_duplicated_files"), F.col("n_files")))


def project_clones(files: DataFrame, min_tokens: int = 2, min_percent: int = 50) -> DataFrame:
    """files: project, token_hash, total_tokens. Pairs clone <= host of projects that share token
    hashes: clone, cloned_files, total_files, clone_pct, host, affected_files, host_files, host_pct, where
    either share is min_percent or more.

    What is joined is one row for each project and hash; a project isn't compared with itself. A project that has min_percent of
    its files in another shares one of its rarest hashes that together make up more than the rest: only these are
    looked up among the others' hashes, so that one that all projects have makes no pairs but of those that consist of it.
    """
    counted = materialise(files.where(F.col("total_tokens") >= min_tokens).groupBy("project", "token_hash").agg(F.count("*").alias("n")))
    totals = counted.groupBy("project").agg(F.sum("n").alias("files"))
    spread = counted.groupBy("token_hash").agg(F.count("*").alias("projects"))
    ranked = counted.join(spread, "token_hash").join(totals, "project")
    before = F.sum("n").over(W.partitionBy("project").orderBy("projects", "token_hash").rowsBetween(W.unboundedPreceding, -1))
    rare = ranked.withColumn("before", F.coalesce(before, F.lit(0))).where((F.col("before") * 100 <= F.col("files") * (100 - min_percent)) & (F.col("projects") > 1))
    others = counted.select(F.col("project").alias("other"), "token_hash")
    pairs = rare.select("project", "token_hash").join(others, "token_hash").where("project <> other").select(F.least("project", "other").alias("clone"), F.greatest("project", "other").alias("host")).distinct()
    a = counted.select(F.col("project").alias("clone"), "token_hash", F.col("n").alias("n_clone"))
    b = counted.select(F.col("project").alias("host"), "token_hash", F.col("n").alias("n_host"))
    sums = pairs.join(a, "clone").join(b, ["host", "token_hash"]).groupBy("clone", "host").agg(F.sum("n_clone").alias("cloned_files"), F.sum("n_host").alias("affected_files"))
    out = sums.join(totals.toDF("clone", "total_files"), "clone").join(totals.toDF("host", "host_files"), "host")
    out = out.withColumn("clone_pct", F.expr("cloned_files * 100 div total_files")).withColumn("host_pct", F.expr("affected_files * 100 div host_files"))
    return out.where((F.col("clone_pct") >= min_percent) | (F.col("host_pct") >= min_percent)).select("clone", "cloned_files", "total_files", "clone_pct", "host", "affected_files", "host_files", "host_pct")


def hash_groups(files: DataFrame, by: str, other: str) -> DataFrame:
    """files: file_id, created_at. Groups of several files with one hash: size, oldest member (smallest
    id of the oldest), distinct other hashes."""
    out = files.groupBy(by).agg(F.count("*").alias("size"), F.min_by("file_id", F.struct("created_at", "file_id")).alias("oldest_file_id"), F.countDistinct(other).alias(f"n_{other}"))
    return out.where("size > 1")


def clone_pairs(files: DataFrame) -> DataFrame:
    """(file_id, group_id) of each file whose token hash an earlier one has; the earliest names the group."""
    files = materialise(files.select("file_id", "token_hash"))  # texts are read once
    firsts = files.groupBy("token_hash").agg(F.min("file_id").alias("group_id"))
    return files.join(firsts, "token_hash").where("file_id <> group_id").select("file_id", "group_id")


def absorbed_groups(pairs: DataFrame) -> DataFrame:
    """pairs: group_id, file_id. Groups that no other group's members contain; of equal ones the
    smallest id. A candidate container shares the group's member that is in fewest groups."""
    size = pairs.groupBy("group_id").agg(F.count("*").alias("n"))
    uses = pairs.groupBy("file_id").agg(F.count("*").alias("uses"))
    rarest = pairs.join(uses, "file_id").groupBy("group_id").agg(F.min_by("file_id", F.struct("uses", "file_id")).alias("file_id"))
    candidates = rarest.join(pairs.toDF("in_id", "file_id"), "file_id").where("group_id <> in_id").select("group_id", "in_id")
    shared = candidates.join(pairs, "group_id").join(pairs.toDF("in_id", "file_id"), ["in_id", "file_id"]).groupBy("group_id", "in_id").agg(F.count("*").alias("shared"))
    inside = shared.join(size, "group_id").join(size.toDF("in_id", "in_n"), "in_id").where("shared = n AND (in_n > n OR in_id < group_id)")
    return size.join(inside, "group_id", "left_anti").select("group_id", "n")


def memberships(files: DataFrame, by: str) -> DataFrame:
    """(file_id, group_id) of files that share a hash with others; a group is named by its smallest file."""
    groups = files.groupBy(by).agg(F.min("file_id").alias("group_id"), F.count("*").alias("n")).where("n > 1")
    return files.join(groups, by).select("file_id", "group_id")


def token_dictionary(files: DataFrame, text: str = "text") -> DataFrame:
    """token, uses, length, token_hash, shown: of all files; texts over 10 KiB are shown by their first
    and last 1000 characters."""
    t = files.select(F.explode(tokens(F.col(text))).alias("token"))
    shown = F.when(F.length("token") > 10_240, F.concat(F.left("token", F.lit(1000)), F.lit("..."), F.right("token", F.lit(1000)))).otherwise(F.col("token"))
    return t.groupBy("token").agg(F.count("*").alias("uses")).select("token", "uses", F.length("token").alias("length"), F.md5("token").alias("token_hash"), shown.alias("shown"))


def hash_ids(df: DataFrame, column: str, order: str) -> DataFrame:
    """(column, id): numbers from 0 for distinct values by their first place in order."""
    firsts = df.groupBy(column).agg(F.min(order).alias("__first"))
    return with_running_total(firsts, ["__first", column], F.lit(1).cast("long"), "id").select(column, "id")


def project_originals(files: DataFrame, clones: DataFrame) -> DataFrame:
    """project, files, unique_files (whose hash is nowhere else), contained_clones (pairs it hosts)."""
    once = files.groupBy("hash").count().where("count = 1").select("hash", F.lit(1).alias("u"))
    out = files.join(once, "hash", "left").groupBy("project").agg(F.count("*").alias("files"), F.count("u").alias("unique_files"))
    hosts = clones.groupBy(F.col("host").alias("project")).agg(F.count("*").alias("c"))
    return out.join(hosts, "project", "left").select("project", "files", "unique_files", F.coalesce("c", F.lit(0)).alias("contained_clones"))
