"""Scalar functions as column expressions. All are null on null unless said otherwise."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- encoders of the text exports (SCL-01..05) -------------------------------------------------


def encode_bool(c: Column) -> Column:
    return F.upper(c.cast("string"))


def encode_enum(number: Column, names: tuple[str, ...]) -> Column:
    """The name of an enumeration's number, from 0; null for others."""
    return F.get(F.array(*map(F.lit, names)), number)


def encode_position(line: Column, column: Column) -> Column:
    return F.when(line.isNotNull() & column.isNotNull(), F.concat_ws(":", line.cast("string"), column.cast("string")))


def encode_list(c: Column) -> Column:
    """`;`-joined; null for an empty list."""
    return F.when(F.size(c) > 0, F.array_join(c, ";"))


# ---- paths, libraries, links (SCL-06..09) ------------------------------------------------------


def patched_path(path: Column) -> Column:
    """A path that leaves the repository by `../` becomes absolute, all `../` dropped."""
    return F.when(path.startswith("../"), F.concat(F.lit("/"), F.replace(path, F.lit("../"), F.lit("")))).otherwise(path)


def location_scope(kind: Column, scope: Column, managed: Column, internal: Column, transitive: Column) -> Column:
    """`scope[;managed]` of a source path, `scope[;managed][;dependency][;transitive]` of a class path;
    null if there is no path entry."""
    is_class = kind == "class"
    joined = F.concat_ws(
        ";",
        F.nullif(scope, F.lit("")),
        F.when(managed, "managed"),
        F.when(is_class & ~F.coalesce(internal, F.lit(False)), "dependency"),
        F.when(is_class & transitive, "transitive"),
    )
    return F.when(kind.isNotNull(), joined)


def github_url(project_id: Column, commit: Column, path: Column, uri: Column, line: Column) -> Column:
    """Link to a place in a project's repository, with the line, counted from 0, if it is known. The double slash after the
    commit is part of the format."""
    repo = F.replace(project_id, F.lit("--"), F.lit("/"))
    place = F.coalesce(F.concat(F.lit("#L"), (line + 1).cast("string")), F.lit(""))
    return F.concat(F.lit("https://github.com/"), repo, F.lit("/tree/"), commit, F.lit("//"), path, F.lit("/"), uri, place)


def code_snippet(code: Column) -> Column:
    """First 50 characters, `...` behind if there are more; line ends as spaces."""
    cut = F.when(F.length(code) > 50, F.concat(F.substring(code, 1, 50), F.lit("..."))).otherwise(code)
    return F.regexp_replace(cut, "\n", " ")


def locality(group_a: Column, artifact_a: Column, version_a: Column, group_b: Column, artifact_b: Column, version_b: Column) -> Column:
    """`module` for the same library, `project` for the same group, else null."""
    same = (group_a == group_b) & (artifact_a == artifact_b) & (version_a == version_b)
    return F.when(same, "module").when(group_a == group_b, "project")


# ---- symbols (SCL-13, 14): ids such as `p/o.C#m().(x)` ------------------------------------------

# What may stand for the last part of an id: [T] type parameter, (x) parameter, name(). method,
# name. term, name# type, name/ package; a name may be in backquotes.
_NAME = r"(`[^`]*`|[^`/#.()\[\]]+)"
_LAST = rf"(\[{_NAME}\]|\({_NAME}\)|{_NAME}\((\+\d+)?\)\.|{_NAME}[.#/])$"


def symbol_owner(symbol: Column) -> Column:
    """The enclosing symbol; empty for a top-level package and for block-local symbols."""
    local = symbol.rlike(r"^local\d+")
    return F.when(symbol.isNull(), None).when(local, "").otherwise(F.regexp_replace(symbol, _LAST, ""))


def compilation_unit(symbol: Column) -> Column:
    """Walking outwards, the last owner, or the symbol itself, that is a type or a term other than a
    method or type parameter; null if there is none."""

    def is_unit(s: Column) -> Column:
        return s.endswith("#") | (s.endswith(".") & ~s.endswith(").") & ~s.endswith("]."))

    # the outermost such prefix: after the packages, the first name and its # or .
    packages = rf"^(?:{_NAME}/)*"
    outer = F.regexp_extract(symbol, packages + rf"{_NAME}[.#]", 0)
    return F.when(outer != "", outer).when(is_unit(symbol), symbol)


def is_block_local(symbol: Column) -> Column:
    return symbol.rlike(r"^local\d+::\d+$")


def strip_last(c: Column) -> Column:
    return F.substring(c, F.lit(1), F.length(c) - 1)


# ---- numbers and time (SCL-15..17, 24, 25, 37, 38) ---------------------------------------------

THREE_MONTHS = 7_889_400  # seconds: 3 * 365.25 / 12 days


def ratio(x: Column, y: Column) -> Column:
    """0 where x is 0, else infinite where y is 0, else x / y."""
    x, y = x.cast("double"), y.cast("double")
    return F.when(x == 0, 0.0).when(y == 0, float("inf")).otherwise(x / y)


def format_size(c: Column) -> Column:
    """In the largest of the 1024-steps that leaves more than 1 of it."""
    units = ("B", "kB", "MB", "GB", "TB", "PB")
    out = F.format_string(f"%.2f {units[-1]}", c / float(1024 ** (len(units) - 1)))
    for i in reversed(range(len(units) - 1)):
        out = F.when(F.abs(c) / float(1024 ** (i + 1)) <= 1, F.format_string(f"%.2f {units[i]}", c / float(1024**i))).otherwise(out)
    return F.when(c.isNotNull(), out)


def format_count(c: Column) -> Column:
    return F.format_number(c, 0)


def format_percent(c: Column, digits: int = 1) -> Column:
    return F.concat(F.regexp_replace(F.format_number(F.round(c, digits), digits), r"\.0+$", ""), F.lit("%"))


def from_epoch(seconds: Column) -> Column:
    """A time from seconds since 1970."""
    return F.timestamp_seconds(seconds)


def month_index(ts: Column) -> Column:
    """Months since January 1999, by UTC."""
    return (F.year(ts) - 1999) * 12 + F.month(ts) - 1


# ---- versions and builds (SCL-18, 23, 26, 32..36) ----------------------------------------------


def parse_sbt_version(version: Column) -> Column:
    """array<int> of exactly three numbers, what follows a dash dropped; null if it isn't such, or
    the text is under five characters."""
    parts = F.split(F.regexp_replace(version, "-.*", ""), r"\.")
    numbers = F.transform(parts, lambda p: F.when(p.rlike(r"^\d{1,9}$"), p).cast("int"))
    return F.when((F.length(version) >= 5) & (F.size(parts) == 3) & F.forall(numbers, lambda n: n.isNotNull()), numbers)


def _at_least(version: Column, *least: int) -> Column:
    return F.forall(F.zip_with(version, F.array(*map(F.lit, least)), lambda v, n: v >= n), lambda x: x)


def is_compatible_sbt(version: Column) -> Column:
    """Each number at least 1.0.0's or each at least 0.13.5's: 0.14.0 is not. Null if unparseable."""
    v = parse_sbt_version(version)
    return F.when(v.isNotNull(), _at_least(v, 1, 0, 0) | _at_least(v, 0, 13, 5))


def sbt_bucket(version: Column) -> Column:
    v = parse_sbt_version(version)
    old = (F.get(v, 0) == 0) & (F.get(v, 1) < 13) & (F.get(v, 2) < 5)
    return F.when(v.isNull(), "Unknown").when(_at_least(v, 1, 0, 0), ">= 1.0").when(_at_least(v, 0, 13, 5), ">= 0.13.5").when(old, "< 0.13.5").otherwise("Unknown")


def without_version(module_id: Column) -> Column:
    """`project::group:artifact:version:platform` without its version."""
    return F.regexp_replace(module_id, r"^(.*)::([^:]*):([^:]*):[^:]*:([^:]*)$", "$1::$2:$3:$4")


# Markers of build systems, first found counts.
BUILD_FILES = (
    ("build.sbt", "sbt"), ("project/build.properties", "sbt"), ("pom.xml", "maven"), ("build.sc", "mill"), ("build.gradle", "graddle"),
    ("build/build.scala", "cbt"), ("pom.scala", "maven-scala"), ("pom.groovy", "maven-groovy"), ("pom.yml", "maven-yml"), ("pom.clojure", "maven-clojure"),
    ("pom.ruby", "maven-ruby"), ("pom.java", "maven-java"), ("Makefile", "make"),
)


def build_system(files: Column) -> Column:
    """files: array<string> of a project's paths."""
    return F.coalesce(*(F.when(F.array_contains(files, f), s) for f, s in BUILD_FILES))


def sbt_version_of(lines: Column) -> Column:
    """Of a properties file's lines: the last sbt.version."""
    last = F.try_element_at(F.filter(lines, lambda x: x.rlike(r"^\s*sbt\.version\s*=")), F.lit(-1))
    return F.trim(F.regexp_extract(last, r"=\s*(.*)$", 1))


# The Scala versions that analysis supports.
SCALA_211, SCALA_212 = [f"2.11.{x}" for x in (9, 10, 11, 12)], [f"2.12.{x}" for x in (4, 5, 6, 7, 8)]


def supported_scala(version: Column) -> Column:
    is_211 = version.startswith("2.10.") | version.startswith("2.11.")
    return F.when(version.isin(SCALA_211 + SCALA_212), version).when(is_211, "2.11.12").when(version.isNotNull(), "2.12.7")


def platform(libraries: Column, native: list[str], js: list[str]) -> Column:
    """native before js before jvm, by whether libraries hold all of a platform's."""
    has = lambda x: F.size(F.array_except(F.array(*map(F.lit, x)), libraries)) == 0
    return F.when(has(native), "native").when(has(js), "js").otherwise("jvm")


def bare_artifact(artifact: Column) -> Column:
    return F.regexp_replace(artifact, r"_2\.1\d$", "")


# ---- flags (SCL-19..22) ------------------------------------------------------------------------


def scope_flags(scope: Column) -> dict[str, Column]:
    main, test = scope.contains("compile"), scope.contains("test")
    external, managed = scope.contains("dependency"), scope.contains("managed")
    return {
        "is_in_main": main, "is_in_test": test, "is_external": external, "is_local": ~external, "is_managed": managed,
        "is_external_test": external & test, "is_local_test": ~external & test, "is_managed_test": managed & test,
    }


def access_flags(access: Column) -> dict[str, Column]:
    return {"is_access_specified": access != "NOT_SPECIFIED", "is_public": access == "PUBLIC", "is_private": access.startswith("PRIVATE"), "is_protected": access.startswith("PROTECTED")}


def from_scala_flags(external: Column, group: Column, test: Column) -> dict[str, Column]:
    is_scala = external & group.startswith("org.scala-lang")
    return {"is_from_scala": is_scala, "is_from_scala_test": is_scala & test}


# ---- logs (SCL-28..31) -------------------------------------------------------------------------

# What a build log's lines say of a failure, first found counts; group 1, if any, is the detail.
FAILURES = (
    ("sbt-class-not-found", r"\[error\] java.lang.ClassNotFoundException: \$.*", 0),
    ("missing-dependencies", r"\[error\] \([^)]+\) sbt.ResolveException: unresolved dependency: ([^:]+):.*", 1),
    ("missing-dependencies", r"\[error\] \([^)]+\) sbt.librarymanagement.ResolveException: unresolved dependency: ([^:]+):.*", 1),
    ("missing-dependencies", "coursier.ResolutionException", -1),
    ("out-of-memory", "Error during sbt execution: java.lang.OutOfMemoryError", 0),
    ("out-of-memory", "java.lang.OutOfMemoryError", 0),
    ("compilation-failed", r"\[error\] \([^)]+\) Compilation failed", 0),
    ("java-exception", r"\[error\] \([^)]+\) (.*Exception.*)", 1),
    ("java-error", r"\[error\] \([^)]+\) (.*Error.*)", 1),
    ("project-loading-failed", "^Project loading failed:", 0),
    ("unknown-metadata-command", r"\[error\] Not a valid command: metadata", 0),
    ("unknown-semanticdb-command", r"\[error\] Not a valid command: semanticdb", 0),
)


def _matches(pattern: str, line: Column) -> Column:
    return line.rlike(pattern)


def failure_cause(lines: Column) -> Column:
    """struct<cause, detail> of a log's last lines. Detail is the first line that told, or what it
    names; of an unresolved coursier artifact the line behind; of an unknown cause all error
    lines. Null lines: the log does not exist."""
    text = "string"
    cause, detail = F.lit("unknown"), F.when(F.exists(lines, lambda x: x.contains("[error]")), F.array_join(F.filter(lines, lambda x: x.contains("[error]")), "\n"))
    for name, pattern, group in reversed(FAILURES):
        matches = partial(_matches, pattern)
        first = F.get(F.filter(lines, lambda x: matches(x)), 0)
        if group == -1:
            at = F.array_position(F.transform(lines, lambda x: matches(x)), True).cast("int")
            said = F.trim(F.replace(F.get(lines, at), F.lit("[error]"), F.lit("")))
        elif group:
            # the whole line, with the match replaced by what it names
            said = F.regexp_replace(first, pattern, "$1")
        else:
            said = first
        cause, detail = F.when(first.isNotNull(), name).otherwise(cause), F.when(first.isNotNull(), said).otherwise(detail)
    missing = lines.isNull()
    return F.struct(F.when(missing, "log-file-does-not-exist").otherwise(cause).alias("cause"), F.when(~missing, detail).cast(text).alias("detail"))


# Classes of extraction failures by exception, a pattern in its message, and its cause, first found counts.
EXCEPTIONS = (
    ("SymbolNotFoundException", r"local\d+", None, "missing-local-symbol"),
    ("SymbolNotFoundException", r"at Range\(\d+,\d+,\d+,\d+\)", None, "missing-symbol-at-range"),
    ("SymbolNotFoundException", None, None, "missing-symbol-other"),
    ("LoadingMetadataException", r"(?s)(?=.*No module found)(?=.*multi-jvm)", None, "missing-module-multijvm"),
    ("LoadingMetadataException", "No module found", None, "missing-module"),
    ("LoadingMetadataException", None, None, "metadata-loading"),
    ("NotImplementedError", None, None, "not-implemented"),
    ("UnexpectedElementException", None, None, "unexpected-element"),
    ("UnsupportedElementException", None, None, "unsupported-element"),
    ("UnExtractableCallSiteException", None, "SymbolNotFoundException", "unextractable-callsite-missing-term"),
    ("UnExtractableCallSiteException", None, "FunctionNotFoundException", "unextractable-callsite-missing-function"),
    ("UnExtractableCallSiteException", None, None, "unextractable-callsite-other"),
    ("ImplicitArgumentNotFoundException", None, None, "missing-implicit-arguments"),
    ("Exception", "^Invalid call site argument", None, "invalid-declaration"),
)


def exception_class(exception: Column, message: Column, cause: Column) -> Column:
    """The class of the first of EXCEPTIONS that fits; `unclassified` if none does."""

    def fits(name: str, pattern: str | None, of: str | None) -> Column:
        hit = exception == name
        hit = hit & message.rlike(pattern) if pattern else hit
        return hit & (cause == of) if of else hit

    return F.coalesce(*(F.when(fits(*rule), label) for *rule, label in EXCEPTIONS), F.lit("unclassified"))


def missing_symbol(message: Column) -> Column:
    return F.nullif(F.regexp_extract(message, "symbol: (.*)$", 1), F.lit(""))


# Phases that a compiler's log times.
PHASES = ("#total compile time", "typer", "xsbt-api", "xsbt-dependency", "xsbt-analyzer", "time spent in implicits", "time spent in macroExpand")


def phase_timing(line: Column, phase: str) -> tuple[Column, Column]:
    """(spans, milliseconds) that a log line gives for a phase; null for other lines."""
    said = F.split(line, ":", 2)  # the phase, then its numbers, each before its unit
    label, numbers = F.trim(F.regexp_replace(F.get(said, 0), r"^\[\w+\]", "")), F.get(said, 1)
    before = lambda unit: F.nullif(F.regexp_extract(numbers, rf"([0-9.]+)\s*{unit}", 1), F.lit(""))
    hit = line.startswith("[info]") & (label == phase) & before("spans").isNotNull() & before("ms").isNotNull()
    return F.when(hit, before("spans").try_cast("long")), F.when(hit, before("ms").try_cast("double"))


# ---- files (SCL-39..43) ------------------------------------------------------------------------


def path_features(path: Column) -> dict[str, Column]:
    """Depth, node_modules depth, test and locale flags, last and first module, file name,
    extension, path within the last module."""
    # a trailing slash does not make a part
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/", -1)
    last = F.element_at(parts, -1)
    at = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.get(parts, i) == "node_modules")
    named = F.filter(at, lambda i: i + 2 < F.size(parts))
    module = lambda i: F.coalesce(F.get(parts, i + 1), F.lit(""))
    has = lambda *x: F.exists(parts, lambda p: p.isin(*x))
    last_at = F.try_element_at(named, F.lit(-1))
    first_named = F.get(named, 0) == F.get(at, 0)
    return {
        "depth": F.size(parts),
        "npm_depth": F.size(at),
        "is_test": has("test", "tests").cast("int"),
        "is_locale": (last.contains("locale-") | has("locale", "locales")).cast("int"),
        "module": F.when(last_at.isNotNull(), module(last_at)).otherwise(""),
        "first_module": F.when(first_named, module(F.get(named, 0))).otherwise(""),
        "file_name": F.regexp_replace(last, r"(\.min)?\.js$", ""),
        "file_ext": F.when(last.endswith(".min.js"), "min.js").when(last.endswith(".js"), "js").otherwise(""),
        "in_module": F.when(last_at.isNotNull(), F.array_join(F.slice(parts, last_at + 3, F.size(parts)), "/")).otherwise(""),
    }


def escape_csv(c: Column) -> Column:
    """Backslash before quotes and backslashes; line ends and tabs as \\n and \\t."""
    out = F.regexp_replace(c, r"([\"'\\])", r"\\$1")
    return F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))


def chunk_id(ident: Column, chunk: int, n: int) -> Column:
    """ident * n + chunk unless ident is chunk modulo n already."""
    return F.when(F.pmod(ident, F.lit(n)) == chunk, ident).otherwise(ident * n + chunk)
