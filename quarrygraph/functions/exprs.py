"""Derived keys and predicates as Column expressions, each defined once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that are not part of an analysed code base.
LIBRARY_NAMES = [
    "len", "str", "int", "float", "bool", "list", "dict", "set", "tuple", "isinstance", "issubclass", "hasattr", "getattr", "setattr",
    "print", "range", "enumerate", "zip", "map", "filter", "super", "type", "object", "None", "True", "False", "logging", "asyncio", "json",
    "os", "sys", "pathlib", "asyncio.run", "json.dumps", "json.loads",
]
# Ends of generic method calls.
GENERIC_METHODS = [
    ".get", ".append", ".extend", ".items", ".keys", ".values", ".strip", ".split", ".replace", ".format", ".encode", ".decode", ".join",
    ".pop", ".update", ".add", ".remove", ".clear", ".startswith", ".endswith", ".lower", ".upper",
]
# Names that may have no relations.
UNLINKED_NAMES = [
    "EntityData", "RelationData", "CompareResult", "DepsResult", "TopologyResult", "ImpactResult", "OverviewResult", "CouplingMetrics",
    "SimilarResult", "ChangedFile", "ChangedSymbol", "Caller", "EmbeddingResult", "to_dict", "__post_init__", "ChangeType", "ErrorCode",
    "reset_settings", "workspace",
]
# Ends of class names that may have no relations.
UNLINKED_ENDS = [
    "Analyzer", "Extractor", "Parser", "Assessor", "Client", "Config", "Result", "Info", "Error", "Data", "DTO", "Model", "Schema",
]
# Names that everything may depend on.
SHARED_NAMES = ["output_success", "output_error", "output_partial_error", "get_settings", "get_auto_workspace"]
# Functions that are long by nature, matched from the start of the name.
INTRICATE_FUNCTIONS = [
    r".*Parser\.visit_.*", r".*Parser\._parse_.*", r".*Parser\._extract_.*", r".*\.generate_.*", r".*\.render_.*", r".*\.format_.*_output",
    r".*\.format_.*_report", r".*Command\.execute", r".*CLI\._handle_.*", r".*\.main$", r".*\.package_.*", r".*\.build_.*",
]
# Modules whose change is always risky.
CORE_MODULES = ["auth", "authentication", "billing", "config", "core", "database", "db", "payment", "security", "settings"]
# Subjects of bug fixes.
BUG_FIX_SUBJECTS = [r"^fix:", r"^Fix\s", r"^bugfix:", r"^hotfix:", r"\bfix\b.*\bbug\b", r"\bfix\b.*\bissue\b"]
# Globs of generated files; * matches any characters, / too.
GENERATED_FILES = ["README_AI.md", "**/README_AI.md", "CHANGELOG.md", "poetry.lock", "package-lock.json", "Pipfile.lock", "yarn.lock", "**/__pycache__/**", "**/*.pyc"]

CONTAINER_TYPES = ["module", "file"]


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def path_parts(path: Column) -> Column:
    """The segments of a POSIX path: empty and '.' segments vanish, a leading '/' is a segment of its own."""
    parts = F.filter(F.split(text(path), "/"), lambda x: (x != "") & (x != "."))
    return F.when(text(path).startswith("/"), F.concat(F.array(F.lit("/")), parts)).otherwise(parts)


def module_of(path: Column, depth: int | Column = 2) -> Column:
    """The first ``depth`` directories of a file's path, '.' if it has none. The last segment is the file."""
    parts = path_parts(path)
    n = F.least(F.lit(depth) if isinstance(depth, int) else depth, F.size(parts) - 1)
    return F.when(F.size(parts) <= 1, ".").otherwise(F.array_join(F.slice(parts, 1, F.greatest(n, F.lit(1))), "/"))


def store_module(source: Column, depth: int = 2, prefix: str = "") -> Column:
    """The first ``depth`` segments of a source, after ``prefix``, the file among them."""
    s = text(source)
    if prefix:
        s = F.when(s.startswith(prefix), F.substring(s, len(prefix) + 1, 1 << 30)).otherwise(s)
    return F.array_join(F.slice(F.split(s, "/"), 1, depth), "/")


def directories(source: Column) -> Column:
    """How many directories a source's path has."""
    return F.greatest(F.size(path_parts(source)) - 1, F.lit(0))


def without_lines(source: Column) -> Column:
    """A source without what follows its last colon, if that begins with a digit or '-'."""
    return F.regexp_replace(source, r"(?<=.):[0-9-][^:]*$", "")


def without_line_range(source: Column) -> Column:
    return F.regexp_replace(source, r":\d+(-\d+)?$", "")


def file_of(source: Column) -> Column:
    return F.substring_index(source, ":", 1)


def file_name(source: Column) -> Column:
    return F.element_at(F.split(file_of(source), "/"), -1)


def file_and_line(source: Column) -> tuple[Column, Column]:
    """(file, line) of 'file:line' or 'file:first-last'; the whole and 0 if there is no number."""
    ok = text(source).rlike(r"^.*:\s*[+]?\d+\s*(-[^:]*)?$")
    line = F.regexp_extract(text(source), r":\s*[+]?(\d+)\s*(-[^:]*)?$", 1)
    return F.when(ok, F.regexp_replace(source, r":[^:]*$", "")).otherwise(text(source)), F.when(ok, line.cast("int")).otherwise(0)


def python_module(path: Column) -> Column:
    """'a/b.py' as 'a.b'; '' for other files."""
    dotted = F.regexp_replace(F.expr("''") if path is None else F.regexp_replace(path, r"\.py$", ""), r"[/\\]", ".")
    return F.when(path.endswith(".py"), F.regexp_replace(dotted, r"^\.+", "")).otherwise("")


def is_test_source(source: Column) -> Column:
    """Where imported symbols come from tests."""
    s = F.lower(text(source))
    base = F.regexp_extract(s, r"([^/\\]*)$", 1)
    marks = s.contains(".test.") | s.contains(".spec.") | s.contains("__tests__") | s.contains("/tests/") | s.contains("\\tests\\")
    return marks | base.startswith("test_") | base.endswith("_test.py")


def is_test_file(path: Column) -> Column:
    """Which affected files are tests; other rules than for imports."""
    p = text(path)
    return p.startswith("tests/") | p.startswith("test/") | p.contains("/tests/") | p.contains("/test/") | p.endswith("_test.py") | F.element_at(F.split(p, "/"), -1).contains("test_")


def is_noise(name: Column) -> Column:
    return name.isin(LIBRARY_NAMES) | name.rlike(f"({'|'.join(m.replace('.', chr(92) + '.') for m in GENERIC_METHODS)})$")


def is_external(kind: Column, source: Column) -> Column:
    return (text(kind) == "external") | (text(source) == "external")


def may_be_unlinked(name: Column, source: Column) -> Column:
    """Entities that are no finding although nothing is related to them: tests, models, data classes, dunder methods."""
    s = text(source)
    by_source = s.contains("tests/") | s.startswith("test_") | s.contains("models.py") | s.contains("/models/")
    sep = F.when(name.contains("::"), "::").when(name.contains("."), ".")
    parts = F.when(name.contains("::"), F.split(name, "::")).otherwise(F.split(name, r"\."))
    last, first = F.element_at(parts, -1), F.element_at(parts, 1)
    method = sep.isNotNull() & (last.isin(UNLINKED_NAMES) | (last.startswith("__") & last.endswith("__")))
    return name.isin(UNLINKED_NAMES) | by_source | F.coalesce(method, F.lit(False)) | first.rlike(rf"({'|'.join(UNLINKED_ENDS)})$")


def is_intricate(name: Column) -> Column:
    return name.rlike(intricate_pattern())


def intricate_pattern() -> str:
    return f"^(?:{'|'.join(INTRICATE_FUNCTIONS)})"


def is_core_module(path: Column) -> Column:
    return F.lower(text(path)).rlike(rf"(^|/)({'|'.join(CORE_MODULES)})[/.]")


def core_module(path: Column) -> Column:
    """The core module's name within the path."""
    return F.regexp_extract(F.lower(text(path)), rf"(?:^|/)({'|'.join(CORE_MODULES)})[/.]", 1)


def is_bug_fix(subject: Column) -> Column:
    return text(subject).rlike(f"(?i)(?:{'|'.join(BUG_FIX_SUBJECTS)})")


def is_generated_file(path: Column) -> Column:
    globs = "|".join("".join(".*" if c == "*" else f"\\{c}" if not c.isalnum() and c != "_" else c for c in g.replace("**", "*")) for g in GENERATED_FILES)
    return path.rlike(f"^(?:{globs})$")


def is_trusted(qualifier: Column) -> Column:
    return F.coalesce(qualifier, F.lit("resolved")) == "resolved"
