"""Path predicates as Columns: language, ignore rules, hidden folders, path classes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions and their languages.
LANGUAGES = {".java": "java", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".go": "go"}
#: Languages with a structural chunker.
STRUCTURAL = ("java", "javascript", "typescript")
#: The default ignore patterns.
IGNORE = ("target/**", "build/**", "dist/**", "out/**", "node_modules/**", ".pnp/**", "**/*.min.js", "**/*.bundle.js", ".git/**", ".idea/**", ".vscode/**", "*.iml")

#: Infixes and suffixes of the path classes, over the lower-cased path.
TEST_DIRS = ("/test/", "/tests/", "/__tests__/", "/spec/")
TEST_ENDS = ("_test.go", "_test.js", "_test.ts", ".test.js", ".test.ts", ".test.jsx", ".test.tsx", ".spec.js", ".spec.ts", ".spec.jsx", ".spec.tsx", "test.java", "tests.java")
MAIN_DIRS = ("/src/main/", "/src/core/", "/lib/", "/pkg/", "/internal/")
GENERATED = ("/vendor/", "/node_modules/", "/target/", "/build/", "/dist/", ".generated.", "_generated.")
TEST_FACTOR, MAIN_FACTOR, GENERATED_FACTOR = 0.05, 1.3, 0.2


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def extension(path: Column) -> Column:
    """Last extension of the last path element, lower-cased, with its dot; empty if none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def language(path: Column) -> Column:
    """Language by extension; null where it isn't supported."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, extension(path))


def has_parser(lang: Column) -> Column:
    return F.coalesce(lang.isin(*STRUCTURAL), F.lit(False))


def glob_regex(pattern: str, deep: bool = False) -> str:
    """Anchored regular expression of a glob; * stays within a path element, with
    ``deep`` ** crosses them."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if deep and pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if deep and pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in pattern[i + 2:]:
            end = pattern.index("]", i + 2)
            out += "[" + pattern[i + 1:end].replace("\\", "\\\\").replace("[", "\\[") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def ignored(path: Column, patterns=IGNORE, glob_mode: str = "compatible") -> Column:
    """Whether any pattern matches a slash-separated relative path.

    compatible: a pattern with ** matches by its literal pieces (its first piece as a
    prefix, every piece as a run of whole path elements); every pattern also matches as
    a glob over the path, as a glob over the last element, and as the name of
    any parent folder. gitignore: true ** globs, over the path and below matched folders.
    """
    name = F.substring_index(path, "/", -1)
    parts = F.split(path, "/")
    parents = F.slice(parts, F.lit(1), F.size(parts) - 1)
    tests: list[Column] = []
    for p in patterns:
        if glob_mode == "gitignore":
            deep = p if "/" in p.rstrip("/") else f"**/{p}"
            tests += [path.rlike(glob_regex(deep, deep=True)), path.rlike(glob_regex(deep.rstrip("/") + "/**", deep=True))]
            continue
        if "**" in p:
            pieces = p.split("**")
            first = pieces[0].removesuffix("/")
            if first:
                tests += [path == first, path.startswith(first + "/")]
            for q in (x.strip("/") for x in pieces if x not in ("", "/")):
                tests += [path.contains(f"/{q}/"), path.startswith(f"{q}/"), path.endswith(f"/{q}")]
        tests += [path.rlike(glob_regex(p)), name.rlike(glob_regex(p)), F.array_contains(parents, p.removesuffix("/**"))]
    return any_of(tests)


def hidden_folder(path: Column) -> Column:
    """Whether a parent folder's name begins with a dot (but isn't just one); hidden files don't count."""
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: x.startswith(".") & (x != "."))


def is_test(path: Column) -> Column:
    p = F.lower(path)
    return any_of([p.contains(x) for x in TEST_DIRS] + [p.endswith(x) for x in TEST_ENDS])


def is_main(path: Column) -> Column:
    p = F.lower(path)
    return any_of([p.contains(x) for x in MAIN_DIRS]) | (p.contains("/cmd/") & ~p.contains("/test"))


def is_generated(path: Column) -> Column:
    p = F.lower(path)
    return any_of([p.contains(x) for x in GENERATED])


def path_factor(path: Column) -> Column:
    """Score multiplier by path class; test goes before main, main before generated."""
    return F.when(is_test(path), TEST_FACTOR).when(is_main(path), MAIN_FACTOR).when(is_generated(path), GENERATED_FACTOR).otherwise(1.0)


def relative(path: Column, repo: Column) -> Column:
    return F.substr(path, F.length(repo) + 2)


def repo_key(repo: Column) -> Column:
    """Partition key of a repository: the first 16 hex digits of its path's digest."""
    return F.substring(F.sha2(repo, 256), 1, 16)
