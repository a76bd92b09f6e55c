"""Text Columns: lines, tokens, limits, matches, digests, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"\w+|[^\w\s]"
#: Longest text that is embedded, and the byte limit of a chunk.
EMBED_CHARS = CHUNK_BYTES = 4000
PREVIEW_LINES, PREVIEW_CHARS = 3, 80

#: Lines that begin a unit of code, by language (over the trimmed line). Languages that no file
#: extension leads to can be asked for by name.
BOUNDARY = {
    "java": (
        r"(?:(?:public|private|protected)\s+)?(?:static\s+)?class\s+\w+",
        r"(?:(?:public|private|protected)\s+)?(?:static\s+)?interface\s+\w+",
        r"(?:(?:public|private|protected)\s+)?(?:static\s+)?enum\s+\w+",
        r"(?:(?:public|private|protected)\s+)?(?:static\s+)?[\w<>\[\]]+\s+\w+\s*\([^)]*\)\s*\{?",
        r"@\w+",
    ),
    "javascript": (
        r"export\s+(?:default\s+)?function\s+\w+",
        r"export\s+(?:default\s+)?class\s+\w+",
        r"export\s+(?:const|let|var)\s+\w+",
        r"(?:async\s+)?function\s+\w+",
        r"class\s+\w+",
        r"(?:const|let|var)\s+\w+\s*=\s*(?:async\s+)?\([^)]*\)\s*=>",
    ),
    "typescript": (
        r"export\s+(?:default\s+)?function\s+\w+",
        r"export\s+(?:default\s+)?class\s+\w+",
        r"export\s+(?:const|let|var)\s+\w+",
        r"(?:async\s+)?function\s+\w+",
        r"class\s+\w+",
        r"(?:const|let|var)\s+\w+\s*=\s*(?:async\s+)?\([^)]*\)\s*=>",
        r"export\s+(?:interface|type)\s+\w+",
        r"interface\s+\w+",
        r"type\s+\w+\s*=",
    ),
    "go": (r"func\s+\w+", r"func\s+\([^)]*\)\s+\w+", r"type\s+\w+\s+(?:struct|interface)", r"(?:const|var)\s+\w+"),
    "python": (r"def\s+\w+", r"class\s+\w+", r"async\s+def\s+\w+", r"@\w+"),
    "rust": (r"(?:pub\s+)?fn\s+\w+", r"(?:pub\s+)?struct\s+\w+", r"(?:pub\s+)?enum\s+\w+", r"(?:pub\s+)?trait\s+\w+", r"(?:pub\s+)?impl"),
    "c": (r"\w+\s+\w+\s*\([^)]*\)\s*\{?", r"struct\s+\w+", r"typedef"),
    "cpp": (r"\w+\s+\w+::\w+\s*\([^)]*\)", r"class\s+\w+", r"struct\s+\w+", r"namespace\s+\w+", r"template\s*<"),
    "": (r"function\s+\w+", r"class\s+\w+", r"def\s+\w+"),
}
#: Statements that look like "type name(args)" but begin nothing.
NOT_A_TYPE = r"(?!(?:return|else|throw|new|await|case|goto|typeof|delete)\b)"


def boundary_pattern(lang: str | None, compat: bool = False) -> str:
    """One anchored pattern for a language's boundary lines; without ``compat``,
    statements led by a keyword don't count."""
    own = BOUNDARY.get(lang or "", BOUNDARY[""])
    return rf"^\s*{'' if compat else NOT_A_TYPE}(?:{'|'.join(own)})"


def is_boundary(line: Column, lang: str | None, compat: bool = False) -> Column:
    return line.rlike(boundary_pattern(lang, compat))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_count(text: Column) -> Column:
    return F.size(lines(text)).cast("long")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)\S")


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def chunk_limits(n_lines: Column, small: int = 300, medium: int = 200, large: int = 150) -> Column:
    """struct<max_tokens, overlap> by a file's lines: under 1,000, under 5,000, more."""
    if small <= 0:
        return F.struct(F.lit(200).alias("max_tokens"), F.lit(20).alias("overlap"))
    size = F.when(n_lines < 1000, small).when(n_lines < 5000, medium).otherwise(large)
    over = F.when(n_lines < 1000, small // 15).when(n_lines < 5000, medium // 10).otherwise(large // 7)
    return F.struct(size.alias("max_tokens"), over.alias("overlap"))


def contains_text(content: Column, query: str) -> Column:
    """Case-blind substring."""
    return F.contains(F.lower(content), F.lit(query.lower()))


def query_words(query: str) -> tuple[list[str], int]:
    """Words of more than two bytes (repeats stay) and the number of all words."""
    w = query.lower().split()
    return [x for x in w if len(x.encode()) > 2], len(w)


def matched_words(content: Column, query: str) -> Column:
    """How many of the query's longer words the content has as substrings."""
    low = F.lower(content)
    out = F.lit(0)
    for w in query_words(query)[0]:
        out = out + F.contains(low, F.lit(w)).cast("int")
    return out


def match_positions(content: Column, query: str) -> Column:
    """Byte offsets of the query in the content, both lower-cased, left to right, not overlapping."""
    if not query:
        raise ValueError("the query is empty")
    q = query.lower()
    parts = F.split(F.lower(content), "\\Q" + q.replace("\\E", "\\E\\\\E\\Q") + "\\E")
    step = len(q.encode())
    at = F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array().cast("array<int>"),
                     lambda a, p: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1) + step, F.lit(0)) + F.octet_length(p))))
    return at


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def chunk_id(*parts: Column) -> Column:
    """Id by content, so that a repeated run makes the same rows."""
    return F.sha2(F.concat_ws("\u0001", *[p.cast("string") for p in parts]), 256)


def cut(text: Column, n: int = EMBED_CHARS) -> Column:
    return F.substring(text, 1, n)


def preview(content: Column) -> Column:
    """First lines, trimmed, cut and indented, joined by line ends."""
    def show(x: Column) -> Column:
        t = F.regexp_replace(x, r"^\s+|\s+$", "")
        return F.concat(F.lit("    "), F.when(F.length(t) > PREVIEW_CHARS, F.concat(F.substring(t, 1, PREVIEW_CHARS), F.lit("..."))).otherwise(t))
    return F.array_join(F.transform(F.slice(lines(content), 1, PREVIEW_LINES), show), "\n")


def format_result(rank: Column, path: Column, start: Column, end: Column, score: Column, exact: Column, lang: Column, kind: Column, content: Column, symbol: Column | None = None) -> Column:
    """One result as text."""
    where = F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
    if symbol is not None:
        where = F.concat(where, F.when(F.coalesce(symbol, F.lit("")) != "", F.concat(F.lit(" in "), symbol)).otherwise(F.lit("")))
    n = F.size(lines(content))
    more = F.when(n > PREVIEW_LINES, F.concat(F.lit("\n    ... ("), (n - PREVIEW_LINES).cast("string"), F.lit(" more lines)"))).otherwise(F.lit(""))
    return F.concat(rank.cast("string"), F.lit(". "), where, F.format_string(" (score: %.3f)", score), F.when(exact, F.lit(" [EXACT MATCH]")).otherwise(F.lit("")),
                    F.lit("\n   Language: "), F.coalesce(lang, F.lit("")), F.lit(" | Type: "), kind, F.lit("\n"), preview(content), more)
