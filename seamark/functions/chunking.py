"""Chunkers: files to chunks of lines, by token budget or by structure.

State runs along the lines of one file, so these are Python over Arrow batches;
files stay in their task, there is no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .structure import LANGUAGES, Unit, units
from .text import CHUNK_BYTES, TOKEN, boundary_pattern

LOOK_AHEAD = 10
STRETCH = 1.2
MIN_BYTES = 10
SUMMARY_LINES, SUMMARY_METHODS, SIGNATURE_CHARS = 51, 20, 100
_TOKEN = re.compile(TOKEN, re.A)


def count_tokens(s: str) -> int:
    return len(_TOKEN.findall(s))


@dataclass(frozen=True)
class Limits:
    """Token budget of a chunk and of the overlap with the one before."""

    max_tokens: int = 300
    overlap: int = 20

    def __post_init__(self):
        if self.max_tokens <= 0 or self.overlap < 0 or self.overlap >= self.max_tokens:
            raise ValueError("max_tokens must be positive and more than overlap, which must not be negative")


class Sizes(NamedTuple):
    """Token budgets of files of less than 1,000 lines, less than 5,000, and more."""

    small: int = 300
    medium: int = 200
    large: int = 150


def limits_for(n_lines: int, small: int = 300, medium: int = 200, large: int = 150) -> Limits:
    if small <= 0:
        return Limits(200, 20)
    return Limits(small, small // 15) if n_lines < 1000 else Limits(medium, medium // 10) if n_lines < 5000 else Limits(large, large // 7)


@dataclass
class Piece:
    """A chunk: lines start to end (1-based, inclusive)."""

    start: int
    end: int
    content: str
    kind: str = "function"
    function: str = ""
    cls: str = ""
    parent: int | None = None
    meta: dict = field(default_factory=dict)


def overlap_lines(lines: list[str], budget: int) -> int:
    """How many of the last lines fit the budget; one line always, and the line that
    breaks the budget if all stay within a fifth more."""
    total = held = 0
    if budget <= 0:
        return 0
    for line in reversed(lines):
        total += count_tokens(line)
        if total > budget:
            return held + (held == 0 or total <= STRETCH * budget)
        held += 1
    return held


def token_chunks(content: str, language: str | None, limits: Limits | Sizes | None = None, compat: bool = False) -> list[Piece]:
    """Chunks of at most max_tokens tokens (a single longer line has no other in its chunk), each beginning with an overlap.

    When the budget is reached, a boundary line within the next ten lines ends the chunk
    there. A chunk of more than CHUNK_BYTES characters is split. ``compat``: it is cut there instead, start
    lines of later chunks are one too small and a last chunk of nothing but overlap is kept.
    """
    if not content.strip():
        return []
    lines = content.split("\n")
    if not isinstance(limits, Limits):
        limits = limits_for(len(lines), *(limits or Sizes()))
    bound = re.compile(boundary_pattern(language, compat))
    tokens = [count_tokens(x) for x in lines]
    out: list[Piece] = []
    start, back, held, used, fresh, i = 0, 0, 0, 0, 0, 0

    def emit(stop: int) -> None:
        body = "\n".join(lines[start:stop])
        if body.strip():
            first = start + (0 if compat and out else 1)
            if compat or len(body) <= CHUNK_BYTES:
                out.append(Piece(first, first + stop - start - 1, body[:CHUNK_BYTES]))
            else:
                # Pieces of the overlap alone are in the chunk before.
                out.extend(Piece(*p) for p in split_large(lines[start:stop], first) if p[2].strip() and p[1] > start + back)

    while i < len(lines):
        if held and used + tokens[i] > limits.max_tokens and fresh:
            stop = next((j + 1 for j in range(i, min(i + LOOK_AHEAD, len(lines))) if bound.search(lines[j])), None)
            end = stop or i
            emit(end)
            back = overlap_lines(lines[start:end], limits.overlap)
            start, i = end - back, end
            held, used, fresh = back, sum(tokens[start:end]), 0
            if stop is None:
                held, used, fresh, i = held + 1, used + tokens[i], 1, i + 1
            continue
        held, used, fresh, i = held + 1, used + tokens[i], 1, i + 1
    if fresh or (compat and held):
        emit(len(lines))
    return out


def split_large(lines: list[str], first_line: int, max_bytes: int = CHUNK_BYTES) -> list[tuple[int, int, str]]:
    """start, end, text of pieces of at most max_bytes bytes (a longer line: cut between characters,
    at least one a piece) with an overlap of a tenth of the lines (1 to 10). Nothing is lost."""
    overlap = min(10, max(1, len(lines) // 10))
    size = [len(x.encode("utf-8", "surrogatepass")) + 1 for x in lines]
    out, lo, n = [], 0, len(lines)
    while lo < n:
        hi, total = lo, 0
        while hi < n and (hi == lo or total + size[hi] <= max_bytes):
            total += size[hi]
            hi += 1
        text = "\n".join(lines[lo:hi])
        if len(text.encode("utf-8", "surrogatepass")) > max_bytes:
            raw = text.encode("utf-8", "surrogatepass")
            k = 0
            while k < len(raw):
                stop = k + max_bytes
                while stop > k and stop < len(raw) and raw[stop] & 0xC0 == 0x80:
                    stop -= 1
                if stop == k:  # a character of more than max_bytes
                    stop += 1
                    while stop < len(raw) and raw[stop] & 0xC0 == 0x80:
                        stop += 1
                out.append((first_line + lo, first_line + hi - 1, raw[k:stop].decode("utf-8", "surrogatepass")))
                k = stop
        else:
            out.append((first_line + lo, first_line + hi - 1, text))
        if hi >= n:
            break
        lo = max(hi - overlap, lo + 1)
    return out


def structural_chunks(content: str, language: str, max_bytes: int = CHUNK_BYTES, compat: bool = False, hierarchy: bool = True) -> list[Piece]:
    """Chunks of classes, methods and functions; with ``hierarchy`` a class over max_bytes becomes a
    summary with its methods linked to it. Longer units are split. ``compat``: methods of
    such a class come again as functions."""
    found = units(content, language)
    out: list[Piece] = []
    by_unit: dict[int, int] = {}
    ends = [m.start() for m in re.finditer("\n", content)]
    members: dict[int, list[Unit]] = {}
    for u in found:
        if u.kind == "method" and u.parent is not None:
            members.setdefault(u.parent, []).append(u)

    def lines_of(u: Unit) -> tuple[int, int]:
        return bisect_left(ends, u.begin) + 1, bisect_left(ends, max(u.begin, u.end - 1)) + 1

    def add(u: Unit, kind: str, parent: int | None = None) -> None:
        body = content[u.begin:u.end]
        if len(body.strip().encode("utf-8", "surrogatepass")) < MIN_BYTES:
            return
        first, last = lines_of(u)
        names = {"cls": u.name} if u.kind == "class" else {"function": u.name}
        owner = found[u.parent].name if u.parent is not None and found[u.parent].kind == "class" else ""
        if owner and u.kind != "class":
            names["cls"] = owner
        parts = [(first, last, body)] if len(body.encode("utf-8", "surrogatepass")) <= max_bytes else split_large(body.split("\n"), first, max_bytes)
        for a, b, t in parts:
            out.append(Piece(a, b, t, kind, parent=parent, **names))

    for i, u in enumerate(found):
        large = hierarchy and u.kind == "class" and len(content[u.begin:u.end].encode("utf-8", "surrogatepass")) > max_bytes
        if large:
            own = members.get(i, [])
            first, last = lines_of(u)
            head_end = min([m.begin for m in own] or [u.end])
            head = content[u.begin:head_end].rstrip().split("\n")[:SUMMARY_LINES]
            names = []
            for m in own[:SUMMARY_METHODS]:
                sig = next((x.strip() for x in content[m.begin:m.end].split("\n") if m.name in x), m.name)
                names.append("  " + sig[:SIGNATURE_CHARS])
            more = [f"  ... and {len(own) - SUMMARY_METHODS} more methods"] if len(own) > SUMMARY_METHODS else []
            by_unit[i] = len(out)
            out.append(Piece(first, last, "\n".join([*head, "Methods:", *names, *more])[:max_bytes], "class", cls=u.name))
        elif u.kind == "method" and u.parent in by_unit:
            add(u, "method", by_unit[u.parent])
            if compat:
                add(u, "function")
        else:
            add(u, "class" if u.kind == "class" else "function")
    return out


def chunk_text(content: str, language: str | None, limits: Limits | Sizes | None = None, max_bytes: int = CHUNK_BYTES, compat: bool = False, hierarchy: bool = True) -> list[Piece]:
    """Structure where the language has it and some is found, else token budget. Blank: none."""
    if not content or not content.strip():
        return []
    found = structural_chunks(content, language, max_bytes, compat, hierarchy) if language in LANGUAGES else []
    return found or token_chunks(content, language, limits, compat)


_FIELDS = ("repo_path string, file_path string, language string, chunk_type string, content string, start_line int, end_line int, function_name string, "
           "class_name string, ordinal int, parent_ordinal int")


def chunk_files(files: DataFrame, limits: Limits | Sizes | None = None, max_bytes: int = CHUNK_BYTES, compat: bool = False, hierarchy: bool = True) -> DataFrame:
    """Chunks of files(repo_path, file_path, language, content); null content gives none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for repo, path, lang, content in zip(*(c.to_pylist() for c in b.columns)):
                for k, p in enumerate(chunk_text(content or "", lang, limits, max_bytes, compat, hierarchy)):
                    rows.append((repo, path, lang, p.kind, p.content, p.start, p.end, p.function, p.cls, k, p.parent))
            cols = list(zip(*rows)) if rows else [[]] * 11
            types = [pa.string()] * 5 + [pa.int32()] * 2 + [pa.string()] * 2 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [x.split()[0] for x in _FIELDS.split(", ")])
    return files.select("repo_path", "file_path", "language", "content").mapInArrow(run, _FIELDS)


def split_texts(files: DataFrame, max_bytes: int) -> DataFrame:
    """Pieces of at most max_bytes of files(file_path, content): file_path, start_line, end_line, content."""
    def run(batches):
        for b in batches:
            rows = [(path, *p) for path, content in zip(*(c.to_pylist() for c in b.columns)) for p in split_large((content or "").split("\n"), 1, max_bytes)]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.string()))], ["file_path", "start_line", "end_line", "content"])
    return files.select(F.col("file_path"), "content").mapInArrow(run, "file_path string, start_line int, end_line int, content string")
