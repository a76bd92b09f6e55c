"""A Python data source that walks a folder: spark.read.format("repo_files").load(path).

Unlike the binary file reader it also lists names that begin with a dot or an
underscore. Hidden folders and ignored ones are pruned while walking, symbolic links to
folders aren't followed, and a file is read only if its language is supported and its
size within the limit. The driver lists names and sizes; files are dealt to partitions of a bounded
number of files and bytes, so that one large folder is many tasks.
"""

from __future__ import annotations

import os
import re

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import IGNORE, LANGUAGES, glob_regex

SCHEMA = "repo_path string, file_path string, rel_path string, name string, language string, size long, mtime double, disposition string, error string, content binary"


def is_ignored(rel: str, patterns=IGNORE) -> bool:
    """The rules of functions.paths.ignored for one path, for use while walking."""
    parts = rel.split("/")
    for p in patterns:
        if "**" in p:
            pieces = p.split("**")
            first = pieces[0].removesuffix("/")
            if first and (rel == first or rel.startswith(first + "/")):
                return True
            for q in (x.strip("/") for x in pieces if x not in ("", "/")):
                if f"/{q}/" in rel or rel.startswith(f"{q}/") or rel.endswith(f"/{q}"):
                    return True
        r = re.compile(glob_regex(p))
        if r.search(rel) or r.search(parts[-1]) or p.removesuffix("/**") in parts[:-1]:
            return True
    return False


#: Most files and, but for a single larger file, bytes of a partition.
PART_FILES, PART_BYTES = 2000, 32 << 20


class _Files(InputPartition):
    def __init__(self, paths: list[str], errors: list[tuple[str, str]]):
        super().__init__(None)
        self.paths, self.errors = paths, errors


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        self.limit = int(float(options.get("maxfilesizemb", 1)) * (1 << 20))
        self.patterns = tuple(x for x in options["ignore"].split("\n") if x) if "ignore" in options else IGNORE
        if not os.path.exists(self.root):
            raise FileNotFoundError(f"no such folder: {self.root}")
        if not os.path.isdir(self.root):
            raise NotADirectoryError(f"not a folder: {self.root}")

    def partitions(self):
        name = os.path.basename(self.root)
        errors: list[tuple[str, str]] = []
        out, own, size = [], [], 0
        if not name.startswith(".") or name == ".":  # a hidden root hides everything
            for path, n in self._walk(errors):
                n = min(n, self.limit)
                if own and (len(own) >= PART_FILES or size + n > PART_BYTES):
                    out.append(_Files(own, []))
                    own, size = [], 0
                own.append(path)
                size += n
        return [*out, _Files(own, errors)]

    def read(self, partition):
        for path in partition.paths:
            yield self._row(path)
        for folder, e in partition.errors:
            yield (self.root, folder, os.path.relpath(folder, self.root).replace(os.sep, "/"), os.path.basename(folder), None, None, None, "error", e, None)

    def _walk(self, errors: list):
        """(path, size) of every file of folders that aren't pruned."""
        folders = [self.root]
        while folders:
            folder = folders.pop()
            try:
                entries = sorted(os.scandir(folder), key=lambda e: e.name, reverse=True)
            except OSError as e:
                errors.append((folder, str(e)))
                continue
            for e in reversed(entries):
                if e.is_dir(follow_symlinks=False):
                    rel = os.path.relpath(e.path, self.root).replace(os.sep, "/")
                    if not e.name.startswith(".") and not is_ignored(rel, self.patterns):
                        folders.append(e.path)
                    continue
                try:
                    n = e.stat().st_size
                except OSError:
                    n = 0
                yield e.path, n

    def _row(self, path: str):
        rel = os.path.relpath(path, self.root).replace(os.sep, "/")
        name = os.path.basename(path)
        lang = LANGUAGES.get(os.path.splitext(name)[1].lower() if not name.startswith(".") or "." in name[1:] else name.lower())
        size = mtime = content = error = None
        if is_ignored(rel, self.patterns):
            kind = "ignored"
        elif lang is None:
            kind = "unsupported"
        else:
            try:
                st = os.stat(path)
                size, mtime = st.st_size, st.st_mtime
                kind = "kept" if size <= self.limit else "too_large"
                if kind == "kept":
                    with open(path, "rb") as f:
                        content = f.read()
            except OSError as e:
                kind, error = "error", str(e)
        return (self.root, path, rel, name, lang, size, mtime, kind, error, content)


class RepoFiles(DataSource):
    """Options: path, maxFileSizeMb (1), ignore (patterns by line)."""

    @classmethod
    def name(cls) -> str:
        return "repo_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_repo(spark, path: str, max_file_size_mb: float = 1, patterns=None):
    """Every visited file of a folder with its disposition; kept ones with content."""
    spark.dataSource.register(RepoFiles)
    r = spark.read.format("repo_files").option("maxFileSizeMb", str(max_file_size_mb))
    if patterns is not None:
        r = r.option("ignore", "\n".join(patterns))
    return r.load(path)

