"""Diffs and snapshots of a git repository. Git runs on the driver without a shell; what it prints is parsed per file on the executors."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..operators.diff import FILE_DIFFS

_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@.*")


class GitError(RuntimeError):
    """Git said no: an unknown revision, not a repository."""


def _git(cwd: str, *args: str) -> bytes:
    done = subprocess.run(["git", *args], cwd=cwd, capture_output=True)
    if done.returncode:
        raise GitError(done.stderr.decode("utf-8", "replace").strip())
    return done.stdout


def commit(ref: str, cwd: str = ".") -> str:
    """The commit of a revision; an error if there is none."""
    if ref.startswith("-"):
        raise GitError(f"not a revision: {ref}")
    return _git(cwd, "rev-parse", "--verify", "--quiet", "--end-of-options", f"{ref}^{{commit}}").decode().strip()


def merge_base(base: str, head: str, cwd: str = ".") -> str:
    return _git(cwd, "merge-base", commit(base, cwd), commit(head, cwd)).decode().strip()


def changed_files(base: str, head: str = "HEAD", paths: Iterable[str] = (), cwd: str = ".") -> tuple[str, str, list[tuple[str, str | None]]]:
    """Where the two parted, the head, and (path, its old path if it was renamed or copied) of all that changed, in git's order. No contents are read into memory."""
    old, new = merge_base(base, head, cwd), commit(head, cwd)
    fields = iter(_git(cwd, "diff", "--name-status", "--no-ext-diff", "-z", old, new, "--", *paths).decode("utf-8", "surrogateescape").split("\0"))
    found = []
    for status in fields:
        if status:
            first = next(fields)
            found.append((next(fields), first) if status[0] in "RC" else (first, None))
    return old, new, found


def diffs(spark: SparkSession, base: str, head: str = "HEAD", paths: Iterable[str] = (), cwd: str = ".") -> DataFrame:
    """``FILE_DIFFS`` from where the two parted to the head.

    The driver lists paths; executors have git make the diff of some files at a time, so ``cwd`` must be a repository, or a copy of it, that all of them see.
    """
    old, new, found = changed_files(base, head, paths, cwd)
    at = os.path.abspath(cwd)
    names = [(k, p.encode("utf-8", "surrogateescape"), q and q.encode("utf-8", "surrogateescape")) for k, (p, q) in enumerate(found)]
    rows = _spread(spark.createDataFrame(names, "file_ord long, path binary, old binary"), len(names))

    def parts(ask: list[bytes], *options: str) -> list[str]:
        spec = b"\0".join(b":(literal,top)" + a for a in ask)
        out = subprocess.run(
            ["git", "-c", "core.quotePath=false", "diff", "--no-color", "--no-ext-diff", *options, old, new, "--", *(os.fsdecode(x) for x in spec.split(b"\0"))], cwd=at, capture_output=True
        )
        if out.returncode:
            raise GitError(out.stderr.decode("utf-8", "replace").strip())
        return split_files(out.stdout.decode("utf-8", "replace"))

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            plain = frame[frame["old"].isna()].sort_values("path")
            for a in range(0, len(plain), 64):
                some = plain.iloc[a : a + 64]
                got = parts(list(some["path"]), "--no-renames")
                if len(got) != len(some):  # a file that became a link, say, has two parts
                    got = ["".join(parts([p], "--no-renames")) for p in some["path"]]
                yield _parsed(zip(some["file_ord"], got))
            for _, r in frame[frame["old"].notna()].iterrows():
                yield _parsed([(r["file_ord"], "".join(parts([r["old"], r["path"]], "-M", "-C", "-l0")))])

    return rows.mapInPandas(made, FILE_DIFFS)


def _spread(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, n of them, in tasks of a few each."""
    return rows.repartition(max(1, min(n, -(-n // 64) + rows.sparkSession.sparkContext.defaultParallelism - 1)), rows.columns[0])


def _parsed(parts: Iterable[tuple[int, str]]) -> pd.DataFrame:
    found = [{"file_ord": k, **parse_file(p)} for k, p in parts]
    return pd.DataFrame(found, columns=["file_ord", "type", "old_path", "new_path", "hunks"])


def split_files(text: str) -> list[str]:
    """The part of each file."""
    starts = [m.start() for m in re.finditer(r"^diff --git ", text, re.M)]
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]


def _unquote(name: str) -> str:
    name = name.split("\t")[0]
    if name.startswith('"') and name.endswith('"'):
        return name[1:-1].encode("latin-1", "backslashreplace").decode("unicode_escape").encode("latin-1", "replace").decode("utf-8", "replace")
    return name


def parse_file(part: str) -> dict:
    """One file of a diff, as in ``FILE_DIFFS`` without its number."""
    kind, old, new, hunks = "modify", None, None, []
    left = right = a = b = 0
    first, _, rest = part.partition("\n")
    m = re.match(r"diff --git (?:\"?a/(.*?)\"?) (?:\"?b/(.*?)\"?)$", first)
    if m:
        old, new = m[1], m[2]
    for line in rest.split("\n"):
        if left > 0 or right > 0:
            sign, content = line[:1], line[1:]
            if sign == "+":
                hunks[-1]["changes"].append({"type": "insert", "content": content, "line": b})
                b, right = b + 1, right - 1
            elif sign == "-":
                hunks[-1]["changes"].append({"type": "delete", "content": content, "line": a})
                a, left = a + 1, left - 1
            elif sign in (" ", ""):
                hunks[-1]["changes"].append({"type": "normal", "content": content, "line": b})
                a, b, left, right = a + 1, b + 1, left - 1, right - 1
            continue
        if m := _HUNK.match(line):
            a, b = int(m[1]), int(m[3])
            left, right = int(m[2] or 1), int(m[4] or 1)
            hunks.append({"header": line, "changes": []})
        elif line.startswith("new file"):
            kind = "add"
        elif line.startswith("deleted file"):
            kind = "delete"
        elif line.startswith("rename from "):
            kind, old = "rename", _unquote(line[12:])
        elif line.startswith("rename to "):
            new = _unquote(line[10:])
        elif line.startswith("copy from "):
            kind, old = "copy", _unquote(line[10:])
        elif line.startswith("copy to "):
            new = _unquote(line[8:])
        elif line.startswith("--- ") and not hunks:
            name = _unquote(line[4:])
            old = None if name == "/dev/null" else name[2:]
        elif line.startswith("+++ ") and not hunks:
            name = _unquote(line[4:])
            new = None if name == "/dev/null" else name[2:]
    return {"type": kind, "old_path": None if kind == "add" else old, "new_path": None if kind == "delete" else new, "hunks": hunks}


def parse_diffs(spark: SparkSession, text: str) -> DataFrame:
    """``FILE_DIFFS`` of the text of a diff that is at hand."""
    parts = [(k, p) for k, p in enumerate(split_files(text))]
    rows = spark.createDataFrame(parts, "file_ord long, part string")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield _parsed(zip(frame["file_ord"], frame["part"]))

    return rows.mapInPandas(parse, FILE_DIFFS)


def snapshots(spark: SparkSession, ref: str, paths: Iterable[str], cwd: str = ".") -> DataFrame:
    """(path, content) of files at a revision; files that aren't there have no row.

    Each task asks one git process for its files, so ``cwd`` must be a repository, or a copy of it, that all executors see.
    """
    names = [n for n in dict.fromkeys(paths) if "\n" not in n]
    at, revision = os.path.abspath(cwd), commit(ref, cwd)
    rows = _spread(spark.createDataFrame([(n,) for n in names], "path string"), len(names))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            with subprocess.Popen(["git", "cat-file", "--batch"], cwd=at, stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:
                for name in frame["path"]:
                    git.stdin.write(f"{revision}:{name}\n".encode())
                    git.stdin.flush()
                    head = git.stdout.readline().split(b" ")
                    if head[-1] == b"missing\n":
                        continue
                    if len(head) < 3:
                        raise GitError(f"git has no answer for {revision}:{name}")
                    body = git.stdout.read(int(head[-1]) + 1)[:-1]
                    if head[-2] == b"blob":
                        yield pd.DataFrame({"path": [name], "content": [body.decode("utf-8", "replace")]})
                git.stdin.close()

    return rows.mapInPandas(read, "path string, content string")


def working_tree(spark: SparkSession, paths: Iterable[str], cwd: str = ".") -> DataFrame:
    """(path, content) of files as they lie in ``cwd`` now, which all executors must see; files that aren't there have no row."""
    names, at = list(dict.fromkeys(paths)), os.path.abspath(cwd)
    rows = _spread(spark.createDataFrame([(n,) for n in names], "path string"), len(names))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name in (n for frame in frames for n in frame["path"]):
            try:
                with open(os.path.join(at, name), "rb") as source:
                    yield pd.DataFrame({"path": [name], "content": [source.read().decode("utf-8", "replace")]})
            except OSError:
                continue

    return rows.mapInPandas(read, "path string, content string")
