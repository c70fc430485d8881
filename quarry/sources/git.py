"""Revisions of a git repository as rows. The files are listed and read where the driver runs; all else is a table."""

from __future__ import annotations

import subprocess
import sys
from collections.abc import Iterator, Sequence
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

SUFFIXES = ("py", "sql", "go")


def checked_name(value: str, most: int) -> str:
    """A symbol's or revision's name: not empty, in one line, no option, at most ``most`` characters."""
    if not value or not value.strip() or len(value) > most or value.startswith("-") or any(c in value for c in "\0\n\r"):
        raise ValueError(f"not a name: {value!r}")
    return value.strip()


def positive(value: int, name: str) -> int:
    if value < 1:
        raise ValueError(f"{name} must be positive")
    return value


def git(repo: str, *args: str) -> str:
    done = subprocess.run(["git", "-c", "core.quotepath=off", *args], cwd=repo, capture_output=True, check=False)
    if done.returncode:
        raise RuntimeError(done.stderr.decode(errors="replace").strip())
    return done.stdout.decode("utf-8", "surrogateescape")


def revision(repo: str, name: str) -> str:
    return git(repo, "rev-parse", "--verify", checked_name(name, 200) + "^{commit}").strip()


def files_at(spark: SparkSession, repo: str, name: str, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(revision, path, content) of the files of a revision; content is null where it is not UTF-8."""
    commit = revision(repo, name)

    def rows() -> Iterator[tuple]:
        for path in git(repo, "ls-tree", "-r", "-z", "--name-only", commit).split("\0"):
            if path.rpartition(".")[2].lower() in suffixes:
                raw = git(repo, "show", f"{commit}:{path}").encode("utf-8", "surrogateescape")
                try:
                    yield commit, path, raw.decode()
                except UnicodeDecodeError:
                    yield commit, path, None

    return spark.createDataFrame(list(rows()), "revision string, path string, content string")


def diff(spark: SparkSession, repo: str, base: str, head: str, suffixes: Sequence[str] = SUFFIXES, context: int = 3) -> DataFrame:
    """(diff_id, diff): the diff of two revisions; an empty one is an error."""
    text = git(repo, "diff", f"--unified={context}", revision(repo, base), revision(repo, head), "--", *[f"*.{s}" for s in suffixes])
    if not text.strip():
        raise ValueError("nothing differs")
    return spark.createDataFrame([(f"{base}..{head}", text)], "diff_id string, diff string")


def standard_input(spark: SparkSession, path: str, stream: TextIO | None = None) -> DataFrame:
    """(path, content) of what stands on standard input; blank input is an error."""
    text = (stream or sys.stdin).read()
    if not text.strip():
        raise ValueError("nothing on standard input")
    return spark.createDataFrame([(path, text)], "path string, content string")
