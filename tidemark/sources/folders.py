"""Folders as tables, repositories among them, and TOML settings."""

from __future__ import annotations

import os
import subprocess
import tomllib
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path array<string>, size long, modified timestamp"
REPOS = "path array<string>, bare boolean, branch string, last_commit timestamp, branches long, tags long, remotes long, changes long"


def files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """All files below a folder, listed by Spark."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    clean = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    return rows.select(F.split(F.substring(clean, len(os.path.abspath(root)) + 2, 1 << 20), "/").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def walk(root: str, state, visit: Callable) -> object:
    """Calls visit(state, folder, entry), first for a folder's entries and then in its subfolders; visit returns (state, go in)."""
    entries = sorted(os.scandir(root), key=lambda e: e.name)
    into = []
    for e in entries:
        state, deeper = visit(state, root, e)
        if deeper and e.is_dir(follow_symlinks=False):
            into.append(e.path)
    for path in into:
        state = walk(path, state, visit)
    return state


def _git(path: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", path, *args], capture_output=True, text=True, timeout=60)
    return done.stdout.strip() if done.returncode == 0 else ""


def repositories(spark: SparkSession, roots: Iterable[str]) -> DataFrame:
    """State of the repositories below the first of the folders that exists; each is asked by a task."""
    root = next((r for r in roots if os.path.isdir(r)), None)
    found: list[tuple[str]] = []

    def visit(state, folder, entry):
        if entry.name == ".git" or not entry.is_dir(follow_symlinks=False):
            return state, False
        if os.path.exists(os.path.join(entry.path, ".git")) or os.path.isfile(os.path.join(entry.path, "HEAD")) and os.path.isdir(os.path.join(entry.path, "objects")):
            state.append((entry.path,))
        return state, True

    if root:
        found = walk(root, [], visit)

    def ask(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for p in b["path"]:
                at = _git(p, "log", "-1", "--format=%ct")
                count = lambda *a: len([x for x in _git(p, *a).split("\n") if x])  # noqa: E731, B023
                rows.append((os.path.relpath(p, root).split("/"), _git(p, "rev-parse", "--is-bare-repository") == "true", _git(p, "rev-parse", "--abbrev-ref", "HEAD"), pd.Timestamp(int(at), unit="s") if at else pd.NaT, count("branch", "--format=x"), count("tag"), count("remote"), count("status", "--porcelain")))
            yield pd.DataFrame(rows, columns=["path", "bare", "branch", "last_commit", "branches", "tags", "remotes", "changes"])

    return spark.createDataFrame(found, "path string").mapInPandas(ask, REPOS).orderBy(F.desc("last_commit"))


def find_config(names: Iterable[str], folders: Iterable[str]) -> str | None:
    return next((p for f in folders for n in names if os.path.isfile(p := os.path.join(os.path.expanduser(f), n))), None)


def load_toml(path: str) -> dict:
    with open(path, "rb") as f:
        return tomllib.load(f)


def canonical(path: str) -> str:
    return os.path.realpath(os.path.expanduser(path))
