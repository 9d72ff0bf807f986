"""Which files belong to a project: version control's list or a walk, ignore patterns, and project settings. Runs on the driver."""
from __future__ import annotations

import os
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession

from quarry.sources.project import IGNORED

SUFFIXES = (".s", ".asm", ".inc")


def ignore_pattern(line: str) -> tuple[bool, re.Pattern] | None:
    """(ignores, pattern over paths with / between) of one line of an ignore file; a ! line takes back."""
    line = line.rstrip("\r\n")
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    ignores = not line.startswith("!")
    body = line.lstrip("!") if not ignores else line
    folder = body.endswith("/")
    body = body.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        if body[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif body[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and (end := body.find("]", i + 2)) > 0:
            out, i = out + "[" + body[i + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]", end + 1
        else:
            i += body[i] == "\\" and i + 1 < len(body)
            out, i = out + re.escape(body[i]), i + 1
    return ignores, re.compile(("" if anchored else "(?:.*/)?") + out + ("/" if folder else "(?:/|$)"))


def is_ignored(path: str, patterns: list) -> bool:
    """The last pattern that meets the path or a folder above it decides; what an ignored folder holds stays ignored."""
    parts = path.split("/")
    for n in range(1, len(parts) + 1):
        part, decided = "/".join(parts[:n]) + ("/" if n < len(parts) else ""), False
        for ignores, pattern in patterns:
            if pattern.fullmatch(part) or pattern.match(part) and pattern.match(part).end() == len(part):
                decided = ignores
        if decided:
            return True
    return False


def _from_git(root: str, seen: set[str], timeout: float) -> list[str] | None:
    real = os.path.realpath(root)
    if real in seen:
        return []
    seen.add(real)

    def ask(*words: str) -> list[str] | None:
        try:
            done = subprocess.run(["git", "-C", root, "ls-files", "-z", *words], capture_output=True, timeout=timeout, check=True)
        except (OSError, subprocess.SubprocessError):
            return None
        return [os.fsdecode(x) for x in done.stdout.split(b"\0") if x]

    names, staged = ask("-c", "-o", "--exclude-standard"), ask("-s")
    if names is None or staged is None:
        return None
    out = [n for n in names if os.path.isfile(os.path.join(root, n))]
    for entry in staged:
        mode, _, name = entry.partition("\t")
        if mode.startswith("160000") and os.path.exists(os.path.join(root, name, ".git")):
            out += [f"{name}/{n}" for n in _from_git(os.path.join(root, name), seen, timeout) or []]
    return out


def list_sources(root: str, suffixes: tuple = SUFFIXES, ignored: tuple = IGNORED, timeout: float = 30.0) -> list[str]:
    """Sorted relative paths of sources: by git with its submodules, else by a walk that keeps to the root's ignore file."""
    names = _from_git(root, set(), timeout)
    if names is None:
        patterns = []
        try:
            with open(os.path.join(root, ".gitignore"), encoding="utf-8", errors="replace") as f:
                patterns = [p for p in map(ignore_pattern, f) if p]
        except OSError:
            pass
        names = []
        for folder, folders, files in os.walk(root):
            here = os.path.relpath(folder, root).replace(os.sep, "/")
            here = "" if here == "." else here + "/"
            folders[:] = [d for d in folders if d not in ignored and not is_ignored(f"{here}{d}/x", patterns)]
            names += [n for n in (here + f for f in files) if not is_ignored(n, patterns)]
    return sorted(n for n in set(names) if n.lower().endswith(suffixes) and not set(n.split("/")[:-1]) & set(ignored))


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """uri, mtime_ns and size of the listed sources: the cheap half of a refresh."""
    rows = []
    for name in list_sources(root):
        try:
            s = os.stat(os.path.join(root, name))
        except OSError:
            continue
        rows.append((name, s.st_mtime_ns, s.st_size))
    return spark.createDataFrame(rows, "uri string, mtime_ns long, size long")


def enabled_languages(text: str) -> set[str]:
    """The list under language_servers of project settings, or else that under languages; block and flow lists, comments and a BOM."""
    lists: dict[str, set[str]] = {}
    key = None
    tidy = lambda v: v.strip().strip("\"'").strip().lower()
    for raw in text.removeprefix("﻿").splitlines():
        line = re.sub(r"(?:^|\s)#.*$", "", raw).rstrip()
        if not line:
            continue
        item = re.match(r"\s*-(.*)$", line)
        if item and key:
            lists[key].add(tidy(item[1]))
        elif (m := re.match(r"([\w-]+)\s*:\s*(.*)$", line)) is not None:
            key = m[1] if m[1] in ("languages", "language_servers") else None
            if key:
                values = m[2][1:-1].split(",") if m[2].startswith("[") and m[2].endswith("]") else [m[2]] if m[2] else []
                lists.setdefault(key, set()).update(map(tidy, values))
        elif not line[0].isspace():
            key = None
    return lists.get("language_servers", lists.get("languages", set()))


def project_of(folder: str, most: int = 64) -> str | None:
    """The nearest folder at or above this one, at most so many steps up, that holds .serena/project.yml."""
    folder = os.path.abspath(folder)
    for _ in range(most):
        if os.path.isfile(os.path.join(folder, ".serena", "project.yml")):
            return folder
        above = os.path.dirname(folder)
        if above == folder:
            return None
        folder = above
    return None
