"""Listing, settings, edits and messages."""
import subprocess

import pytest

from quarry.functions.editing import apply_edit, apply_edits, diagnostics
from quarry.sources.listing import enabled_languages, ignore_pattern, is_ignored, list_sources, listed_files


@pytest.mark.parametrize("patterns, path, ignored", [
    (["*.tmp"], "a/b.tmp", True), (["/gen"], "gen/a.s", True), (["/gen"], "x/gen/a.s", False), (["out/"], "x/out/a.s", True), (["out/"], "x/out", False), (["a/**/z.s"], "a/b/c/z.s", True), (["a/**/z.s"], "a/z.s", True),
    (["*.s", "!keep.s"], "keep.s", False), (["*.s", "!keep.s"], "x.s", True), (["d/", "!d/keep.s"], "d/keep.s", True), (["# note", "", "q?.s"], "q1.s", True), (["[ab].s"], "b.s", True), (["[!ab].s"], "b.s", False), (["foo"], "foobar.s", False),
])
def test_ignore_patterns(patterns, path, ignored):
    assert is_ignored(path, [p for p in map(ignore_pattern, patterns) if p]) is ignored


def test_sources(spark, tmp_path):
    for name in ("a.s", "B.ASM", "c.txt", "build/x.s", "sub/d.inc", "skip/e.s"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / ".gitignore").write_text("skip/\n")
    assert list_sources(str(tmp_path)) == ["B.ASM", "a.s", "sub/d.inc"]
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    subprocess.run(["git", "-C", str(tmp_path), "add", "a.s"], check=True)
    assert list_sources(str(tmp_path)) == ["B.ASM", "a.s", "sub/d.inc"]
    (tmp_path / "a.s").unlink()
    assert [r["uri"] for r in listed_files(spark, str(tmp_path)).orderBy("uri").collect()] == ["B.ASM", "sub/d.inc"]


def test_languages():
    assert enabled_languages("﻿languages: [a, 'B']  # x\nlanguage_servers:\n- ca65\n  - \"Py\" # no\nother: z\n- q\n") == {"ca65", "py"}
    assert enabled_languages("languages: ca65\n") == {"ca65"} and enabled_languages("") == set()


def test_edits(spark):
    assert apply_edit("ab\ncd", (0, 1), (1, 1), "X") == "aXd" and apply_edit("ab", (5, 0), (9, 9), "!") == "ab!" and apply_edit("ab\ncd", (0, 99), (0, 99), "!") == "ab\n!cd" and apply_edit("x", None, None, "new") == "new"
    files = spark.createDataFrame([("f", "one\ntwo"), ("g", "same")], "uri string, text string")
    edits = spark.createDataFrame([("f", 2, 0, 0, 0, 1, "T"), ("f", 1, 0, 0, 0, 3, "tri"), ("h", 1, None, None, None, None, "fresh")], "uri string, seq int, s_line int, s_char int, e_line int, e_char int, new_text string")
    assert {r["uri"]: r["text"] for r in apply_edits(files, edits).collect()} == {"f": "Tri\ntwo", "g": "same", "h": "fresh"}


def test_messages(spark):
    lines = spark.createDataFrame([("src/a.s(12): Error: Range error",), ("src/a.s:1: Warning: Unused",), ("note",)], "line string")
    assert sorted(tuple(r) for r in diagnostics(lines).collect()) == [("src/a.s", 0, "Warning", "Unused"), ("src/a.s", 11, "Error", "Range error")]
