"""Transcripts and shell commands."""
import json
import time

import pytest
from pyspark.sql import functions as F

from quarry.functions.shell import command_kind, command_kinds, simple_commands
from quarry.operators.reports import usage_report
from quarry.sources import transcripts

READS = [
    "less engine/irq.asm", "head -n 12 engine/irq.asm", "gawk '{ print $2 }' tables/sine.inc", "cd engine && cat irq.S", "env LC_ALL=C nl irq.s", "timeout 5 xxd rom/boot.s", "DEPTH=3 tail -c 400 rom/boot.s | sort", "git -C demo show main:rom/boot.s",
    "for part in rom/*.s; do nl $part; done", "src=engine/irq.asm; head $src", "bat engine/{irq,nmi}.asm", "find rom -iname '*.inc' -exec less {} +", "find . -name '*.s' | xargs -n 1 cat", "ls rom/*.s | xargs head", 'wc -l <<< "$(strings rom/boot.s)"',
    'printf "%s" "$(cat "rom/boot.s")"', "n=`od -c rom/boot.s`", "cat <<'END' > todo.txt\nsomething\nEND\nmore rom/boot.s", "{ cat rom/boot.s; }", "sed -ne '3,9p' rom/boot.s", "hexdump < rom/boot.s -C rom/boot.s",
]
GREPS = [
    "fgrep -c sprite engine/irq.asm", "rg --glob '*.inc' palette", "egrep -e sprite -- engine/irq.asm", "grep -R --include '*.asm' sprite engine", "git grep -n sprite -- rom/boot.s", "ack sprite rom/boot.s; cat rom/boot.s", "find . -name '*.mac' | xargs grep -l sprite",
    "find rom -name '*.s' -exec grep -H sprite {} \\;", "while read x; do grep $x rom/boot.s; done", 'echo "hits: $(grep -c sprite rom/boot.s)"', "rg -tasm sprite",
]
NEITHER = [
    "sed -ni.old '/x/p' rom/boot.s", "sed -r --in-place=.o 's/x/y/' rom/boot.s", "ld65 rom/boot.s", "mv rom/boot.s rom/init.s", "ls rom/*.s", "head notes.txt > rom/boot.s", "echo 'less rom/boot.s'", "cat <<X >> plan.md\ncat rom/boot.s\nX", "rg sprite README",
    "grep rom/boot.s Makefile", "cat rom/boot.sh", "less ./.s", "cat boot.s~", "", "cat \"rom/boot", "# less rom/boot.s", "find . -name '*.c' -exec cat {} +", "find . -name '*.c' | xargs grep x", "for f in *.c; do cat $f; done", "cat $unknown", "git log -p rom/boot.s", "make |& grep boot.s",
    "awk 'END { print NR }' > rom/sine.inc", "grep -R --include '*.c' sprite rom", "cat a#b.c # rom/boot.s",
]


@pytest.mark.parametrize("command, kind", [(c, k) for cs, k in ((READS, "read"), (GREPS, "grep"), (NEITHER, None)) for c in cs])
def test_command_kinds(command, kind):
    assert command_kind(command) == kind


def test_folders_that_hold_assembly():
    has = {".", "rom", "rom/lib"}.__contains__
    for command, kind in (
        ("grep -rn sprite rom", "grep"), ("grep -rn sprite art", None), ("cd rom && rg sprite", "grep"), ("cd art && rg sprite", None), ("rg sprite", "grep"), ("make | grep sprite", None), ("find art -name '*.s' | xargs cat", None),
        ("find rom -type f -exec head {} +", "read"), ("ls rom/lib | xargs cat", "read"), ("cd $somewhere; rg sprite", None),
    ):
        assert command_kind(command, has) == kind, command


def test_long_commands_are_linear():
    for text in ("cat <<EOF\n" + "x; cat a.s\n" * 10_000, "((((" * 25_000, "a|" * 50_000, "'" * 100_001, "cat <<A <<B\n" * 8_000, '"$(' * 30_000, "cat " + "{a,b}" * 20_000 + ".s", "x" * 100_000, "a'b'" * 25_000):
        took = []
        for _ in range(3):
            began = time.perf_counter()
            command_kind(text)
            took.append(time.perf_counter() - began)
        assert min(took) < 0.25, text[:10]
    assert simple_commands("a 'b;c' | d >e 2>&1; f") == [(["a", "b;c"], ""), (["d"], "|"), (["f"], ";")]


def test_commands_as_a_column(spark):
    got = command_kinds(spark.createDataFrame([("cat a.s",), (None,), ("ls",)], "command string")).collect()
    assert [r["kind"] for r in got] == ["read", None, None]


def test_usage_report(spark, tmp_path):
    def call(name, **given):
        return {"type": "tool_use", "name": name, "input": given}

    def line(at, *blocks, cwd="/work/game/"):
        return json.dumps({"timestamp": at, **({"cwd": cwd} if cwd else {}), "message": {"content": list(blocks)}})

    (tmp_path / "old-game").mkdir()
    (tmp_path / "old-game" / "a.jsonl").write_text("\n".join([
        line("2024-01-01T00:00:00Z", call("mcp__serena__find_symbol", query="x"), call("Read", file_path="src/A.S"), {"type": "text", "text": "hello"}),
        line("2024-01-02T00:00:00+00:00", call("Bash", command=" cat src/a.s"), call("Bash", command="make a.s"), call("Edit", file_path="readme.md")),
        line("2024-01-03T00:00:00Z", call("Read", file_path="late.s")),
        "not json", json.dumps({"message": {"content": "plain"}}), json.dumps({"timestamp": "2024-01-01T01:00:00Z", "message": {"content": "plain"}}),
        line("2024-01-01T02:00:00Z", call("Grep", pattern="x", glob="*.inc"), cwd=None),
    ]))
    calls = transcripts.tool_calls(spark, str(tmp_path))
    at = lambda x: F.to_timestamp(F.lit(x))
    report = usage_report(calls, "project", transcripts.bucket("tool", "input"), "session", at("2024-01-01"), at("2024-01-02"), "at", transcripts.BUCKETS)
    got = {(r["project"], r["is_total"]): (r["symbolic"], r["native_read"], r["shell_read"], r["native_edit"], r["sessions"]) for r in report.collect()}
    assert got == {("game", 0): (1, 1, 1, 0, 1), ("old-game", 0): (0, 1, 0, 0, 1), (None, 1): (1, 2, 1, 0, 1)}
    shown = transcripts.markdown(report)
    assert "| game | 1 | 0 | 1 | 0 | 1 | 1 | 33.3 % |" in shown and shown.splitlines()[-1].startswith("| total | 1 |")
    scope = spark.createDataFrame([("old-game",)], "project string")
    assert usage_report(calls, "project", transcripts.bucket("tool", "input"), "session", at("2024-01-01"), at("2024-01-02"), "at", transcripts.BUCKETS, scope).where("is_total = 1").first()["native_read"] == 1
