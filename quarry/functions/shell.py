"""Classification of shell commands: does one read or search assembly files?

A command line is cut into simple commands outside quotes and here-documents; those inside `$( )` and backticks count as well. A
reader or searcher counts if an operand names an assembly file, unless it takes its input from a pipe, writes in place, or the
name is only the target of a redirection. Operands may come from a `for` list, an assignment, braces, `find -exec`, or, through
xargs, from a find or listing before the pipe. A folder counts only by what the caller knows of it (`has_assembly`).
"""
from __future__ import annotations

import posixpath
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Commands of each sort and the options of them that take an argument.
READERS = frozenset("cat head tail less more bat sed awk gawk nl od xxd hexdump strings".split())
SEARCHERS = frozenset("grep egrep fgrep rg ag ack".split())
RECURSIVE = frozenset("rg ag ack git-grep".split())
ASSEMBLY = (".s", ".inc", ".asm", ".mac")
WITH_ARGUMENT = {"head": "nc", "tail": "nc", "sed": "ef", "awk": "fFv", "gawk": "fFv", "grep": "efABCmdD", "egrep": "efABCm", "fgrep": "efABCm", "rg": "efABCmgtT", "bat": "lr", "git-grep": "efABCm"}
LONG_WITH_ARGUMENT = frozenset("--include --exclude --exclude-dir --glob --regexp --file --type --lines --bytes --context --after-context --before-context --max-count --expression".split())
#: Commands before a command: their options that take an argument, and how many operands of their own come first.
WRAPPERS = {"sudo": ("ugh", 0), "env": ("uC", 0), "nice": ("n", 0), "time": ("", 0), "command": ("", 0), "nohup": ("", 0), "xargs": ("nIPLsdaE", 0), "timeout": ("ks", 1), "stdbuf": ("ioe", 0), "exec": ("a", 0)}
KEYWORDS = frozenset("if then elif else fi do done while until case esac in ! { }".split())
#: Text beyond this many characters (here-documents left out) is not looked at; nor are substitutions nested deeper, or more spellings of an operand.
MOST, DEEPEST, SPELLINGS = 32_768, 4, 64

_HEREDOC = re.compile(r"<<-?\s*(?P<q>['\"]?)(?P<word>[A-Za-z_][\w.]*)(?P=q)")
_TOKEN = re.compile(
    r"""(?P<gap>[ \t]+)|(?P<single>'[^']*'?)|(?P<double>"(?:[^"\\$]|\\[\s\S]|\$\((?:[^()"]|"[^"]*")*\)|\$)*"?)|(?P<escape>\\[\s\S]?)|(?P<comment>\#[^\n]*)"""
    r"""|(?P<redirect>\d*(?:<<<|<<-?|<>|>>|>\||>&|<&|&>>?|[<>])-?)|(?P<operator>&&|\|\||\|&|;;|[;&|\n()`])|(?P<plain>[^\s'"\\#<>;&|()`]+|[\s\S])"""
)
_INNER = re.compile(r"""\$\(((?:[^()"]|"[^"]*")*)\)|`([^`]*)`""")
_VARIABLE = re.compile(r"\$(?:([A-Za-z_]\w*)|\{([A-Za-z_]\w*)\})")
_ASSIGNMENT = re.compile(r"([A-Za-z_]\w*)=(.*)", re.S)
_BRACES = re.compile(r"\{([^{}]*,[^{}]*)\}")


def without_heredocs(text: str) -> str:
    """The text without the bodies of here-documents, in one pass over its lines."""
    out, waiting = [], []
    for line in text.split("\n"):
        if waiting:
            if line.strip("\t ") == waiting[0]:
                waiting.pop(0)
            continue
        out.append(line)
        if "<<" in line:
            waiting = [m["word"] for m in _HEREDOC.finditer(line)]
    return "\n".join(out)


def simple_commands(text: str, inner: list[str] | None = None) -> list[tuple[list[str], str]]:
    """(words, operator before it) of each simple command. Words come without quotes; redirection targets are no words.

    Commands inside double quotes are added to `inner`; outside them, a substitution is cut like a group.
    """
    out: list[tuple[list[str], str]] = []
    words: list[str] = []
    word: list[str] | None = None
    before, skip, at = "", False, 0
    while at <= len(text):
        m = _TOKEN.match(text, at) if at < len(text) else None
        kind, part = (m.lastgroup, m[0]) if m else ("operator", "")
        at = m.end() if m else at + 1
        if kind == "comment" and word is not None:
            kind, at = "plain", at - len(part) + 1
            part = "#"
        if kind in ("single", "double", "escape", "plain"):
            if kind == "double" and inner is not None and ("$(" in part or "`" in part):
                inner += [a or b for a, b in _INNER.findall(part)]
            if kind in ("single", "double"):
                part = part[1:-1] if len(part) > 1 and part[-1] == part[0] else part[1:]
            elif kind == "escape":
                part = part[1:].replace("\n", "")
                if not part and word is None:
                    continue
            word = [*(word or []), part] if len(word or []) < 8 else [*word[:-1], word[-1] + part]
            continue
        if word is not None:
            if not skip:
                words.append("".join(word))
            word, skip = None, False
        if kind == "redirect":
            skip = "<" not in part or part.startswith("<<")
        elif kind == "operator":
            if words:
                out.append((words, before))
            words, skip = [], False
            before = "|" if part in ("|", "|&") else ";" if part else ""
    return out


def is_assembly(operand: str) -> bool:
    name = operand.rstrip("/").rsplit("/", 1)[-1].lower()
    return not name.startswith(".") and name.endswith(ASSEMBLY)


def _split_options(command: str, words: list[str]) -> tuple[list[str], list[str]]:
    """(options, operands); an option's separate argument comes after it as =argument."""
    options, operands, i, takes = [], [], 0, WITH_ARGUMENT.get(command, "")
    while i < len(words):
        w = words[i]
        if w == "--":
            return options, operands + words[i + 1 :]
        if w.startswith("-") and len(w) > 1:
            options.append(w)
            if w in LONG_WITH_ARGUMENT or not w.startswith("--") and w[-1] in takes and (len(w) == 2 or w[1:-1].isalpha()):
                i += 1
                options.append(f"={words[i]}" if i < len(words) else "")
        else:
            operands.append(w)
        i += 1
    return options, operands


class Shell:
    """Classifies commands one after the other and keeps what they set: variables and the folder."""

    def __init__(self, has_assembly: Callable[[str], bool] | None = None) -> None:
        self.has_assembly = has_assembly
        self.variables: dict[str, list[str]] = {}
        self.folder: str | None = ""

    # ---- operands

    def values(self, word: str) -> list[str]:
        """The word with what is known of its variables; a variable alone may stand for several words."""
        m = _VARIABLE.fullmatch(word)
        if m:
            return self.variables.get(m[1] or m[2], [word])
        return [_VARIABLE.sub(lambda m: (self.variables.get(m[1] or m[2]) or [m[0]])[0], word)]

    def spellings(self, word: str) -> list[str]:
        """What the word can stand for; nothing if a part of it isn't known."""
        open_, out = [v for v in self.values(word) if "$" not in v and "{}" not in v][:SPELLINGS], []
        while open_ and len(out) < SPELLINGS:
            w = open_.pop()
            m = _BRACES.search(w)
            if m:
                open_ += [w[: m.start()] + x + w[m.end() :] for x in m[1].split(",")][: SPELLINGS - len(out)]
                open_ = open_[-2 * SPELLINGS :]
            else:
                out.append(w)
        return out

    def names_assembly(self, words: list[str]) -> bool:
        return any(is_assembly(s) for w in words for s in self.spellings(w))

    def folder_with_assembly(self, words: list[str]) -> bool:
        if self.has_assembly is None or self.folder is None:
            return False
        return any(self.has_assembly(posixpath.normpath(posixpath.join(self.folder, s))) for w in words for s in self.spellings(w))

    def found(self, words: list[str]) -> bool:
        """Whether a find with these arguments lists assembly: by its name filters, or by its folders."""
        start = next((i for i, w in enumerate(words) if w.startswith(("-", "(", "!"))), len(words))
        roots, filters = words[:start] or ["."], []
        for name, value in zip(words[start:], words[start + 1 :]):
            if name in ("-exec", "-execdir", "-ok", "-okdir"):
                break
            if name in ("-name", "-iname", "-path", "-ipath", "-wholename", "-regex", "-iregex"):
                filters.append(value)
        if filters and not any(is_assembly(f) or f.lower().endswith(ASSEMBLY) and "*" in f for f in filters):
            return False
        return bool(filters) if self.has_assembly is None else self.folder_with_assembly(roots)

    def produced(self, words: list[str] | None) -> bool:
        """Whether the command before a pipe lists assembly."""
        if not words:
            return False
        if posixpath.basename(words[0]) == "find":
            return self.found(words[1:])
        operands = [w for w in words[1:] if not w.startswith("-")]
        return self.names_assembly(operands) or self.folder_with_assembly(operands)

    # ---- commands

    def kind(self, words: list[str], before: list[str] | None = None) -> str | None:
        """"read", "grep" or None for one simple command; before: the words of the command that is piped into it."""
        piped, listed = before is not None, False
        while words:
            w, name = words[0], posixpath.basename(words[0])
            if w == "for":
                if len(words) > 2 and words[2] == "in":
                    self.variables[words[1]] = [v for x in words[3:] for v in self.values(x)][: 4 * SPELLINGS]
                return None
            m = _ASSIGNMENT.fullmatch(w)
            if m:
                self.variables[m[1]] = self.values(m[2])
                words = words[1:]
            elif w in KEYWORDS:
                words = words[1:]
            elif name in WRAPPERS:
                if name == "xargs":
                    listed, piped = self.produced(before), False
                takes, own = WRAPPERS[name]
                words = words[1:]
                while words and words[0].startswith("-") and words[0] != "-":
                    words = words[2 if len(words[0]) == 2 and words[0][1] in takes else 1 :]
                words = words[own:]
            else:
                break
        if not words:
            return None
        command, arguments = posixpath.basename(words[0]).lower(), words[1:]
        if command in ("cd", "pushd"):
            to = next((a for a in arguments if not a.startswith("-") or a == "-"), "~")
            known = self.spellings(to) if to != "-" and not to.startswith("~") and not set(to) & set("*?[") else []
            self.folder = posixpath.normpath(posixpath.join(self.folder, known[0])) if len(known) == 1 and self.folder is not None else None
            return None
        if command == "git":
            return self.git(arguments, piped)
        if command == "find":
            sub = next((arguments[i + 1] for i, a in enumerate(arguments[:-1]) if a in ("-exec", "-execdir", "-ok", "-okdir")), "")
            sub = posixpath.basename(sub)
            kind = "grep" if sub in SEARCHERS else "read" if sub in READERS else None
            return kind if kind and self.found(arguments) else None
        if command in SEARCHERS:
            return "grep" if self.searches(command, arguments, piped, listed) else None
        if command in READERS:
            return "read" if self.reads(command, arguments, listed) else None
        return None

    def git(self, words: list[str], piped: bool) -> str | None:
        while words and words[0].startswith("-"):
            words = words[2 if words[0] in ("-C", "-c", "--git-dir", "--work-tree") else 1 :]
        if words[:1] == ["grep"]:
            return "grep" if self.searches("git-grep", words[1:], piped, False) else None
        if words[:1] == ["show"]:
            paths = [w.partition(":")[2] for w in words[1:] if not w.startswith("-")]
            return "read" if self.names_assembly([p for p in paths if p]) else None
        return None

    def searches(self, command: str, words: list[str], piped: bool, listed: bool) -> bool:
        options, operands = _split_options(command, words)
        given = any(o.startswith(("-e", "-f", "--regexp", "--file", "--expression")) for o in options)
        files = operands if given else operands[1:]
        if listed or self.names_assembly(files):
            return True
        if not (command in RECURSIVE or any(re.match(r"-[A-Za-z]*[rR]|--(dereference-)?recursive|--include", o) for o in options)):
            return False
        filters = []
        for o, after in zip(options, [*options[1:], ""]):
            if o in ("--include", "--glob", "-g", "-t", "--type"):
                filters.append(after[1:])
            elif o.startswith(("--include=", "--glob=", "--type=")):
                filters.append(o.split("=", 1)[1])
            elif command == "rg" and re.match(r"-[gt].", o):
                filters.append(o[2:])
        wanted = [f for f in filters if not f.startswith("!") and (f.lower().endswith(ASSEMBLY) or f.lower() in ("asm", "ca65"))]
        if filters and not wanted:
            return False
        if self.has_assembly is None:
            return bool(wanted) and not (piped and not files)
        return self.folder_with_assembly(files) if files else not piped and self.folder_with_assembly(["."])

    def reads(self, command: str, words: list[str], listed: bool) -> bool:
        options, operands = _split_options(command, words)
        if command == "sed" and any(o.startswith("--in-place") or re.match(r"-[A-Za-z]*i", o) for o in options):
            return False
        if command == "sed" and not any(o in ("-e", "-f", "--expression", "--file") or re.match(r"-[nErsuz]*[ef]", o) for o in options) or command in ("awk", "gawk") and "-f" not in options:
            operands = operands[1:]
        return listed or self.names_assembly(operands)


def command_kind(command: str, has_assembly: Callable[[str], bool] | None = None) -> str | None:
    """"grep" if any simple command searches assembly, else "read" if any reads it, else None.

    has_assembly says of a folder (relative to where the command starts) whether assembly lies in it or below; without it folders
    tell nothing and name filters decide alone.
    """
    shell, kinds = Shell(has_assembly), set()
    texts = [(without_heredocs(command)[:MOST], 0)]
    while texts:
        text, depth = texts.pop()
        inner: list[str] = []
        last: list[str] = []
        for words, operator in simple_commands(text, inner):
            kinds.add(shell.kind(words, last if operator == "|" else None))
            last = words
        if depth < DEEPEST:
            texts += [(x, depth + 1) for x in inner]
    return "grep" if "grep" in kinds else "read" if "read" in kinds else None


def command_kinds(rows: DataFrame, column: str = "command", out: str = "kind", folders: list[str] | None = None) -> DataFrame:
    """rows with the kind of each command, in Arrow batches; null stays null. folders: those of the project that hold assembly."""
    known = None if folders is None else {p for f in folders for p in _and_above(posixpath.normpath(f))}
    has = None if known is None else known.__contains__

    @F.pandas_udf("string")
    def kind(commands: pd.Series) -> pd.Series:
        return commands.map(lambda c: None if c is None else command_kind(c, has))

    return rows.withColumn(out, kind(F.col(column)))


def _and_above(folder: str) -> list[str]:
    out = ["."]
    while folder not in ("", ".", "/"):
        out.append(folder)
        folder = posixpath.dirname(folder)
    return out
