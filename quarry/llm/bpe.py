"""Pre-tokens and merges of the public BPE files, with a shortcut that gives the library's own results.

A text is cut into words with the white space before them; no pre-token crosses such a cut. Words whose characters are all safe
are split here by the same pattern the library uses, with its character classes written out; every other word, and every text
that may hold a special string, goes to the library. A pre-token found here is looked up in a table: strings proven to encode
alone as one token come first, merges of other strings are made by the library once and remembered up to a bound.

Safe is a character that had its class in Unicode 3.2 and has it still, so that no version of a library's tables differs in it, and
that neither composes with others nor changes its lower case by what stands around it. That takes in the common scripts.
"""
from __future__ import annotations

import functools
import re
import struct
import sys
import unicodedata

#: White space of the Unicode White_Space property (not the separators 0x1C to 0x1F).
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Letters whose lower case depends on what follows or is several characters, and the parts that compose to syllables.
EXCEPT = {0x130, 0x3A3, *range(0x1100, 0x1200)}
#: Where the scripts begin that need the large character classes.
NEAR = 0x180
#: How many merged strings a worker remembers, and how many characters one may have for that.
REMEMBERED, LONGEST = 400_000, 64


@functools.cache
def safe_classes() -> dict[str, list[tuple[int, int]]]:
    """Ranges of safe characters by the first letter of their class: L, N, and o for others."""
    out: dict[str, list[tuple[int, int]]] = {"L": [], "N": [], "o": []}
    old = unicodedata.ucd_3_2_0
    for c in range(sys.maxunicode + 1):
        x = chr(c)
        now = unicodedata.category(x)
        if now[0] == "M" or now in ("Cn", "Cs", "Co") or now[0] != old.category(x)[0] or c in EXCEPT or len(x.lower()) > 1 or old.category(x.lower()) == "Cn":
            continue
        if unicodedata.normalize("NFC", x) != x or unicodedata.normalize("NFC", x.lower()) != x.lower() or unicodedata.combining(x):
            continue
        held = out[now[0] if now[0] in "LN" else "o"]
        if held and held[-1][1] == c - 1:
            held[-1] = (held[-1][0], c)
        else:
            held.append((c, c))
    return out


def _ranges(*kinds: str, below: int = sys.maxunicode + 1) -> str:
    return "".join(f"\\U{a:08x}-\\U{min(b, below - 1):08x}" for k in kinds for a, b in safe_classes()[k] if a < below)


def safe_pattern() -> re.Pattern:
    return re.compile(f"[^{_ranges('L', 'N', 'o')}]")


def byte_level_pattern(below: int = sys.maxunicode + 1) -> re.Pattern:
    """The byte-level split: contractions, then runs of letters, numbers or others with one space before, then spaces."""
    le, nu = _ranges("L", below=below), _ranges("N", below=below)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{le}]+| ?[{nu}]+| ?[^{SPACES}{le}{nu}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


def word_level_pattern(below: int = sys.maxunicode + 1) -> re.Pattern:
    """The split of the word-end vocabulary: contractions, letters, single numbers, others; white space goes."""
    le, nu = _ranges("L", below=below), _ranges("N", below=below)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{le}]+|[{nu}]|[^{SPACES}{le}{nu}]+")


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit integers, equal to the library's.

    json_text is the content of a tokenizers .json file of one of the two public kinds (byte-level, or word ends
    with lower case). whole_tokens() is the proven table. A null text counts as empty.
    """

    def __init__(self, json_text: str, remembered: int = REMEMBERED) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(json_text)
        self.library.no_truncation()
        self.library.no_padding()
        self.word_level = self.library.normalizer is not None
        pattern = word_level_pattern if self.word_level else byte_level_pattern
        # Small classes are searched faster; both patterns cut a text without far characters alike.
        self.near, self.every, self.far = pattern(NEAR).findall, pattern().findall, re.compile(f"[^\\0-{chr(NEAR - 1)}]").search
        self.unsafe = safe_pattern().search
        self.words = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+").findall
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.remembered = remembered
        self.whole = self.whole_tokens()
        self.ids = _Table(self, {s: struct.pack("<I", i) for s, i in self.whole.items()}, lambda ids: struct.pack(f"<{len(ids)}I", *ids))
        self.counts = _Table(self, dict.fromkeys(self.whole, 1), len)

    def whole_tokens(self) -> dict[str, int]:
        """Vocabulary strings that are one pre-token and that the library encodes alone as exactly their own id."""
        back = _unbytes()
        strings = {}
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            if self.word_level:
                if not token.endswith("</w>"):
                    continue
                token = token[:-4]
            try:
                s = bytes(back[c] for c in token).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
            if s and not self.unsafe(s) and self.find(s) == [s] and s not in self.specials:
                strings[s] = i
        names = list(strings)
        proven = {}
        for at in range(0, len(names), 4096):
            part = names[at : at + 4096]
            proven |= {s: strings[s] for s, e in zip(part, self.library.encode_batch(part, add_special_tokens=False)) if e.ids == [strings[s]]}
        return proven

    def find(self, text: str) -> list[str]:
        return self.every(text) if self.far(text) else self.near(text)

    def _parts(self, text: str):
        """The text's pre-tokens in order, as lists; a string among them is a stretch for the library."""
        if any(s in text for s in self.specials):
            yield text
        elif not self.unsafe(text):
            yield self.find(text.lower() if self.word_level else text)
        else:
            safe: list[str] = []
            for word in self.words(text):
                if self.unsafe(word):
                    if safe:
                        yield self.find("".join(safe).lower() if self.word_level else "".join(safe))
                        safe = []
                    yield word
                else:
                    safe.append(word)
            if safe:
                yield self.find("".join(safe).lower() if self.word_level else "".join(safe))

    def encode(self, text: str | None) -> bytes:
        out = []
        for part in self._parts(text) if text else ():
            if isinstance(part, str):
                ids = self.library.encode(part, add_special_tokens=False).ids
                out.append(struct.pack(f"<{len(ids)}I", *ids))
            else:
                out += map(self.ids.__getitem__, part)
        return b"".join(out)

    def count(self, text: str | None) -> int:
        n = 0
        for part in self._parts(text) if text else ():
            n += len(self.library.encode(part, add_special_tokens=False).ids) if isinstance(part, str) else sum(map(self.counts.__getitem__, part))
        return n


class _Table(dict):
    """From a pre-token to what is kept of its ids. The library merges an unknown one; so many are remembered and no more."""

    def __init__(self, encoder: Encoder, proven: dict, keep) -> None:
        super().__init__(proven)
        self.encode, self.keep, self.most = encoder.library.encode, keep, len(proven) + encoder.remembered

    def __missing__(self, piece: str):
        got = self.keep(self.encode(piece, add_special_tokens=False).ids)
        if len(self) < self.most and len(piece) <= LONGEST:
            self[piece] = got
        return got


def _unbytes() -> dict[str, int]:
    """From the printable stand-in of a byte back to the byte: printable Latin-1 stands for itself, the rest follows from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in shown}
    out |= {chr(0x100 + n): b for n, b in enumerate(b for b in range(256) if b not in set(shown))}
    return out
