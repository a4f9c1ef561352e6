"""Ids of short stretches of text by the tokenizers library, without what it does around each call.

The library's encode() spends most of a short call on keeping track of places. Where the vocabulary's file asks for the two usual
forms of preparation and the stretch has Latin characters only, the stretch is prepared here (same normal form,
same pattern) and the library's own model merges each part; everything else goes through encode(). The ids are the same.
"""

from __future__ import annotations

import json
import re
from array import array

import regex
from tokenizers import Tokenizer

# The pattern of byte-level vocabularies, and the usual normal form of lower-case ones.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LOWER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]

#: What is prepared here: Latin letters and ASCII, without control characters.
_LAST = "ɏ"
_PLAIN = regex.compile(rf"[\t-\r\x20-\x7e\xa0-{_LAST}]*")
#: Marks that often follow a word; each is a part of its own behind letters.
_MARKS = frozenset(".,;:!?)")
#: Parts whose ids are remembered at most among the newest and among those before them, and the longest of them in characters.
REMEMBERED, LONGEST = 60_000, 32


def byte_characters() -> dict[int, str]:
    """The character of each byte in a byte-level vocabulary: printable ones stand for themselves, the others for 256 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Library:
    """A tokenizers vocabulary. With special=False the strings of special tokens are ordinary text."""

    def __init__(self, source: str, special: bool = True):
        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.encode_special_tokens = not special
        self.model = self.tokenizer.model
        self.merge = self.model.tokenize
        told = json.loads(source)
        self.marks = [t["content"] for t in told.get("added_tokens", [])] if special else []
        self.special = re.compile("|".join(map(re.escape, self.marks))) if self.marks else None
        self.pattern, self.lower = self._preparation(told)
        self.spaced = self.pattern is not None and self.pattern.pattern == BYTE_LEVEL  # a part may begin with a space
        self.table = byte_characters()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _preparation(told: dict):
        """The compiled pattern and whether texts are lower-cased; no pattern: encode() does everything."""
        normal, before = told.get("normalizer"), told.get("pre_tokenizer") or {}
        lower = normal is not None and normal.get("type") == "Sequence" and normal.get("normalizers") == LOWER
        if normal is not None and not lower:
            return None, False
        if told["model"].get("dropout") or any(t.get("normalized") or t.get("single_word") for t in told.get("added_tokens", [])):
            return None, False
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
            return regex.compile(BYTE_LEVEL), lower
        steps = before.get("pretokenizers", [])
        if len(steps) == 2 and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and "Regex" in steps[0].get("pattern", {}):
            if steps[1].get("type") == "ByteLevel" and not steps[1].get("use_regex") and not steps[1].get("add_prefix_space"):
                return regex.compile(steps[0]["pattern"]["Regex"]), lower
        return None, False

    def _part(self, part: str, mapped: str) -> bytes:
        got = array("I", [t.id for t in self.merge(mapped)]).tobytes()
        if len(part) <= LONGEST:
            self._remember(part, got)
        return got

    def _remember(self, part: str, ids: bytes) -> None:
        if len(self.known) >= REMEMBERED:
            self.known, self.older = {}, self.known
        self.known[part] = ids

    def _older(self, part: str) -> bytes | None:
        """The ids of a part that came before the newest ones; it is new again."""
        got = self.older.get(part)
        if got:
            self._remember(part, got)
        return got

    def _of(self, part: str) -> bytes:
        """The ids of one part, in normal form."""
        return self.known.get(part) or self._older(part) or self._part(part, part if part.isascii() and part.isalnum() else part.encode().decode("latin-1").translate(self.table))

    def ids(self, text: str) -> bytes:
        """The ids of a stretch as unsigned 32-bit numbers of this machine, one after another."""
        if self.pattern is not None:
            low = text.lower() if self.lower else text
            if low.isascii() and low.isalpha():  # most new words: one part, which stands for itself
                return self.known.get(low) or self._older(low) or self._part(low, low)
            body, mark = (low[:-1], low[-1]) if low[-1:] in _MARKS else (low, "")
            letters = body[1:] if self.spaced and body[:1] == " " else body
            if letters.isalpha() and (letters.isascii() or max(letters) <= _LAST):  # one part, and perhaps a mark
                return self._of(body) + self._of(mark) if mark else self._of(body)
            if _PLAIN.fullmatch(text) and not (self.special and self.special.search(text)):
                return b"".join(map(self._of, self.pattern.findall(low)))  # these characters are in normal form
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
