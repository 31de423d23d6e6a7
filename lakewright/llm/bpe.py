"""Pre-tokens of byte-level BPE files, shared by token counting and packing.

The tokenizer file's content travels to the executors as one broadcast (it has
a fixed size), so that only the driver needs its path.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import regex

#: The byte-level pre-token pattern of the public tokenizer files, in two spellings.
FULL = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters outside those for which both spellings agree.
UNSURE = re.compile("[^\x00-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧€]")
#: A cut before a blank between two other characters changes no pre-token.
CUT = re.compile(r"[^\s\x1c-\x1f](?= [^\s\x1c-\x1f])")
PART_CHARS = 1 << 18


def parts(text: str, most: int = PART_CHARS) -> Iterator[str]:
    at = 0
    while len(text) - at > most and (m := CUT.search(text, at + most)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


def pre_tokens(text: str) -> list[str]:
    return (FULL if UNSURE.search(text) else PLAIN).findall(text)


@lru_cache(1)
def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: bytes
    that are printable stand for themselves, the others take the characters
    from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """What counting and encoding need of a byte-level BPE file."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if model.get("type") != "BPE" or not plain or spec.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE files without a normalizer are supported")
        self.ids: dict[str, int] = model["vocab"]
        self.merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        added = spec.get("added_tokens") or []
        if any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in added):
            raise ValueError("added tokens that take up white space or whole words are not supported")
        self.special = {a["content"]: a["id"] for a in added}
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if added else None

    def sections(self, text: str) -> Iterator[tuple[str, int]]:
        """Runs of ordinary text, each with the id of the added token that
        ends it (-1 for the last)."""
        at = 0
        for m in self.split.finditer(text) if self.split else ():
            yield text[at : m.start()], self.special[m[0]]
            at = m.end()
        yield text[at:], -1
