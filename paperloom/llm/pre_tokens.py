"""A tokenizer's pre-tokens and their ids, a word at a time.

A word is a run of bytes other than ASCII white space. The tokenizer must drop white space and never join
across it, which :class:`PreTokens` checks; a text's ids are then those of its words end to end, and a word's
those of its pre-tokens. Pre-tokens come from the library's own normaliser and pre-tokenizer. Where these are
the ones stated below, words of printable ASCII and Latin letters are split here by the same rule, which
needs no Unicode tables for them. Words that hold a special token's string go through the library whole.
"""

from __future__ import annotations

import json
import re

#: The normaliser and pre-tokenizer that ``PLAIN`` and ``SPLIT`` agree with on plain words.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: The byte-level alphabet: printable bytes stand for themselves, the others, in order, for code points from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + n) for n, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
_LETTERS = {c: "".join(BYTE_LETTERS[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}

_TOKENIZERS: dict = {}


def load(path: str):
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


class PreTokens:
    """Splits words and gives pre-tokens' ids."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        if self.whole(b" \n") or self.whole(b"ab cd\n!") != self.whole(b"ab") + self.whole(b"cd") + self.whole(b"!"):
            raise ValueError("a tokenizer that keeps white space can't be counted a word at a time")
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.fast = (spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS and [x.get("type") for x in steps] == ["Split", "ByteLevel"] and steps[0].get("pattern") == {"Regex": PATTERN} and steps[0].get("invert") and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]

    def whole(self, word: bytes) -> list[int]:
        """The ids of a word through the library."""
        return self.tokenizer.encode(word.decode(), add_special_tokens=False).ids

    def split(self, word: bytes) -> list[str] | None:
        """The word's pre-tokens; None if it holds a special token's string."""
        for special in self.special:
            if special in word:
                return None
        text = word.decode()
        if self.fast and PLAIN.fullmatch(text):
            found = SPLIT.findall(text.lower())
            return found if text.isascii() else [x.translate(_LETTERS) for x in found]
        steps = self.tokenizer
        text = steps.normalizer.normalize_str(text) if steps.normalizer else text
        return [x for x, _ in steps.pre_tokenizer.pre_tokenize_str(text)] if steps.pre_tokenizer else [text]

    def ids(self, pre_token: str) -> list[int]:
        """The ids of a pre-token by the library's model."""
        return [x.id for x in self.tokenizer.model.tokenize(pre_token)]

    def count(self, pre_token: str) -> int:
        return len(self.tokenizer.model.tokenize(pre_token))
