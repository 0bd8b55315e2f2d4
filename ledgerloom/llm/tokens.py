"""Token ids of whole texts, fast where words come again.

Both kinds of tokenizer cut a text at white space before anything else, so its ids are those of
its pieces one after the other. Each distinct piece is encoded once by the tokenizers library and
its ids are kept, as bytes, up to a bound of pieces.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has one task for each core already

#: White space of Unicode, as the tokenizers' own patterns know it.
_WHITE = r"\t-\r \x85\xa0  -     　"
_BYTE_PIECES = re.compile(rf" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")


_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: The pre-tokenizers' steps in texts of Latin-1, whose letters and numbers can be named; the word kind's once lower-cased.
_ALPHA, _NUMBER, _BLANK = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
_BYTE_STEPS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_ALPHA}]+| ?[{_NUMBER}]+| ?[^{_BLANK}{_ALPHA}{_NUMBER}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
_WORD_STEPS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_ALPHA}]+|[{_NUMBER}]|[^{_BLANK}{_ALPHA}{_NUMBER}]+")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where it prints, else the next free one from 256 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printed]
    return {**{b: chr(b) for b in printed}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Encoder:
    """Ids of texts by one tokenizer file, without special tokens added.

    The file says which pieces are safe: where its pre-tokenizer keeps white space (byte-level) a
    piece is a word with the one space before it, or white space; where it drops it, a word. A file
    of another kind has its texts encoded whole. Texts of Latin-1 are cut into the pre-tokenizer's own
    steps. Words of Latin letters go to the library's model directly, closing marks apart.
    """

    def __init__(self, path: str, most: int = 1_000_000, chunk: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.kind = np.dtype(self.code)
        # Characters encoded at a time; few enough that their pieces are not many more than are remembered.
        self.chunk = chunk or max(1 << 16, min(1 << 20, 2 * most))
        self.most, self.known, self.parts = most, {}, {}
        self.plain, self.fold, self.letters = re.compile(r"(?!)").match, False, _byte_letters()
        self.pieces = self._cutter()

    def _cutter(self):
        spec = json.loads(self.tokenizer.to_str())
        before, change = spec["pre_tokenizer"] or {}, spec["normalizer"] or {}
        steps = before.get("pretokenizers", [])
        first = steps[0] if steps else {}
        if before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not change:
            self.plain = re.compile(f"( ?[{_LETTERS}]+)([.,;:!?]*)").fullmatch
            cut, steps = _BYTE_PIECES.findall, _BYTE_STEPS.findall
        elif first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"] and r"[^\s\p{L}\p{N}]+" in first["pattern"].get("Regex", "") \
                and [s["type"] for s in change.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            self.plain, self.fold = re.compile(f"([{_LETTERS}]+)([.,;:!?]*)").fullmatch, True
            cut, steps = lambda text: text.replace("\n", " ").split(" "), lambda text: _WORD_STEPS.findall(text.lower())
        else:
            return lambda text: [text]
        special = [t["content"] for t in spec["added_tokens"]]
        apart = re.compile("(" + "|".join(map(re.escape, special)) + ")").split

        def pieces(text: str) -> list[str]:
            if any(s in text for s in special):  # its string ends what stands before it
                return [p for part in apart(text) for p in cut(part)]
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return cut(text)
            return steps(text)  # few different ones: words without marks

        return pieces

    def _ids(self, step: str) -> bytes:
        """Ids of what the pre-tokenizer takes as one step."""
        written = step.replace(" ", self.letters[32]) if step.isascii() else "".join(map(self.letters.__getitem__, step.encode()))
        return array(self.code, [t.id for t in self.model.tokenize(written)]).tobytes()

    def _part(self, step: str) -> bytes:
        found = self._ids(step)
        if len(self.parts) >= self.most:
            self.parts.clear()
        self.parts[step] = found
        return found

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known = {w: self.known[w] for w in words if w in self.known}
        odd, plain, parts, known, fold = [], self.plain, self.parts.get, self.known, self.fold
        for word in new:
            match = plain(word)
            if match:
                letters, marks = match.groups()
                if fold:
                    letters = letters.lower()
                if marks:
                    known[word] = (parts(letters) or self._part(letters)) + (parts(marks) or self._part(marks))
                else:
                    known[word] = self._ids(letters)
            else:
                odd.append(word)
        for word, found in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)):
            self.known[word] = array(self.code, found.ids).tobytes()

    def encode(self, texts: list[str]):
        """Ids of each text, in order."""
        i = 0
        while i < len(texts):
            size, j, cut = 0, i, []
            while j < len(texts) and (j == i or size + len(texts[j]) <= self.chunk):
                cut.append(self.pieces(texts[j]))
                size += len(texts[j])
                j += 1
            self._learn(set().union(*cut))
            for words in cut:
                yield np.frombuffer(b"".join(map(self.known.__getitem__, words)), self.kind)
            i = j


@lru_cache(maxsize=4)
def encoder(path: str, most: int = 1_000_000) -> Encoder:
    """One encoder for each file in a Python worker. most: how many pieces it remembers, some 400 bytes each."""
    return Encoder(path, most)
