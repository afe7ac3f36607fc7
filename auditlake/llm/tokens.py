"""Token ids of whole texts with a public tokenizer file."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from auditlake.llm.common import kept_in_worker

END = 2
#: Words remembered by an encoder: in two halves, the older of which goes when the younger is full.
MEMORY = 1_600_000

#: Words over this length are forgotten after their batch, so that memory follows the number of words.
LONG = 256

_LETTER = r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]"
#: Letters, then punctuation, in lines: the tokenizer cuts between the three wherever they stand.
_STEM = re.compile(rf"({_LETTER}+)([!#$%&*,.:;?|]*)")
_LINES = re.compile(rf"{_STEM.pattern}(?:\n{_STEM.pattern})*")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(vocabulary: str | None = None) -> Encoder:
    """The encoder of this worker process: tasks after the first find its words."""
    vocabulary = vocabulary or default_vocabulary()
    return kept_in_worker(("encoder", vocabulary), lambda: Encoder(vocabulary))


class Encoder:
    """Encodes texts to bytes of little-endian unsigned 32-bit ids.

    The tokenizer cuts a text before each single space between two other characters, whatever stands around it, so a
    text is the concatenation of its words, each with the space before it. Distinct words go through the tokenizer
    once and are remembered; one of Latin letters alone is a single piece, which the tokenizer's model takes directly.
    A text with any other white space beside a space goes through the tokenizer whole.
    """

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        tokens = self.tokenizer.get_vocab(with_added_tokens=False)
        self.spaced = np.zeros(max(tokens.values()) + 1, bool)
        self.spaced[[i for t, i in tokens.items() if t.startswith("Ġ")]] = True  # how the file writes a space
        self.known: dict[str, bytes | bool] = {}
        self.older: dict[str, bytes | bool] = {}
        self.marks: dict[str, bytes] = {}
        self.starts: dict[str, bytes] = {}
        self.split = self.tokenizer.model.tokenize
        spelled = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = {c: spelled(chr(c))[0][0] for c in range(0xC0, 0x100)}  # of letters beyond ASCII in the file

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words, each with a space before it, from one text: a word starts at each id that starts with a space."""
        if not words:
            return []
        ids = self._ids([" " + " ".join(words)])[0]
        starts = np.flatnonzero(self.spaced[np.frombuffer(ids, "<u4")]) * 4
        if len(starts) != len(words):
            return self._ids([" " + w for w in words])
        at = [*starts.tolist(), len(ids)]
        return [ids[a:b] for a, b in zip(at, at[1:])]

    def _mark(self, text: str) -> bytes:
        if len(self.marks) > 10_000:
            self.marks.clear()
        if text not in self.marks:
            self.marks[text] = self._ids([text])[0]
        return self.marks[text]

    def _letters(self, word: str, before: str = "Ġ") -> bytes:
        """Ids of Latin letters, by default with a space before them."""
        spelled = word if word.isascii() else word.translate(self.spelling)
        return array("I", [t.id for t in self.split(before + spelled)]).tobytes()

    def _lines(self, word: str) -> bytes:
        """Ids of letters with punctuation, in lines; only the first line has a space before it."""
        known, starts, out = self.known, self.starts, []
        if len(starts) > MEMORY // 8:
            starts.clear()
        for stem, mark in _STEM.findall(word):
            if out:
                out.append(self._mark("\n"))
                ids = starts.get(stem) or self._letters(stem, "")
                where = starts
            else:
                ids = known.get(stem) or self.older.get(stem) or self._letters(stem)
                where = known
            if len(stem) <= LONG:
                where[stem] = ids
            out.append(ids)
            if mark:
                out.append(self._mark(mark))
        return b"".join(out)

    def _learn(self, new: set[str]) -> None:
        known, older = self.known, self.older
        fresh = []
        for word in new:
            if word in older:
                known[word] = older[word]
            elif word.isascii() and word.isalpha():
                known[word] = self._letters(word)
            elif _LINES.fullmatch(word):
                known[word] = self._lines(word)
            # An edge of white space would belong to a longer run: such a word is no unit.
            elif not word or word[0].isspace() or word[-1].isspace() or "᠎" in word:
                known[word] = False
            else:
                fresh.append(word)
        known.update(zip(fresh, self._words(fresh)))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > MEMORY // 2:
            self.known, self.older = {}, self.known
        split = [t.split(" ") for t in texts]
        heads = self._ids([w[0] for w in split])
        get = self.known.get
        found = [list(map(get, w)) for w in split]
        gaps = [[k for k, x in enumerate(f) if x is None] for f in found]
        new = {w[k] for w, g in zip(split, gaps) for k in g}
        self._learn(new)
        known, out = self.known, []
        for text, words, ids, gap, head in zip(texts, split, found, gaps, heads):
            for k in gap:
                ids[k] = known[words[k]]
            # The first word has no space before it.
            ids[0] = head if len(words) == 1 or words[0] and not words[0][-1].isspace() else False
            try:
                out.append(b"".join(ids))
            except TypeError:  # a word without ids of its own
                out.append(self._ids([text])[0])
        for word in new:
            if len(word) > LONG:
                known.pop(word, None)
        return out
