"""Exact token ids of whole texts: every distinct segment is encoded once by the tokenizers library, texts are assembled from them.

Texts are cut only where the tokenizer itself always splits, so the ids equal those of the whole text. A null text counts as
empty and has no ids. Equal texts get equal ids; the tokenizer's special strings in a text are ordinary text.
"""

from __future__ import annotations

import functools

import numpy as np

from .segments import Vocabulary, bpe_segments, unicode_blanks, word_ranges


class Coder:
    """``kind``: "byte" for byte-level BPE with the GPT-2 pattern, "word" for BPE on lower-cased words whose white space is dropped."""

    #: Stands between segments that are encoded in one call; segments that hold it are encoded alone.
    SEPARATOR = {"byte": "\n", "word": " \x01 "}

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.kind, self.vocabulary = kind, Vocabulary()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.mark = self.tokenizer.encode(self.SEPARATOR[kind], add_special_tokens=False).ids
        self.width = self.tokenizer.get_vocab_size()

    def _alone(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def encode(self, raw: list[bytes], step: int = 512) -> list[np.ndarray]:
        words = [x.decode() for x in raw]
        odd = self.SEPARATOR[self.kind].strip(" ")
        out: list[np.ndarray] = [None] * len(words)
        joined = [i for i, w in enumerate(words) if odd not in w and not w.isspace()] if len(self.mark) == 1 else []
        for at in range(0, len(joined), step):
            part = joined[at : at + step]
            ids = np.array(self.tokenizer.encode(self.SEPARATOR[self.kind].join(words[i] for i in part), add_special_tokens=False).ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark[0])
            if len(cuts) == len(part) - 1:
                for i, x in zip(part, np.split(ids, cuts), strict=True):
                    out[i] = x[1:] if i != part[0] else x
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self._alone([words[i] for i in rest]), strict=True):
            out[i] = x
        return out

    def __call__(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets into them by document) of the texts in a buffer, ``end`` after each."""
        if self.kind == "byte":
            starts, ends, first = bpe_segments(data, offsets)
        else:
            starts, ends, first = segments_between(data, offsets)
        entries = self.vocabulary.entries(data, starts, ends, self.encode)
        per = np.append(0, np.cumsum(self.vocabulary.length[entries]))[first]
        ids = self.vocabulary.ids(entries)
        docs = len(offsets) - 1
        out = np.insert(ids, per[1:], np.uint32(end)) if docs else ids
        return out.astype(np.uint32), per + np.arange(docs + 1)


def segments_between(data: np.ndarray, offsets: np.ndarray):
    """Ranges of characters that are no Unicode white space."""
    marks = unicode_blanks(data) if len(data) else np.zeros(0, bool)
    return word_ranges(marks.view(np.uint8), offsets, np.array([False, True] + [False] * 254))


@functools.cache
def coder(path: str, kind: str) -> Coder:
    """One per Python worker and file, with what it has learned."""
    return Coder(path, kind)
