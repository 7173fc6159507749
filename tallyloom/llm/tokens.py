"""Token ids of whole texts through a public tokenizer file, with a bounded cache of blank-delimited chunks.

The tokenizer drops white space and never joins across it, so the ids of a
text are the ids of its chunks in order; a chunk is encoded once and then
looked up.  Chunks of letters are encoded many to a call and told apart by
the end-of-word ids; those of a-z alone need no normaliser.  A chunk of Latin
letters with one trailing comma or full stop is its letters plus that mark,
unless a letter's lower form ends in a combining mark.  Texts with "<|" may hold special tokens,
whose spelling is exact, and are encoded whole; so are all texts of a
tokenizer that minds white space.
"""

from __future__ import annotations

import struct

import numpy as np

_U32 = np.dtype("<u4")
_open: dict[str, ChunkEncoder] = {}
#: Letters below this one are known to the tokenizer's pattern as letters, also once composed and lowered.
_LATIN_END = "\u0250"


def encoder(path: str) -> ChunkEncoder:
    """One encoder a worker process, so that its cache serves all tasks there."""
    if path not in _open:
        _open[path] = ChunkEncoder(path)
    return _open[path]


def _is_latin(word: str) -> bool:
    """Whether a word is of Latin letters that stay letters in lower case."""
    return word.isalpha() and (word.isascii() or max(word) < _LATIN_END and word.lower().isalpha())


class ChunkEncoder:
    """encode_batch(texts) gives the ids of each as little-endian unsigned 32-bit bytes.

    The first ``limit`` chunks stay cached, as frequent words are met early;
    later ones last for a batch.
    """

    def __init__(self, path: str, limit: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.limit = limit
        self.cache: dict[bytes, bytes] = {}
        self.marks = {m: self._ids([m.decode()])[0] for m in (b",", b".")}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        one, two, both = self._ids(["The", "quick", " The \n quick "])
        self.by_chunks = both == one + two

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=_U32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words of a-z, by the model alone."""
        split = self.model.tokenize
        out = []
        for word in words:
            ids = [t.id for t in split(word)]
            out.append(struct.pack(f"<{len(ids)}I", *ids))
        return out

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words that are letters only, each one run up to an end-of-word id."""
        out: list[bytes] = []
        for i in range(0, len(words), 2000):
            own = words[i : i + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, dtype=_U32)
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) != len(own):  # a tokenizer without end-of-word ids
                out += self._ids(own)
                continue
            raw, at = ids.tobytes(), 0
            for stop in stops.tolist():
                out.append(raw[at:stop])
                at = stop
        return out

    def _learn(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks that are not in the cache, and of their stems."""
        cache = self.cache
        plain: dict[bytes, str] = {}
        letters: dict[bytes, str] = {}
        other: list[bytes] = []
        marked: list[bytes] = []
        for chunk in chunks:
            text = chunk.decode()
            if text.isalpha():
                (plain if text.isascii() else letters)[chunk] = text
            elif chunk[-1:] in self.marks and _is_latin(text[:-1]):
                marked.append(chunk)
                stem = chunk[:-1]
                if stem not in cache:
                    (plain if text.isascii() else letters)[stem] = text[:-1]
            else:
                other.append(chunk)
        new = dict(zip(plain, self._plain_ids(list(plain.values()))))
        new.update(zip(letters, self._word_ids(list(letters.values()))))
        new.update(zip(other, self._ids([c.decode() for c in other])))
        for chunk in marked:
            stem = chunk[:-1]
            new[chunk] = (new[stem] if stem in new else cache[stem]) + self.marks[chunk[-1:]]
        return new

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null gives no ids."""
        split: list[list[bytes] | None] = []
        for text in texts:
            raw = (text or "").encode()
            # Lowering A-Z first is what the tokenizer's own normaliser does, and shares cache entries.
            split.append(None if b"<|" in raw or not self.by_chunks else raw.lower().split())
        cache = self.cache
        new = self._learn(set().union(*[words for words in split if words]).difference(cache))
        cache.update(new)
        ids = cache.__getitem__
        out = [self._ids([text or ""])[0] if words is None else b"".join(map(ids, words)) for text, words in zip(texts, split)]
        if len(cache) > self.limit:
            for chunk in new:
                del cache[chunk]
        return out
