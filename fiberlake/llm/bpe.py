"""Token ids of whole texts with a public tokenizer, word by word.

The tokenizer of ``word_bpe_49k.json`` drops white space and merges within words only,
so a text's ids are those of its words. Each distinct word of a task is encoded once;
the rest is array work. Texts that may hold a special token's string go through the
tokenizer whole. A null text counts as empty and has no ids; an empty column has none.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa

from .bytescan import NOT_SPACE, row_bounds, utf8, words


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Marks that end a run of letters for certain, whatever follows.
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in '.,;:!?()"']] = True
_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True


#: First bytes of two-byte Latin letters, U+00C0 to U+024F: all letters but two signs. U+0130
#: does not count: its lower case ends in a combining mark, which joins what follows.
_LATIN = np.zeros(256, bool)
_LATIN[0xC3:0xCA] = True


def _cuts(buf: np.ndarray) -> np.ndarray:
    """Cuts between a letter for certain and a mark, in either order."""
    out = np.zeros(len(buf), bool)
    m, starts = _MARK[buf], _ASCII[buf]
    ends = starts.copy()
    if len(buf) > 1:
        a, b = buf[:-1], buf[1:]
        two = _LATIN[a] & ~((a == 0xC3) & ((b == 0x97) | (b == 0xB7))) & ~((a == 0xC4) & (b == 0xB0))
        starts[:-1] |= two
        ends[1:] |= two
    out[1:] = (m[1:] & ends[:-1]) | (starts[1:] & m[:-1])
    return out


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if visible."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    out = {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [out[b] for b in range(256)]


class WordEncoder:
    """Ids of many texts at once; keeps the ids of up to ``most`` distinct words.

    Words are known by sorted arrays of their hashes, at about 30 bytes each.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self._clear()

    def _word(self, text: str) -> list[int]:
        """Ids of a word: of Latin letters alone without the steps that only cut and clean."""
        low = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()
        if low.isalpha() and max(low) < "\u0250":
            if not low.isascii():
                low = "".join(self.letters[b] for b in low.encode())
            return [t.id for t in self.model.tokenize(low)]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _clear(self):
        self.known, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """Adds words that are not known yet."""
        got = [self._word(t) for t in texts]
        size = np.array([len(ids) for ids in got], np.int32)
        start = len(self.ids) + np.cumsum(size, dtype=np.int64) - size
        self.ids = np.concatenate([self.ids, np.array([i for ids in got for i in ids], np.uint32)])
        known = np.concatenate([self.known, keys])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.start, self.size = (np.concatenate([a, b.astype(np.int32)])[order] for a, b in ((self.start, start), (self.size, size)))

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the keys stand among the known ones, and whether they do."""
        at = np.searchsorted(self.known, keys)
        ok = at < len(self.known)
        ok[ok] = self.known[at[ok]] == keys[ok]
        return at, ok

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column, and the rows' bounds in them."""
        buf, offs = utf8(column)
        starts, ends, h = words(buf, offs, NOT_SPACE, breaks=_cuts)
        unique, first, which = np.unique(h, return_index=True, return_inverse=True)
        raw = buf.tobytes()
        new = np.flatnonzero(~self._find(unique)[1])
        if len(self.known) + len(new) > self.most:
            self._clear()
            new = np.arange(len(unique))
        if len(new):
            self._learn(unique[new], [raw[starts[i] : ends[i]].decode("utf-8", "replace") for i in first[new]])
        at = self._find(unique)[0][which]
        size = self.size[at].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.start[at] - total[:-1], size) + np.arange(total[-1])]
        bounds = total[row_bounds(offs, starts)]
        if b"<|" in raw:
            special = [i for i in range(len(offs) - 1) if raw.find(b"<|", offs[i], offs[i + 1]) >= 0]
            if special:
                rows = [ids[bounds[i] : bounds[i + 1]] for i in range(len(offs) - 1)]
                for i in special:
                    rows[i] = np.array(self.tokenizer.encode(raw[offs[i] : offs[i + 1]].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
                ids = np.concatenate(rows)
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
        return ids, bounds


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This process's encoder: a reused Python worker keeps the words it knows."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def forget(path: str) -> None:
    """Frees this process's encoder, some 60 MB with its words, which an idle worker would keep."""
    _encoders.pop(path, None)
