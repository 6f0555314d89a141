"""Encoding with a given tokenizer inside tasks.

The vocabulary's pieces never reach over white space, so words are encoded one by one, and the library's answers are kept: most of
a corpus is frequent words. Texts are taken in blocks, whose distinct words are looked up once; numpy puts the ids of all words together.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tidemart.llm.arrow_text import WordHasher, blocks, utf8

#: Words whose ids a worker keeps; when there are more, it begins anew.
MEMO_WORDS = 250_000
#: Bytes of text whose distinct words are looked up together; numpy's arrays of a block take some forty times as much.
BLOCK_BYTES = 1 << 19
# Latin letters, of which each is one composed character, then perhaps other ASCII characters, which are cut off as one piece of their own.
_plain = re.compile("([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-&(-/:;=-@[-`{}~]*)")
# How byte-level vocabularies write bytes: those of printable Latin-1 characters as these, the others as characters from 256 on.
_printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_byte_letters = {b: chr(b) for b in _printable} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _printable)}


class Encoder:
    """Ids of whole texts as the library gives them, without special tokens.

    by_word: the tokenizer folds case, cuts at white space and drops it, so words can be looked up (by a 64-bit hash; with MEMO_WORDS kept
    words, a word that is not among them is taken for one with a chance below 1e-13). Otherwise the library gets the whole text.
    """

    def __init__(self, path: str, by_word: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.by_word, self.vocabulary, self._library = by_word, tokenizer.get_vocab_size(with_added_tokens=True), tokenizer.encode
        self._model = tokenizer.model.tokenize
        self._hasher, self._pieces = WordHasher(), {}
        self._forget()

    def _forget(self) -> None:
        self._slot: dict[int, int] = {}
        self._start, self._length, self._ids = array("q"), array("q"), array("I")

    def _encode(self, text: str) -> list[int]:
        return self._library(text, add_special_tokens=False).ids

    def _word(self, word: str) -> list[int]:
        """A word in lower case (A-Z at least)."""
        m = _plain.fullmatch(word)
        if not m or not m[1].islower():
            return self._encode(word)
        letters, tail = m.groups()
        return self._letters(letters) + (self._piece(tail) if tail else [])

    def _letters(self, word: str) -> list[int]:
        """A run of Latin letters in lower case. The steps before the model would leave it as it is, in the model's letters for bytes."""
        return [t.id for t in self._model(word if word.isascii() else "".join(map(_byte_letters.__getitem__, word.encode())))]

    def _piece(self, piece: str) -> list[int]:
        ids = self._pieces.get(piece)
        if ids is None:
            if len(self._pieces) >= 50_000:
                self._pieces.clear()
            ids = self._pieces[piece] = self._encode(piece)
        return ids

    def _add(self, key: int, word: bytes) -> int:
        ids, slot = self._word(word.decode()), len(self._slot)
        self._start.append(len(self._ids))
        self._length.append(len(ids))
        self._ids.extend(ids)
        self._slot[key] = slot
        return slot

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each row of a block."""
        h, s, e, row = self._hasher.words(data, offsets)
        if not len(h):
            return [np.zeros(0, np.uint32)] * (len(offsets) - 1)
        if len(self._slot) > MEMO_WORDS:
            self._forget()
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        get = self._slot.get
        slots = np.array([get(x, -1) for x in u.tolist()])
        fresh = np.flatnonzero(slots < 0)
        raw, w = data[offsets[0] : offsets[-1]].tobytes().lower(), first[fresh]
        new = zip(u[fresh].tolist(), (s[w] - offsets[0]).tolist(), (e[w] - offsets[0]).tolist(), strict=True)
        slots[fresh] = [self._add(key, raw[x:y]) for key, x, y in new]
        at = slots[inverse]
        n = np.array(self._length)[at]
        ends = np.cumsum(n)
        ids = np.array(self._ids, np.uint32)[np.repeat(np.array(self._start)[at] - (ends - n), n) + np.arange(ends[-1])]
        cuts = np.concatenate([[0], ends])[np.searchsorted(row, np.arange(len(offsets)))]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """uint32 ids of each text; a null text has none."""
        if not self.by_word:
            yield from (np.array(self._encode(t.as_py() or ""), np.uint32) for t in texts)
            return
        data, offsets = utf8(texts)
        for i, j in blocks(offsets, BLOCK_BYTES):
            found = self._block(data, offsets[i : j + 1])
            for k in range(i, j):
                raw = data[offsets[k] : offsets[k + 1]].tobytes()
                # Case is folded before the library does it, which is the same but beside combining marks (they may join capitals
                # otherwise) and special tokens (matched as they are written): such texts go to the library whole.
                if b"\xcc" in raw or b"\xcd" in raw or b"<|" in raw:
                    yield np.array(self._encode(raw.decode()), np.uint32)
                else:
                    yield found[k - i]


@lru_cache(maxsize=2)
def encoder(path: str, by_word: bool = True) -> Encoder:
    """One per Python worker; what it keeps serves all tasks that the worker runs."""
    return Encoder(path, by_word)


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
