"""Token ids of many texts, by the tokenizers library.

The vocabulary ``word_bpe_49k`` drops white space before it looks at words,
so a text's ids are the ids of its white-space separated chunks, one after
the other.  Arrow splits a batch into chunks and numbers the distinct ones;
the library encodes each distinct chunk once per worker; numpy puts the ids
in order.  Results equal ``Tokenizer.encode(text, add_special_tokens=False)``
(tested), special tokens written in a text included.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .common import byte_slices, split_words, string_array

VOCABULARY = "word_bpe_49k.json"

# Entries kept per worker before the stores are emptied (memory, not results).
STORE_LIMIT = 400_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where this machine keeps the vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _letters(last: int) -> tuple[str, str]:
    kinds = {"L": [], "N": []}
    for code in range(last + 1):
        kind = unicodedata.category(chr(code))[0]
        if kind in kinds:
            kinds[kind].append(re.escape(chr(code)))
    return "".join(kinds["L"]), "".join(kinds["N"])


class ChunkEncoder:
    """Ids of texts; keeps what it has encoded."""

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path or vocabulary_path())
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        # Chunks of Latin letters up to U+024F need no normal form and split
        # into words by plain classes; the library splits all others itself.
        letters, digits = _letters(0x24F)
        self.plain = re.compile("[!-~¡-¬®-įı-ɏ]+")
        self.word = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{letters}{digits}]+")

    def _of_word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            shown = word
            if not word.isascii():
                shown = "".join(x[0] for x in self.library.pre_tokenizer.pre_tokenize_str(word))
            found = np.array([t.id for t in self.library.model.tokenize(shown)], "<u4").tobytes()
            self.words[word] = found
        return found

    def _of_chunk(self, chunk: str) -> bytes:
        if self.plain.fullmatch(chunk) and "<|" not in chunk:
            found = b"".join(map(self._of_word, self.word.findall(chunk.lower())))
        else:
            found = np.array(self.library.encode(chunk, add_special_tokens=False).ids,
                             "<u4").tobytes()
        self.chunks[chunk] = found
        return found

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offsets of each text's ids)."""
        column = string_array(column)
        parts, counts = [], []
        for first, last in byte_slices(column):
            words, index, offsets = split_words(column.slice(first, last - first))
            if len(self.chunks) > STORE_LIMIT:
                self.chunks.clear()
            if len(self.words) > STORE_LIMIT:
                self.words.clear()
            get = self.chunks.get
            coded = [get(w) or self._of_chunk(w) for w in words.to_pylist()]
            pool = np.frombuffer(b"".join(coded), "<u4")
            size = np.fromiter(map(len, coded), np.int64, len(coded)) >> 2
            start = np.cumsum(size) - size
            sizes = size[index]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            at = np.repeat(start[index] - ends[:-1], sizes)
            at += np.arange(len(at))
            parts.append(pool[at])
            counts.append(np.diff(ends[offsets]))
        counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        ids = np.concatenate(parts) if parts else np.zeros(0, "<u4")
        return ids, np.concatenate([[0], np.cumsum(counts)])


@lru_cache(maxsize=2)
def encoder(path: str | None = None) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file (None: the public one)."""
    return ChunkEncoder(path)


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with ``end`` after each text's."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end, "<u4")
    mark = np.zeros(len(out), bool)
    mark[offsets[1:] + np.arange(n)] = True
    out[~mark] = ids
    return out, offsets + np.arange(n + 1)


def slices_of(batch: pa.RecordBatch, name: str = "text"):
    """(rows of the batch, their texts) in pieces of bounded bytes."""
    column = string_array(batch.column(name))
    for first, last in byte_slices(column):
        yield batch.slice(first, last - first), column.slice(first, last - first)
