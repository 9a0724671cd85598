"""Token ids of whole texts, from a public vocabulary file.

The vocabulary lowers case and splits at white space and between letters and other signs, so each chunk of a
text is encoded on its own. A batch encodes each distinct chunk once, and a Python worker remembers chunks;
the ids are those of encoding the whole text.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from framescore.llm.words import hash_words, string_buffers

# Chunks remembered by a Python worker: a bound on its memory, not on what is encoded.
REMEMBERED = 600_000

_MARK = np.zeros(256, bool)
_MARK[[0xCC, 0xCD]] = True


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkTokenizer:
    """Ids of a column of texts; chunks seen before are looked up."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.model.no_padding()
        self.model.no_truncation()
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.ids = np.zeros(1 << 20, np.int32)
        self.starts = np.zeros(1 << 16, np.int64)

    def _learn(self, hashes: list[int], chunks: list[str]) -> None:
        """Encode chunks, many in one call.

        A chunk of letters is one piece to the vocabulary, whose last token alone ends a word; chunks of
        another kind are passed as a list, and each token tells the chunk that it comes from.
        """
        plain = [i for i, c in enumerate(chunks) if c.isalpha() and (c.isascii() or c.lower().isalpha())]
        joined = [" ".join([chunks[i] for i in plain[lo : lo + 64]]) for lo in range(0, len(plain), 64)]
        done = self.model.encode_batch_fast(joined, add_special_tokens=False)
        flat = np.fromiter((i for d in done for i in d.ids), np.int32)
        ends = self.ends[flat]
        if int(ends.sum()) != len(plain):
            plain, flat, ends = [], flat[:0], ends[:0]
        owner = np.array(plain, np.int64)[np.cumsum(ends) - ends]
        rest = np.setdiff1d(np.arange(len(chunks)), plain)
        groups = [[chunks[i] for i in rest[lo : lo + 256]] for lo in range(0, len(rest), 256)]
        more, owners = [flat], [owner]
        for i, d in enumerate(self.model.encode_batch(groups, is_pretokenized=True, add_special_tokens=False)):
            more.append(np.array(d.ids, np.int32))
            owners.append(rest[np.array(d.word_ids, np.int64) + 256 * i])
        flat, owner = np.concatenate(more), np.concatenate(owners)
        flat, owner = flat[order := np.argsort(owner, kind="stable")], owner[order]
        n, used = len(self.known), int(self.starts[len(self.known)])
        sizes = np.bincount(owner, minlength=len(chunks))
        total = used + int(sizes.sum())
        if n + len(chunks) >= len(self.starts):
            self.starts = np.resize(self.starts, 2 * (n + len(chunks)))
        if total > len(self.ids):
            self.ids = np.resize(self.ids, 2 * total)
        self.ids[used:total] = flat
        self.starts[n + 1 : n + 1 + len(chunks)] = used + np.cumsum(sizes)
        self.known.update(zip(hashes, range(n, n + len(chunks))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the column, and where each row's ids begin (one more than rows)."""
        texts = pc.fill_null(texts, "")
        # Lowering ASCII first commutes with composing unless a combining mark (lead byte CC or CD) is there.
        if not _MARK[string_buffers(texts)[0]].any():
            texts = pc.ascii_lower(texts)
        words = hash_words(texts, apart=True)
        codes, distinct = pd.factorize(words.hashes)
        where = np.zeros(len(distinct), np.int64)
        where[codes[::-1]] = np.arange(len(codes))[::-1]
        keys = distinct.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self._forget()
            new = list(range(len(keys)))
        if new:
            spans = zip(words.start[where[new]].tolist(), words.end[where[new]].tolist())
            raw = words.data.tobytes()
            self._learn([keys[i] for i in new], [raw[s:e].decode() for s, e in spans])
        entry = np.fromiter((self.known[k] for k in keys), np.int64, len(keys))[codes]
        first, size = self.starts[entry], self.starts[entry + 1] - self.starts[entry]
        ends = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(first - ends[:-1], size) + np.arange(int(ends[-1]))
        return self.ids[take], ends[words.first]


@lru_cache(maxsize=4)
def tokenizer(path: str) -> ChunkTokenizer:
    """One for each Python worker and vocabulary."""
    return ChunkTokenizer(path)


def crc32_of(ids: np.ndarray) -> int:
    """CRC-32 of the ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
