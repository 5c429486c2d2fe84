"""Token ids of whole texts by a public byte-level BPE vocabulary.

Ids are those of ``tokenizers`` with the vocabulary's JSON file and add_special_tokens=False.  Where a rank file of the same
vocabulary is given, texts go through ``tiktoken``, which makes the same ids several times faster; texts that hold an added token's string, or
on which it fails (endless runs of blanks), go through ``tokenizers``.  Both paths are parameters; the files are never copied.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa


@dataclass(frozen=True)
class Vocabulary:
    """Paths of a tokenizers JSON file and, if any, of a tiktoken rank file and its split pattern."""

    json: str
    ranks: str | None = None
    pattern: str | None = None


def byte_bpe_50k() -> Vocabulary:
    import public_tokenizers as p

    return Vocabulary(p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)


class Encoder:
    def __init__(self, v: Vocabulary) -> None:
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(v.json)
        self.added = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.slow.get_vocab_size() <= 65536 else "<u4")
        self.fast = None
        if v.ranks:
            import tiktoken

            with open(v.ranks, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=v.pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and len(text) < 1_000_000 and not any(x in text for x in self.added):
            try:
                return np.array(self.fast.encode_ordinary(text), dtype=self.dtype)
            except BaseException as e:  # a panic of the Rust side is no Exception
                if type(e).__name__ != "PanicException":
                    raise
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=self.dtype)


@lru_cache(maxsize=4)
def encoder(v: Vocabulary) -> Encoder:
    """One encoder per worker process."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(v)


def encode(texts: pa.Array, v: Vocabulary, end: int = 0) -> list[np.ndarray]:
    """Ids of each text (null: empty), followed by the id that ends a document."""
    e = encoder(v)
    tail = np.array([end], dtype=e.dtype)
    return [np.concatenate((e.ids(t or ""), tail)) for t in texts.to_pylist()]
