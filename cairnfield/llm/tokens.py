"""Token ids of whole texts by the vocabulary file's byte-level BPE.

The file is read as the tokenizers library reads it. tiktoken's encoder, made from the same file's ranks, gives the same
ids in a third of the time without any cache that grows; it is used where the file allows it (byte-level pieces, merges
numbered in order). Very long runs of white space overflow its pattern matcher; such texts, and other files, go through
tokenizers. Tests compare the two on every code point and on whole tables.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

VOCABULARY = "byte_bpe_50k.json"
END = 0
#: Texts of at most so many characters, or whose runs of white space are as short, can't overflow the pattern matcher.
SHORT = 1 << 14
_RUN = re.compile(r"\s{64,}")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for: printable Latin-1 bytes are themselves, the others
    follow in order from code point 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def ranks(path: str) -> dict[bytes, int] | None:
    """Ids of all pieces as ranks of their merges; None if the file's rules are not those of plain byte-level BPE."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, before = told["model"], told.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not model.get("ignore_merges") and not told.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    letters = byte_letters()
    if not plain or not all(c in letters for piece in model["vocab"] for c in piece):
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get("".join(p)) for p in pairs]
    if made != list(range(256, 256 + len(made))) or len(model["vocab"]) != 256 + len(made):
        return None
    return {bytes(letters[c] for c in piece): i for piece, i in model["vocab"].items()}


class Encoder:
    """ids of texts by the vocabulary file at ``path``."""

    def __init__(self, path: str) -> None:
        self.path, known = path, ranks(path)
        self.fast = None
        if known:
            import public_tokenizers
            import tiktoken

            self.fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})

    @functools.cached_property
    def exact(self):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        return tokenizer

    def encode(self, text: str | None) -> np.ndarray:
        """Unsigned 32-bit ids of a text; a null text is empty."""
        if not text:
            return np.empty(0, np.uint32)
        if self.fast and (len(text) <= SHORT or all(m.end() - m.start() <= SHORT for m in _RUN.finditer(text))):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.cache
def encoder(path: str) -> Encoder:
    """The worker's encoder for the file, loaded once."""
    return Encoder(path)


def documents_ids(batch: pa.RecordBatch, path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids with END appended) of each row of a (doc_id, text) batch."""
    encode = encoder(path).encode
    for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
        yield d, np.append(encode(t.as_py()), np.uint32(END))
