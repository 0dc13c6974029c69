"""Public tokenizer files: loaded once per Python worker, by path; never copied or trained."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

#: Where the vocabulary files are; every operator takes another place as a parameter.
TOKENIZER_DIR = "/opt/tokenizers"

_GPT2_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=8)
def pieces(path: str):
    """A sentencepiece processor."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=8)
def ranks(path: str):
    """A tiktoken encoding from a file of ranks; no string is special in it."""
    import tiktoken

    with open(path, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=_GPT2_SPLIT, mergeable_ranks=merges, special_tokens={})


def token_ids(path: str, texts: list[str]) -> list[list[int]]:
    """Token ids of whole texts under the vocabulary in path (.model: sentencepiece, .tiktoken: ranks)."""
    if path.endswith(".model"):
        return pieces(path).encode(texts, num_threads=1)
    if path.endswith(".tiktoken"):
        encode = ranks(path).encode_ordinary
        return [encode(x) for x in texts]
    raise ValueError(f"not a .model or .tiktoken file: {path}")
