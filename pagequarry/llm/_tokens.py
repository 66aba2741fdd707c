"""Public tokenizers by path, loaded once in each Python worker."""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
DEFAULT_PIECES = "/opt/tokenizers/piece_bpe_32k.model"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=4)
def byte_bpe(path: str = DEFAULT_VOCABULARY, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def pieces(path: str = DEFAULT_PIECES):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def encoder(path: str = DEFAULT_VOCABULARY) -> Callable[[str], list[int]]:
    return byte_bpe(path).encode_ordinary


def token_counter(path: str = DEFAULT_VOCABULARY) -> Callable[[pa.Array], np.ndarray]:
    encode = encoder(path)
    return lambda arr: np.fromiter((len(encode(t)) for t in arr.to_pylist()), np.int64, len(arr))
