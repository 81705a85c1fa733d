"""Token counts under a public tokenizer whose files stay where they are; their folder is a parameter."""

from __future__ import annotations

import base64
import importlib.util
import os

import tiktoken

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

_LOADED: dict[tuple[str, str], tiktoken.Encoding] = {}


def encoding(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> tiktoken.Encoding:
    """The encoding of a vocabulary file, loaded once a process."""
    key = (folder, vocabulary)
    if key not in _LOADED:
        spec = importlib.util.spec_from_file_location("_public_tokenizers", os.path.join(folder, "__init__.py"))
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        with open(os.path.join(folder, vocabulary), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _LOADED[key] = tiktoken.Encoding(vocabulary, pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[key]


def count(text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> int:
    """Tokens of a text; a surrogate that no encoding has counts as a replacement character."""
    enc = encoding(folder, vocabulary)
    try:
        return len(enc.encode_ordinary(text))
    except UnicodeEncodeError:
        return len(enc.encode_ordinary(text.encode("utf-8", "replace").decode()))
