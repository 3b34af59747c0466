"""Byte-level BPE ids of whole texts.

A tokenizer file whose every entry its own merges lead to, in the order of the ids, is a
table of ranks: the ids of a text are those that merging by rank gives, whichever program
does it. Such files are encoded by tiktoken, which does nothing else and keeps nothing;
all others by the tokenizers library.
"""

from __future__ import annotations

import json
import re
from array import array

import tiktoken
from tokenizers import Tokenizer

# Fixed value: the pattern by which byte-level tokenizer files split a text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def shown_bytes() -> dict[int, str]:
    """The printable character that stands for each byte in the entries of such files."""
    alphabet = iter(range(256, 512))
    return {
        b: chr(b if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b else next(alphabet))
        for b in range(256)
    }


def entries(tokenizer: Tokenizer) -> dict[bytes, int]:
    """The bytes of each entry that is made of shown bytes, with its id."""
    byte_of = {c: b for b, c in shown_bytes().items()}
    return {
        bytes(byte_of[c] for c in entry): i
        for entry, i in tokenizer.get_vocab(with_added_tokens=False).items()
        if all(c in byte_of for c in entry)
    }


def _ranks(tokenizer: Tokenizer) -> dict[bytes, int] | None:
    """The entries as ranks, if merging by them does what the file says."""
    parts = json.loads(tokenizer.to_str())
    model, split = parts["model"], parts["pre_tokenizer"] or {}
    if (
        model["type"] != "BPE"
        or parts["normalizer"]
        or any(model.get(x) for x in (
            "dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges",
            "fuse_unk",
        ))
        or split.get("type") != "ByteLevel"
        or split.get("add_prefix_space")
        or not split.get("use_regex", True)
    ):
        return None
    vocab, added = model["vocab"], set(tokenizer.get_added_tokens_decoder())
    merged = [
        vocab["".join(pair.split(" ") if isinstance(pair, str) else pair)]
        for pair in model["merges"]
    ]
    known = {i: entry for entry, i in vocab.items() if i not in added}
    if any(a >= b for a, b in zip(merged, merged[1:], strict=False)) or any(
        [token.id for token in tokenizer.model.tokenize(entry)] != [i]
        for i, entry in known.items()
    ):
        return None
    ranks = {x: i for x, i in entries(tokenizer).items() if i in known}
    whole = len(ranks) == len(known) and all(bytes([b]) in ranks for b in range(256))
    return ranks if whole else None


class Encoder:
    """Ids of the tokenizer file ``path``, with no special tokens put around a text.

    With ``added_tokens`` the file's added tokens have their own ids where a text holds
    them, as the library has it; else their strings are ordinary text."""

    def __init__(self, path: str, added_tokens: bool = False):
        tokenizer = Tokenizer.from_file(path)
        strings = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self._added = None
        if added_tokens and strings:
            self._added = re.compile("|".join(map(re.escape, strings)))
        tokenizer.encode_special_tokens = not added_tokens
        self._whole = tokenizer
        ranks = _ranks(tokenizer)
        self._plain = ranks and tiktoken.Encoding(
            "file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary

    def ids(self, text: str) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self._plain or (self._added and self._added.search(text)):
            # few texts hold an added token; the library knows what each takes with it
            return array("I", self._whole.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self._plain(text)).tobytes()


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, added_tokens: bool = False) -> Encoder:
    """The worker's encoder of a tokenizer file."""
    key = path, added_tokens
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, added_tokens)
    return _ENCODERS[key]
