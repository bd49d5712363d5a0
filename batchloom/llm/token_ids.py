"""Token ids and token bytes of public vocabularies, for whole texts of any length.

The driver reads the vocabulary files; tasks get their contents as broadcasts, whose
size is that of the files, and keep the ready encoders of a worker.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from batchloom.llm.tokens import PATTERN, letters

STRETCH = 1 << 20  # characters that are encoded at a time
_CUT = re.compile(r"(?<=\w) (?=\w)")
_SPACE = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_READY: dict = {}


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """Consecutive parts whose tokens together are those of the text.

    They are cut before a single space between two letters or digits, which no
    token crosses. Without such a place a part is longer than ``size``.
    """
    at = 0
    while len(text) - at > size:
        found = _CUT.search(text, at + size)
        if found is None:
            break
        yield text[at:found.start()]
        at = found.start()
    yield text[at:]


@dataclass(frozen=True)
class ByteLevel:
    """A byte-level vocabulary: the id of each token's bytes, and the special strings."""

    ranks: dict[bytes, int]
    special: dict[str, int]

    def encoder(self, plain: bool = False) -> ByteLevelEncoder:
        return _ready(("bytes", len(self.ranks), tuple(self.special.items()), plain), lambda: ByteLevelEncoder(self, plain))


def read_byte_level(path: str) -> ByteLevel:
    """The vocabulary of a tokenizer file whose merges rank as their results' ids do."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, letter = spec["model"], letters()
    made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if made != sorted(made) or model.get("ignore_merges") or not spec["pre_tokenizer"].get("use_regex"):
        raise ValueError(f"the merges of {path} do not rank as the ids do")
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    return ByteLevel({bytes(letter[c] for c in t): i for t, i in model["vocab"].items() if t not in special}, special)


class ByteLevelEncoder:
    """Ids of a byte-level vocabulary; with ``plain``, special strings in a text are plain text."""

    def __init__(self, vocabulary: ByteLevel, plain: bool):
        import tiktoken

        self.codec = tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens=vocabulary.special)
        self.allowed = set() if plain else "all"
        self.token_bytes = [b""] * (max([*vocabulary.ranks.values(), *vocabulary.special.values()]) + 1)
        for token, number in vocabulary.ranks.items():
            self.token_bytes[number] = token

    def ids(self, text: str) -> np.ndarray:
        parts = [self.codec.encode_to_numpy(p, allowed_special=self.allowed, disallowed_special=()) for p in stretches(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


@dataclass(frozen=True)
class Pieces:
    """A vocabulary of pieces with byte fallback, as its file's contents."""

    model: bytes

    def encoder(self) -> PieceEncoder:
        return _ready(("pieces", self.model), lambda: PieceEncoder(self.model))


def read_pieces(path: str) -> Pieces:
    with open(path, "rb") as file:
        return Pieces(file.read())


class PieceEncoder:
    """Ids of a vocabulary of pieces, which puts a space before a text."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.codec = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.codec.id_to_piece(i) for i in range(self.codec.get_piece_size())]
        self.token_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace(_SPACE, " ").encode() for p in names]
        # a piece with a space after another character could cross the ends of stretches
        self.apart = not any(_SPACE in p.lstrip(_SPACE) for p in names)

    def ids(self, text: str) -> np.ndarray:
        if not self.apart or len(text) <= STRETCH:
            return np.array(self.codec.encode(text), np.uint32)
        # a part after the first begins with the space that the codec adds
        parts = [self.codec.encode(p[1:] if k else p) for k, p in enumerate(stretches(text))]
        return np.concatenate([np.array(p, np.uint32) for p in parts])


def _ready(key, make):
    """The encoder of ``key``, made once in each worker."""
    if key not in _READY:
        _READY[key] = make()
    return _READY[key]
