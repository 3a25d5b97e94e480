"""Reads vocabularies of public tokenizers: pieces, scores and kinds of a sentencepiece model file."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

SPACE = "▁"
#: Kinds of pieces in the public model format, fixed values.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def default_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(number, wire type, value) of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[wire]
            value, at = data[at : at + size], at + size
        yield key >> 3, wire, value


@dataclass
class Vocabulary:
    """Pieces in the order of their ids, with scores and kinds, and what the model does to a text before it splits it."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool = True
    squeeze: bool = False
    unknown: int = 0
    byte_ids: list[int] | None = field(default=None)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, data: bytes) -> Vocabulary:
        pieces, scores, kinds, prefix, squeeze = [], [], [], True, True
        for number, _, value in fields(data):
            if number == 1:
                own = {n: v for n, _, v in fields(value)}
                pieces.append(own[1].decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, NORMAL))
            elif number == 3:
                own = {n: v for n, _, v in fields(value)}
                if own.get(2):
                    raise ValueError("only models that leave characters as they are can be read")
                prefix, squeeze = bool(own.get(3, 1)), bool(own.get(4, 1))
        if USER_DEFINED in kinds:
            raise ValueError("models with user-defined pieces can't be read")
        bytes_ = [i for i, k in enumerate(kinds) if k == BYTE]
        return cls(pieces, scores, kinds, prefix, squeeze, kinds.index(UNKNOWN) if UNKNOWN in kinds else 0, bytes_ if len(bytes_) == 256 else None)

    @cached_property
    def normal(self) -> dict[str, int]:
        """Ids of the pieces that a text can be split into."""
        return {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, UNUSED)}

    def mark(self, text: str) -> str:
        """The text with its spaces marked, and one mark in front; an empty text stays empty."""
        if self.squeeze:
            text = re.sub(" +", " ", text.replace(SPACE, " ")).strip(" ")
        return ((" " if self.dummy_prefix else "") + text).replace(" ", SPACE) if text else ""

    @cached_property
    def splitter(self) -> re.Pattern:
        """Marked words: no piece goes on past a mark, nor holds a line feed, so a word can be split by itself."""
        for p in self.normal:
            if SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1):
                return re.compile(r"(?s).+")
        return re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
