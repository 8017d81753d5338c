"""Encoders of public vocabularies, and the bytes of their tokens."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np

#: How the byte-level vocabularies split a text, fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters from which a text is encoded in stretches by the piece vocabulary.
STRETCH = 1 << 16
_SPACE = "▁"


def _spelled() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def byte_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; special tokens are their text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte = _spelled()
    special = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", ())}
    out = [b""] * (1 + max([*spec["model"]["vocab"].values(), *special]))
    for token, k in spec["model"]["vocab"].items():
        out[k] = special[k] if k in special else bytes(byte[c] for c in token)
    return out


def byte_encoder(path: str, special: bool = True) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids, by the vocabulary of a byte-level BPE file of the tokenizers library; special: their strings in a text are special tokens.

    Ranks of a byte-level vocabulary are its ids, so tiktoken gives the same ids several times as
    fast; if on a probe it doesn't, the tokenizers library itself is used, and so it is for a text
    whose runs of white space are too long for tiktoken's pattern.
    """
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = not special

    def slow(text: str) -> np.ndarray:
        return np.array(library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    names = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    try:
        import tiktoken

        byte = _spelled()
        ranks = {bytes(byte[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in names}
        quick = tiktoken.Encoding("from-file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=names)
        allowed = "all" if special else set()
        encode = lambda text: quick.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())
        probe = " It's 12  über\n\n\tñandú—日本語 🙂 x_y %%% <|endoftext|> déjà vu \r\n'LL "
        if encode(probe).tolist() != slow(probe).tolist():
            return slow
    except (ImportError, KeyError):
        return slow

    def fast(text: str) -> np.ndarray:
        try:
            return encode(text)
        except ValueError:
            return slow(text)

    return fast


def piece_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a piece vocabulary: U+2581 is a space, <0xHH> that byte."""
    from sentencepiece import SentencePieceProcessor

    pieces = SentencePieceProcessor(model_file=path)
    out = []
    for k in range(pieces.get_piece_size()):
        piece = pieces.id_to_piece(k)
        out.append(bytes([int(piece[3:5], 16)]) if pieces.is_byte(k) else piece.replace(_SPACE, " ").encode())
    return out


def stretches(text: str, most: int = STRETCH) -> list[str]:
    """A text cut at single spaces after other characters, once `most` of them are past; the spaces go, as the piece vocabulary puts one before each stretch."""
    out, start = [], 0
    while len(text) - start > most:
        at = text.find(" ", start + most)
        while at >= 0 and text[at - 1] == " ":
            at = text.find(" ", at + 1)
        # an empty rest would lose the space, as the library gives nothing for it
        if at < 0 or at + 1 == len(text):
            break
        out.append(text[start:at])
        start = at + 1
    return [*out, text[start:]]


def piece_encoder(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """A function from texts to their ids by a piece vocabulary; long texts go in stretches if no piece has a space after another character."""
    from sentencepiece import SentencePieceProcessor

    pieces = SentencePieceProcessor(model_file=path)
    apart = not any(_SPACE in pieces.id_to_piece(k).lstrip(_SPACE) for k in range(pieces.get_piece_size()))
    spaced = pieces.encode("a b  c") == pieces.encode("a") + pieces.encode("b") + pieces.encode(" c")

    def encode(texts: list[str]) -> list[np.ndarray]:
        parts = [stretches(t) if apart and spaced and len(t) > STRETCH else [t] for t in texts]
        found = iter(pieces.encode([p for own in parts for p in own], num_threads=1))
        return [np.array([i for _ in own for i in next(found)], dtype=np.int64) for own in parts]

    return encode
