"""Byte-pair token ids with a bounded cache of words."""

from __future__ import annotations

import base64
import functools
import json
from array import array

#: Words whose ids a Python worker keeps; later words are encoded anew each time.
CACHE_WORDS = 200_000


class WordCache(dict):
    """Ids, as little-endian unsigned 32-bit bytes, of a word with the space or newline before it.

    A key that starts with a newline stands for itself, any other for itself after one space.
    """

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.encode(word if word[0] == "\n" else f" {word}")).tobytes()
        if len(self) < self.limit:
            self[word] = ids
        return ids


class Encoder:
    """Encodes whole texts to packed ids.

    The public pattern splits a text before any word that one space or one newline precedes, so texts
    whose white space is only such single characters are encoded word by word; all others at once.
    """

    def __init__(self, ranks_path: str, special_json: str | None = None, limit: int = CACHE_WORDS):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        core = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = core.encode_ordinary
        self.words = WordCache(core.encode_ordinary, limit)
        self.special_json = special_json

    @functools.cached_property
    def special_strings(self) -> list[str]:
        """What the tokenizer file reads as one special token."""
        if not self.special_json:
            return []
        with open(self.special_json, encoding="utf-8") as file:
            return [x["content"] for x in json.load(file).get("added_tokens", [])]

    @functools.cached_property
    def tokenizer(self):
        """The tokenizer file itself; loaded only once a text holds a special string."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.special_json)

    def packed(self, text: str) -> bytes:
        if any(x in text for x in self.special_strings):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        # Equal lists prove that every piece is a word: split() gives no empty piece and none with white space.
        if text.replace("\n", " ").split(" ") == text.split():
            first, *rest = text.replace("\n", " \n").split(" ")
            return array("I", self.whole(first)).tobytes() + b"".join(map(self.words.__getitem__, rest))
        return array("I", self.whole(text)).tobytes()


@functools.lru_cache(maxsize=4)
def encoder(ranks_file: str, special_file: str | None = None) -> Encoder:
    """One encoder for each Python worker. A bare file name is looked up among the public tokenizers."""
    return Encoder(resolve(ranks_file), special_file and resolve(special_file))


def resolve(file: str) -> str:
    if "/" in file:
        return file
    import public_tokenizers

    return public_tokenizers.path(file)
