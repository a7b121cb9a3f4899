"""Token ids of whole texts by way of pieces that repeat.

The published splitting pattern never joins characters across the end of a run of non-space characters, so a text is
cut into pieces `white space, then non-space` and each different piece is encoded once per worker. The memory of
pieces is bounded: it is emptied when full."""
from __future__ import annotations

import base64
import json
import re
from array import array
from collections.abc import Callable

# The characters with Unicode's White_Space property.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
MOST_PIECES = 600_000


class PieceMemory(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers; `encode` gives the ids of one piece, long pieces are not kept. `added` are names
    that stand for an id of their own wherever they occur (of overlapping ones the first, and there the longest); the texts between them are
    encoded by themselves."""

    def __init__(self, encode: Callable[[str], bytes], added: dict[str, int] | None = None):
        super().__init__()
        self.encode = encode
        self.added = {name: number.to_bytes(4, "little") for name, number in (added or {}).items()}
        self.names = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= 64:
            if len(self) >= MOST_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        """Ids of a whole text; a null text has none."""
        if self.names is None or not text or not self.names.search(text):
            return b"".join(map(self.__getitem__, PIECES.findall(text or "")))
        parts = self.names.split(text)  # every other part is a name
        return b"".join(self.added[part] if i % 2 else b"".join(map(self.__getitem__, PIECES.findall(part))) for i, part in enumerate(parts))

    def ids_of_all(self, texts: list[str | None], encode_all: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """As `ids` for each text, but what is new in them is encoded at once, except long pieces."""
        cut = [PIECES.findall(text or "") for text in texts]
        new = [piece for piece in set().union(*cut).difference(self) if len(piece) <= 64]
        if len(self) + len(new) > MOST_PIECES:
            self.clear()
            new = [piece for piece in set().union(*cut) if len(piece) <= 64]
        self.update(zip(new, encode_all(new)))
        return [b"".join(map(self.__getitem__, pieces)) for pieces in cut]


def rank_table(path: str) -> dict[bytes, int]:
    """A published rank file: base64 of a token's bytes, a space, its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def added_tokens(path: str) -> dict[str, int]:
    """The names and ids that a published tokenizer file adds to its vocabulary, as they are found in texts."""
    with open(path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(token[flag] for token in added for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("an added token that looks at the text around it is not supported")
    return {token["content"]: token["id"] for token in added}


def library_pieces(ranks: str, pattern: str, added: dict[str, int] | None = None) -> PieceMemory:
    """Pieces encoded by the installed library from a published rank file. Names of special tokens are ordinary text, unless they are `added`."""
    import tiktoken

    library = tiktoken.Encoding("published", pat_str=pattern, mergeable_ranks=rank_table(ranks), special_tokens={})
    return PieceMemory(lambda piece: array("I", library.encode_ordinary(piece)).tobytes(), added)
