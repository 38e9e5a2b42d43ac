"""Token ids of a byte-level BPE vocabulary file, exactly as its tokenizer file defines them.

The merges are run by the rank file of the same vocabulary, which is several times faster; texts
that hold an added token's string go through the tokenizer file itself. Words repeat, so their ids
are kept in a bounded table: a text is cut at single spaces between other characters, where the
pre-tokenizer always cuts too, and a text in which some piece is not of that plain form is encoded
in one go. A test compares all of this with the tokenizer file.
"""

from __future__ import annotations

import base64

import numpy as np


class _Table(dict):
    """Ids of a piece, as little-endian 32-bit bytes; None if the piece can't be encoded alone."""

    def __init__(self, encode, prefix: str, most: int):
        super().__init__()
        self.encode, self.prefix, self.most = encode, prefix, most

    def __missing__(self, piece: str) -> bytes | None:
        if len(self) >= self.most:
            self.clear()
        plain = piece and not piece[0].isspace() and not piece[-1].isspace()
        out = np.array(self.encode(self.prefix + piece), dtype="<u4").tobytes() if plain else None
        if len(piece) <= 64:
            self[piece] = out
        return out


class Encoder:
    """Encodes texts; ``json_path`` and ``rank_path`` hold one vocabulary in two forms."""

    def __init__(self, json_path: str, rank_path: str, pattern: str, cached_pieces: int = 400_000):
        import tiktoken
        from tokenizers import Tokenizer

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.full = Tokenizer.from_file(json_path)
        self.added = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.first = _Table(self.plain, "", cached_pieces // 8)
        self.later = _Table(self.plain, " ", cached_pieces)

    def __call__(self, text: str) -> np.ndarray:
        """uint32 ids of the whole text, without special tokens around it."""
        if any(a in text for a in self.added):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4")
        head, *rest = text.split(" ")
        pieces = [self.first[head], *map(self.later.__getitem__, rest)]
        if None in pieces:
            return np.array(self.plain(text), dtype="<u4")
        return np.frombuffer(b"".join(pieces), dtype="<u4")


def byte_bpe_encoder() -> Encoder:
    """The public 50k byte-level vocabulary installed beside the libraries."""
    import public_tokenizers as public

    return Encoder(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
