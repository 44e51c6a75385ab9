"""Token ids of a byte-level BPE file."""

from __future__ import annotations

import json
import struct
from functools import partial

#: The pre-tokenizer's pattern of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PROBE = "Zwei  Wörter, it's 12\n\té <|endoftext|> x"


def _byte_characters() -> dict[str, int]:
    """The character that stands for each byte in such a file: itself where it is visible
    Latin-1, else the next one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """Ids as little-endian unsigned 32-bit bytes, equal to those of the tokenizers library.

    The library itself takes about five times the CPU seconds for the same ids; so its file
    is loaded into the other installed encoder of such vocabularies. Strings of the file's
    added tokens in a text get their own ids if ``special``, which is the library's default,
    and are ordinary text otherwise. A probe text must get the library's ids.
    """

    def __init__(self, path: str, special: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        added = {token["content"]: token["id"] for token in content["added_tokens"]}
        byte = _byte_characters()
        ranks = {
            bytes(byte[c] for c in token): rank
            for token, rank in content["model"]["vocab"].items()
            if token not in added
        }
        encoding = tiktoken.Encoding(
            path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added if special else {}
        )
        self._encode = partial(encoding.encode, allowed_special="all") if special else encoding.encode_ordinary
        library = Tokenizer.from_file(path)
        library.encode_special_tokens = not special
        probe = PROBE + "".join(f" {token} x{token}" for token in added)
        ids = library.encode(probe, add_special_tokens=False).ids
        if self.encode(probe) != struct.pack(f"<{len(ids)}I", *ids):
            raise ValueError(f"{path} is not a byte-level BPE file with ranks as ids")

    def encode(self, text: str) -> bytes:
        ids = self._encode(text)
        return struct.pack(f"<{len(ids)}I", *ids)
