"""Token ids of a byte-level BPE vocabulary, with words remembered.

The vocabulary splits a text in front of every space that precedes a character other than white space, whatever stands
around it, so such pieces are encoded on their own and remembered as packed ids. A miss is encoded by the faster of two
libraries that read the same vocabulary (tests compare them over whole tables); pieces that could hold a special string
always go to the one that defines them.
"""

from __future__ import annotations

import base64
import os
import re
from array import array

from .workers import Memo, once_per_worker

ID_BYTES = 4
LONG_PIECE = 64
SAFE_CUT = re.compile(r"(?= \S)")


class ByteEncoder:
    """Ids as unsigned little-endian 32-bit numbers, without special tokens added; special strings in texts as the
    vocabulary file has them, or plain text with `plain`. `ranks_path` names the same vocabulary as ranks; without it every
    miss goes to the first library."""

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = plain
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding(
                os.path.basename(ranks_path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
            )
        self.spaced = Memo(self._after_space)
        self.plain = Memo(self._piece, 50_000)

    def _piece(self, piece: str) -> bytes:
        if self.fast is None or "<|" in piece:
            ids = self.whole.encode(piece, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(piece)
        packed = array("I", ids)
        return packed.tobytes()

    def _after_space(self, piece: str) -> bytes:
        if not piece or piece[0].isspace():
            raise _NotAlone
        return self._piece(" " + piece)

    def encode(self, text: str) -> bytes:
        head, *rest = text.split(" ")
        try:
            tail = b"".join(map(self.spaced.__getitem__, rest))
        except _NotAlone:
            pieces = SAFE_CUT.split(text)
            return b"".join([self.plain[p] if len(p) <= LONG_PIECE else self._piece(p) for p in pieces])
        if not head:
            return tail
        return (self.plain[head] if len(head) <= LONG_PIECE else self._piece(head)) + tail


class _NotAlone(Exception):
    """A piece between spaces that cannot be encoded on its own."""


def byte_encoder(path: str, ranks_path: str | None = None, pattern: str | None = None) -> ByteEncoder:
    """The encoder of this worker."""
    return once_per_worker(("byte encoder", path, ranks_path), lambda: ByteEncoder(path, ranks_path, pattern))
