"""Token ids of whole texts, each distinct word encoded once.

Neither public tokenizer lets a token reach from a non-space character into the white space after it, so a text can be
cut before each white-space run and the pieces encoded apart. ``WordEncoder`` keeps the result for pieces already
seen; it is a bounded memo around the library, not a tokenizer. Where a file of the same vocabulary's byte-level ranks is
given, new pieces go through ``tiktoken``, which encodes many in one call; ids are those of ``tokenizers`` all the same,
and tests hold both against it text by text, on random Unicode too. Null texts are up to the callers; an empty text
has no ids; odd white space and special strings send a text to the library whole.
"""

from __future__ import annotations

import base64
import re
from array import array
from hashlib import sha256

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: A run of ASCII white space with the word after it, or the white space that ends a text.
PIECES = re.compile(rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+").findall
WHITE_BYTES = frozenset(b" \t\n\x0b\x0c\r")
# Fixed value: how byte-level vocabularies split a text into words.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Other characters that the tokenizers' own \s may take for white space: such texts are encoded whole.
ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]").search


class WordEncoder:
    """Encodes texts with a ``tokenizers`` file; ``limit`` bounds the memo's entries.

    Counts are small numbers, so four times as many words have theirs kept as have their ids, and as many of before.

    ``ranks`` may name the same vocabulary as a file of byte-level ranks. New words are then encoded through it, many
    in one call, and told apart by the byte lengths of their tokens; it has no special tokens, so texts that hold one
    go to ``tokenizers`` whole, as those with odd white space do.
    """

    def __init__(self, path: str, limit: int = 100_000, ranks: str | None = None):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.limit = limit
        self.ids: dict[bytes, bytes] = {}
        self.counts: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}
        self.ranked = None
        if ranks:
            with open(ranks, "rb") as f:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.ranked = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=table, special_tokens={})
            self.lengths = np.zeros(max(table.values()) + 1, dtype=np.int64)
            for token, rank in table.items():
                self.lengths[rank] = len(token)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)").search

    def _encode(self, pieces: list[bytes]):
        encoded = self.tokenizer.encode_batch([p.decode() for p in pieces], add_special_tokens=False)
        return (e.ids for e in encoded)

    def _learn(self, missing: set[bytes]) -> None:
        """Put the ids of new pieces into the memo."""
        if self.ranked is None:
            pieces = list(missing)
            self.ids.update(zip(pieces, (array("I", x).tobytes() for x in self._encode(pieces)), strict=True))
            return
        # Pieces that begin with white space and end without are as independent in a row as they are in a text.
        joined = [p for p in missing if p[0] in WHITE_BYTES and p[-1] not in WHITE_BYTES]
        for p in missing.difference(joined):
            self.ids[p] = array("I", self.ranked.encode_ordinary(p.decode())).tobytes()
        if joined:
            ids = np.array(self.ranked.encode_ordinary(b"".join(joined).decode()), dtype="<u4")
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(p) for p in joined])) + 1
            raw, at = ids.tobytes(), 0
            for p, end in zip(joined, (4 * ends).tolist(), strict=True):
                self.ids[p] = raw[at:end]
                at = end

    def ids_of(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if ODD_SPACE(text) or self.special(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        pieces, memo = PIECES(text.encode()), self.ids
        if missing := set(pieces).difference(memo):
            if len(memo) + len(missing) > self.limit:
                memo.clear()
                missing = set(pieces)
            self._learn(missing)
        return b"".join(map(memo.__getitem__, pieces))

    def _lengths(self, pieces: list[bytes]) -> list[int]:
        """The number of ids of each word: the words are encoded in one call and told apart by where their tokens begin."""
        words = [p.decode() for p in pieces]
        joined = " ".join(words)
        if self.special(joined):
            return [len(ids) for ids in self._encode(pieces)]
        begin = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
        at = np.array([a for a, _ in self.tokenizer.encode(joined, add_special_tokens=False).offsets], dtype=np.int64)
        return np.bincount(np.searchsorted(begin, at, side="right") - 1, minlength=len(words)).tolist()

    def count(self, text: str) -> int:
        """The number of ids; for tokenizers that drop white space, so that words count apart.

        A full memo is set aside, and words found in it move to the new one; only those of two memos ago are forgotten.
        """
        if ODD_SPACE(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        pieces = text.encode().split()
        if missing := [p for p in set(pieces) if p not in self.counts]:
            if len(self.counts) + len(missing) > 4 * self.limit:
                self.older, self.counts = self.counts, {}
                missing = list(set(pieces))
            known = {p: self.older[p] for p in missing if p in self.older}
            self.counts.update(known)
            if new := [p for p in missing if p not in known]:
                self.counts.update(zip(new, self._lengths(new), strict=True))
        return sum(map(self.counts.__getitem__, pieces))


_ENCODERS: dict[tuple[str, str | None], WordEncoder] = {}


def encoder(path: str, ranks: str | None = None) -> WordEncoder:
    """This worker's encoder for a file, loaded once."""
    if (path, ranks) not in _ENCODERS:
        _ENCODERS[path, ranks] = WordEncoder(path, ranks=ranks)
    return _ENCODERS[path, ranks]


def version_of(path: str) -> str:
    """A digest of the tokenizer file."""
    with open(path, "rb") as f:
        return sha256(f.read()).hexdigest()
