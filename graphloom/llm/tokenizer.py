"""Byte-level BPE, encoding in linear time and decoding; and piece-wise tokenizers.

The vocabulary's bytes are mapped to Latin-1 text for a pyahocorasick automaton.  A piece
is encoded left to right from the longest token at each place; a token may follow another
only if the two would not have merged differently across their border (memoised), else
the next shorter token is tried, else the last token is taken back.  A dead place is
never tried twice, so the work is linear in the piece.
"""

from __future__ import annotations

import base64
import re

import ahocorasick
import regex

_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\t-\r \x85\xa0"
#: The usual byte-level split, for texts below U+0250; the general pattern does the rest.
_SPLIT = re.compile(
    rf" ?[{_L}]+|[^{_S}{_L}{_N}'][^{_S}{_L}{_N}]*| [^{_S}{_L}{_N}]+|'(?:[stmd]|re|ve|ll)|'[^{_S}{_L}{_N}]*| ?[{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
)
_BEYOND = re.compile("[^\x00-ɏ]")
#: The pattern for which _SPLIT stands in; fixed value, as the vocabularies' users give it.
USUAL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Splitter:
    """All matches of a pattern, in order; the usual pattern has a fast path."""

    def __init__(self, pattern: str = USUAL_PATTERN):
        self.general = regex.compile(pattern)
        self.usual = pattern == USUAL_PATTERN

    def __call__(self, text: str) -> list[str]:
        if self.usual and not _BEYOND.search(text):
            return _SPLIT.findall(text)
        return self.general.findall(text)


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class BytePairEncoder:
    """Exact merges by rank; `encode_piece` for a piece's bytes, `decode` for ids.

    Ranks must be in merge order and hold all 256 single bytes.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        self.bytes = {i: t for t, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}  # the longest token that is a proper prefix, or -1
        self.parts: dict[int, tuple[int, int]] = {}  # the two tokens that merge last; itself twice if none
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.ready = False
        for i, token in self.bytes.items():
            self.shorter[i] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), -1)
        for i, token in sorted(self.bytes.items()):
            halves = self._encode(token, below=i) if len(token) > 1 else []
            if len(halves) == 2:
                self.parts[i] = (halves[0], halves[1])
                self.merged[halves[0], halves[1]] = i
            else:
                self.parts[i] = (i, i)
        self.ready = True

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank would keep the border between two tokens."""
        most = 1 << 40
        while True:
            whole = self.merged.get((left, right))
            if whole is not None and whole < most:
                return False
            if left > right:
                most = left
                left = self.parts[left][1]
                if left != most:
                    continue
                most, right = right + 1, self.parts[right][0]
                if right + 1 == most:
                    return True
            else:
                most = right + 1
                right = self.parts[right][0]
                if right + 1 != most:
                    continue
                most, left = left, self.parts[left][1]
                if left == most:
                    return True

    def _encode(self, piece: bytes, below: int = 1 << 40) -> list[int]:
        longest = [-1] * len(piece)
        for end, (n, i) in self.automaton.iter(piece.decode("latin-1")):
            if i < below:
                longest[end - n + 1] = i  # later ends are longer
        size, out, at = len(piece), [], 0
        dead = bytearray(size + 1)
        token = longest[0] if size else -1
        lengths, fits = self.bytes, self.fits
        while at < size:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + len(lengths[token])
                if token < below and not dead[end]:
                    if last < 0:
                        break
                    fit = fits.get((last, token))
                    if fit is None:
                        fit = self._compatible(last, token)
                        if self.ready:  # before that, later merges can still change it
                            if len(fits) > 1_000_000:
                                fits.clear()
                            fits[last, token] = fit
                    if fit:
                        break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < size else -1
            else:
                dead[at] = 1
                if not out:
                    return []  # only below a rank: no encoding
                token = out.pop()
                at -= len(lengths[token])
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ids.get(piece)
        return [whole] if whole is not None else self._encode(piece)

    def decode(self, ids) -> bytes:
        table = self.bytes
        return b"".join([table[i] for i in ids])


class PieceCache(dict):
    """piece -> value, made on a miss; emptied when it holds `most` pieces or a long one is due."""

    def __init__(self, make, most: int = 600_000, longest: int = 256):
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, piece: str):
        value = self.make(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[piece] = value
        return value
