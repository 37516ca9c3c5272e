"""Byte-pair encoding as a transducer that is compiled from the merges and made deterministic while it runs.

A sequence of tokens is the encoding of its bytes exactly if every two neighbours are the encoding of their own bytes
together. So a nondeterministic machine can read bytes along a trie of the vocabulary, guess where a token ends, and
check each guess against the token before. Its deterministic form is built on demand: a state is the set of places
where the machine may be, each with the tokens it guessed but that not all places share. What all places share is
emitted at once; since no token is longer than the longest of the vocabulary, that look-ahead is bounded. A piece of
text without any boundary, however long, takes time in proportion to its length.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator

import regex

#: How a text is cut before pairs merge (fixed value of the public vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: States, checked pairs and remembered pieces that a worker keeps before it starts afresh.
KEPT_STATES = 200_000
KEPT_PAIRS = 1_000_000
KEPT_PIECES = 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens by rank from a file of base64 tokens and ranks, one pair a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The encoding of a short piece by its definition: merge the lowest-ranked pair until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Bytes of one piece to tokens, left to right."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        # The trie: for a node its children by byte, and the token that ends there.
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                if (after := self.children[node].get(byte)) is None:
                    after = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                node = after
            self.ends[node] = rank
        self.usable: dict[int, bool] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((-1, 0, ()),)
        self.numbers = {start: 0}
        self.states = [start]
        self.arcs: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def _fits(self, before: int, token: int) -> bool:
        """Whether token may follow: both together, or token at the start of a piece, encode as they are."""
        if before < 0:
            known = self.usable.get(token)
            if known is None:
                known = self.usable[token] = merge_pairs(self.tokens[token], self.ranks) == [token]
            return known
        known = self.pairs.get((before, token))
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[before, token] = self._fits(-1, token) and merge_pairs(self.tokens[before] + self.tokens[token], self.ranks) == [before, token]
        return known

    def _step(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Build the arc: move all places, close finished tokens, emit what all places share."""
        places = []
        for before, node, open_tokens in self.states[number]:
            after = self.children[node].get(byte)
            if after is None:
                continue
            if self.children[after]:
                places.append((before, after, open_tokens))
            token = self.ends[after]
            if token >= 0 and self._fits(before, token):
                places.append((token, 0, (*open_tokens, token)))
        shared = 0
        if places:
            first = min((p[2] for p in places), key=len)
            while shared < len(first) and all(p[2][shared] == first[shared] for p in places):
                shared += 1
            emitted = first[:shared]
        else:
            emitted = ()
        state = tuple(sorted((b, n, t[shared:]) for b, n, t in places))
        to = self.numbers.get(state)
        if to is None:
            to = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.arcs.append({})
        arc = self.arcs[number][byte] = (to, emitted)
        return arc

    def run(self, piece: bytes) -> list[int]:
        """The tokens of a piece."""
        if len(self.states) > KEPT_STATES:
            self._reset()
        state, out, arcs = 0, [], self.arcs
        for byte in piece:
            arc = arcs[state].get(byte)
            if arc is None:
                arc = self._step(state, byte)
            state, emitted = arc
            if emitted:
                out.extend(emitted)
        for _, node, open_tokens in self.states[state]:
            if node == 0:  # the one place where a token has just ended
                out.extend(open_tokens)
                return out
        return out


class Encoder:
    """Texts to ids: cut into pieces, run the transducer on each; frequent pieces are remembered."""

    def __init__(self, path: str):
        self.transducer = Transducer(load_ranks(path))
        self.cut = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text without special tokens; none for null and for the empty text.

        What looks like a special token is ordinary text. A lone surrogate counts as U+FFFD.
        """
        out: list[int] = []
        known, run = self.known, self.transducer.run
        for piece in self.cut(text or ""):
            ids = known.get(piece)
            if ids is None:
                try:
                    data = piece.encode()
                except UnicodeEncodeError:
                    data = piece.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode()
                ids = run(data)
                if len(piece) <= 64:
                    if len(known) >= KEPT_PIECES:
                        known.clear()
                    known[piece] = ids
            out.extend(ids)
        return out

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """The text of the ids token by token; bytes of an unfinished character wait for the rest.

        Malformed bytes give U+FFFD; an unknown id is an error.
        """
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        tokens = self.transducer.tokens
        for i in ids:
            if text := machine.decode(tokens[i]):
                yield text
        if text := machine.decode(b"", True):
            yield text


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, made once per worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
