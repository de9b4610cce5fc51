"""Byte-pair merging over ragged numpy arrays, shared by counting and encoding.

A vocabulary is a table of mergeable symbol pairs: key ``left * size + right``,
rank, and the symbol the pair becomes. ``merge`` holds many sequences in one
flat array and, round by round, replaces in each sequence every occurrence of
that sequence's lowest-ranked pair.
"""

from __future__ import annotations

import base64
import json

import numpy as np

# The printable stand-ins of the 256 bytes in byte-level vocabularies.
PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]


def byte_of_char() -> dict[str, int]:
    """Each stand-in character's byte: printable ones stand for themselves, the
    others follow from 256 on in byte order."""
    out = {chr(b): b for b in PRINTABLE}
    for i, b in enumerate(b for b in range(256) if b not in set(PRINTABLE)):
        out[chr(256 + i)] = b
    return out


class Vocabulary:
    def __init__(self, token_bytes: dict[int, bytes], pairs: list[tuple[int, int, int, int]]):
        """``pairs``: (left, right, rank, merged); the lowest rank of a pair counts."""
        self.token_bytes = token_bytes
        self.size = max(token_bytes) + 1
        table = np.array(pairs, np.int64).reshape(-1, 4)
        keys = table[:, 0] * self.size + table[:, 1]
        order = np.lexsort((table[:, 2], keys))
        keys, first = np.unique(keys[order], return_index=True)
        self.keys, self.ranks, self.merged = keys, table[order][first, 2], table[order][first, 3]
        self.byte_ids = np.zeros(256, np.int64)
        for i, b in token_bytes.items():
            if len(b) == 1:
                self.byte_ids[b[0]] = i
        self.id_of = {b: i for i, b in token_bytes.items()}

    @classmethod
    def from_json(cls, data: bytes) -> Vocabulary:
        """A byte-level BPE file of the tokenizers library: pairs are its merge list."""
        model, chars = json.loads(data)["model"], byte_of_char()
        vocab = model["vocab"]
        pairs = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            pairs.append((vocab[a], vocab[b], rank, vocab[a + b]))
        tokens = {i: bytes(chars[c] for c in t) for t, i in vocab.items() if all(c in chars for c in t)}
        return cls(tokens, pairs)

    @classmethod
    def from_ranks(cls, data: bytes) -> Vocabulary:
        """A rank file: two tokens merge if their joined bytes are a token; its rank decides."""
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line)}
        pairs = [(ranks[t[:i]], ranks[t[i:]], r, r) for t, r in ranks.items() for i in range(1, len(t))
                 if t[:i] in ranks and t[i:] in ranks]
        return cls({r: t for t, r in ranks.items()}, pairs)

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Table place and whether the key is there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return at, self.keys[at] == keys

    def merge(self, items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of every item, flat, and how many each has."""
        lengths = np.fromiter(map(len, items), np.int64, len(items))
        symbols = self.byte_ids[np.frombuffer(b"".join(items), np.uint8)]
        owner = np.repeat(np.arange(len(items)), lengths)
        place = np.arange(len(symbols))  # keeps finished symbols in text order
        none = np.iinfo(np.int64).max
        done_symbols, done_owner, done_place = [], [], []
        while len(symbols):
            inside = owner[1:] == owner[:-1]
            at, known = self.lookup(symbols[:-1] * self.size + symbols[1:])
            rank = np.full(len(symbols), none)
            rank[:-1] = np.where(known & inside, self.ranks[at], none) if len(self.ranks) else none
            heads = np.flatnonzero(np.concatenate([[True], ~inside]))
            best = np.minimum.reduceat(rank, heads)
            best = np.repeat(best, np.diff(np.append(heads, len(symbols))))
            over = best == none  # whole sequences without a mergeable pair
            if over.any():
                done_symbols.append(symbols[over])
                done_owner.append(owner[over])
                done_place.append(place[over])
                live = ~over
                symbols, owner, place, rank, best = (x[live] for x in (symbols, owner, place, rank, best))
                if not len(symbols):
                    break
                at = np.append(at, 0)[live]
            else:
                at = np.append(at, 0)
            hit = rank == best
            # of overlapping occurrences (runs of hits) every other one merges, from the left
            index = np.arange(len(hit))
            start = hit & ~np.concatenate([[False], hit[:-1]])
            run = index - np.maximum.accumulate(np.where(start, index, 0))
            hit &= run % 2 == 0
            symbols = np.where(hit, self.merged[at], symbols)
            stay = ~np.concatenate([[False], hit[:-1]])
            symbols, owner, place = symbols[stay], owner[stay], place[stay]
        if not done_symbols:
            return np.zeros(0, np.int64), np.zeros(len(items), np.int64)
        order = np.argsort(np.concatenate(done_place), kind="stable")
        return (np.concatenate(done_symbols)[order],
                np.bincount(np.concatenate(done_owner), minlength=len(items)))
