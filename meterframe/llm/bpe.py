"""Byte-pair merging over the merge list of a tokenizer file.

Shared by the token counter and the encoder. A file is read on the driver (its path is a
parameter) and broadcast as parsed JSON text, whose size is that of the vocabulary file and
does not depend on the data.
"""

from __future__ import annotations

import heapq
import json
from functools import cached_property

# Words of more symbols than this are merged with a heap, in n log n steps.
HEAP_FROM = 48
SHIFT = 20


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Fixed rule of the file format: bytes that print keep their character, the others take
    the characters from 256 upwards in order.
    """
    printable = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    alphabet, free = [], 256
    for byte in range(256):
        if byte in printable:
            alphabet.append(chr(byte))
        else:
            alphabet.append(chr(free))
            free += 1
    return alphabet


class Vocabulary:
    """Merge list, ids and special tokens of one tokenizer file.

    Symbols are token ids. `pairs` maps a pair of ids, packed into one integer, to rank and
    merged id, packed likewise, so that the smallest value is the earliest merge.
    """

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        self.ids = ids
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.decoder: str | None = (spec.get("decoder") or {}).get("type")
        alphabet = byte_alphabet()
        self.inner = [ids[c] for c in alphabet]
        self.last = [ids[c + self.suffix] for c in alphabet]
        self.rules: list[tuple[int, int, int]] = []
        self.pairs: dict[int, int] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            merged = left[: len(left) - len(self.suffix)] if self.suffix and left.endswith(self.suffix) else left
            rule = (ids[left], ids[right], ids[merged + right])
            self.rules.append(rule)
            self.pairs.setdefault(rule[0] << SHIFT | rule[1], rank << SHIFT | rule[2])

    @cached_property
    def strings(self) -> dict[int, str]:
        return {i: s for s, i in [*self.ids.items(), *self.special.items()]}

    @cached_property
    def bytes_of(self) -> dict[str, int]:
        """The byte that each character of the byte alphabet stands for."""
        return {c: b for b, c in enumerate(byte_alphabet())}

    @cached_property
    def widths(self) -> dict[int, int]:
        """Base symbols per token."""
        cut = len(self.suffix)
        return {i: len(s) - (cut if cut and s.endswith(self.suffix) else 0) for s, i in self.ids.items()}

    def symbols(self, word: bytes) -> list[int]:
        """Base symbols of a whole pre-token; the last one carries the end-of-word suffix."""
        inner = self.inner
        result = [inner[b] for b in word]
        if result:
            result[-1] = self.last[word[-1]]
        return result

    def merge(self, symbols: list[int]) -> list[int]:
        """Applies the earliest merge, leftmost first, until none applies."""
        if len(symbols) > HEAP_FROM:
            return self._merge_heap(symbols)
        symbols = list(symbols)
        get = self.pairs.get
        none = 1 << 62
        scores = [get(a << SHIFT | b, none) for a, b in zip(symbols, symbols[1:])]
        while scores:
            best = min(scores)
            if best == none:
                break
            at = scores.index(best)
            new = best & ((1 << SHIFT) - 1)
            symbols[at : at + 2] = [new]
            del scores[at]
            if at:
                scores[at - 1] = get(symbols[at - 1] << SHIFT | new, none)
            if at < len(scores):
                scores[at] = get(new << SHIFT | symbols[at + 1], none)
        return symbols

    def _merge_heap(self, symbols: list[int]) -> list[int]:
        count = len(symbols)
        value = list(symbols)
        after = list(range(1, count + 1))
        before = list(range(-1, count - 1))
        get = self.pairs.get
        queue = []
        for at in range(count - 1):
            hit = get(value[at] << SHIFT | value[at + 1])
            if hit is not None:
                queue.append((hit >> SHIFT, at, hit))
        heapq.heapify(queue)
        while queue:
            _, at, hit = heapq.heappop(queue)
            right = after[at] if value[at] >= 0 else count
            if right >= count or get(value[at] << SHIFT | value[right]) != hit:
                continue
            new = hit & ((1 << SHIFT) - 1)
            value[at], value[right] = new, -1
            after[at] = after[right]
            if after[at] < count:
                before[after[at]] = at
                follow = get(new << SHIFT | value[after[at]])
                if follow is not None:
                    heapq.heappush(queue, (follow >> SHIFT, at, follow))
            if before[at] >= 0:
                lead = get(value[before[at]] << SHIFT | new)
                if lead is not None:
                    heapq.heappush(queue, (lead >> SHIFT, before[at], lead))
        return [v for v in value if v >= 0]

    @cached_property
    def lookahead(self) -> int:
        """Symbols after which the tokens of a prefix can no longer change.

        Compare the merging of two texts with a common prefix. Their token sequences agree up
        to a frontier that starts at the prefix's end and moves left over token `p` only when
        a rule (p, q) joins p to something that differs. The next such rule must come later in
        the list, and its right part must begin with p (be p, or a token that p has grown into
        as its first part). So the frontier's way is a path over rules of increasing rank;
        the longest one, measured in symbols, is found in one pass over the list.
        """
        firsts: dict[int, list[int]] = {}
        made: dict[int, int] = {}
        for left, _, new in self.rules:
            made.setdefault(new, left)

        def spine(token: int) -> list[int]:
            if token not in firsts:
                chain, at = [token], token
                while at in made:
                    at = made[at]
                    chain.append(at)
                firsts[token] = chain
            return firsts[token]

        best: dict[int, int] = {}
        longest = 0
        for left, right, _ in self.rules:
            reach = self.widths[left] + max((best.get(t, 0) for t in spine(right)), default=0)
            best[left] = max(best.get(left, 0), reach)
            longest = max(longest, reach)
        return longest


class Memo(dict):
    """A bounded memo of two generations: what was used since the last turn survives it.

    `make` computes a missing value; keys longer than `longest` are computed anew each time.
    """

    def __init__(self, make, size: int, longest: int):
        super().__init__()
        self.make, self.size, self.longest = make, size, longest
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


_LOADED: dict[int, Vocabulary] = {}


def vocabulary(text: str) -> Vocabulary:
    """The parsed file, kept per process."""
    key = hash(text)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(text)
    return _LOADED[key]


def read_file(path: str) -> str:
    """The tokenizer file's text; its size is fixed by the vocabulary."""
    with open(path, encoding="utf-8") as source:
        return source.read()


def split_special(text: str, special: dict[str, int]) -> list[tuple[str, int | None]]:
    """The text cut at special strings: (piece, None) for text, (string, id) for specials."""
    if not any(s in text for s in special):
        return [(text, None)]
    pieces: list[tuple[str, int | None]] = []
    at = 0
    while at < len(text):
        hits = [(text.find(s, at), -len(s), s) for s in special]
        hits = [h for h in hits if h[0] >= 0]
        if not hits:
            break
        start, _, found = min(hits)
        if start > at:
            pieces.append((text[at:start], None))
        pieces.append((found, special[found]))
        at = start + len(found)
    if at < len(text):
        pieces.append((text[at:], None))
    return pieces
