"""Language-model scores by logistic mixing of context bit predictors.

A text is a sequence of bytes between two boundary symbols, and a byte is eight binary
decisions. A predictor counts zeros and ones per (context, bits of the byte so far);
the contexts are the last 1 to 5 bytes and the word so far, hashed. The predictors' log odds are
added up with weights; which set of weights is used is gated by the bit's position and by how much
the two longest contexts have seen. The weights are learned online, and a last adaptive table
refines the mixed probability. The sum of all decisions is the text's total bits.

The counts come from all training texts. They are gathered as counts of keys: the last five bytes, the
byte itself, and a hash of what else the word context holds, which together give the counts of all
predictors. The count table is as long as the corpus needs; two word contexts share an entry only if
they end in the same five bytes and their hashes collide. Grams that share their last three context
bytes form a part, which has all counts of the orders 3 to 5 and of the words for them; those of the
orders 1 and 2 are shared. Each gram is weighted by its count and predicted from the counts without one
occurrence of itself. All parts learn at once from the same weights, the executors add up what they
learned, and rounds repeat until the cost settles. Scoring uses the frozen model, so that a text's
score does not depend on the other texts in its task. A byte's cost depends on its key alone: each
distinct key is costed once, frequent ones are looked up where the texts are, and the others go to
a join.

Grams travel as sorted arrays, many in a row of a table, compressed: by shares of the contexts while they
are counted, by parts afterwards.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.llm.common import ROW, doc_remainder, map_batches, parallelism, with_row
from meterframe.session import materialize

FOLDS, HELD_OUT = 7, 2
BOUNDARY = 0xFF  # never a byte of UTF-8
ORDERS = 5
GRAM = ORDERS + 1  # the longest plain context and the byte itself
WORD_BYTES = 12  # the longest word context
WORD_LEAST = 3  # the shortest: these bytes decide in which part a gram is counted
HASH_BITS = 15  # of what a word context holds beyond the plain ones
PREDICTORS = ORDERS + 1
INPUTS = PREDICTORS + 1  # the last one is constant
LOW_ORDERS = 2  # shared by all tasks: at most 2 ** 24 different three-byte grams
PART_GRAMS = 50_000
PARTS = 4  # that a task writes
HEAD_GRAMS = 1 << 21
HELD = np.uint64(1 << 63)  # marks the grams of texts that are not learned from
BIT_GATES = 4 * 4
GATES = 8 * BIT_GATES
BUCKETS = 33
DELTA = 0.05
PRIOR = 20.0  # what the weights so far count, in decisions, when a part goes on from them
LONGEST_STEP = 0.5
ROUNDS, SETTLED = 4, 0.005
BATCH = 4096
MEMO_BITS = 22
HEAD_BITS = 21
PASS = 1 << 17
PENDING = 4_000_000  # grams that a task collects before it counts them
DISTINCT = 4_000_000  # counted ones it keeps at most before it merges and hands them on, besides those
LOOKED_UP = 1 << 17  # grams whose predictors are worked out together
SHARES = 1024  # of the contexts, words and partitions: as many packs are made at once at most
RARE = 1_000_000  # grams without a known cost that a task collects before it hands them on
TOKENS = 5_000_000  # words that a task collects before it counts them
HEAD_WORDS = 100_000
END = b" "  # the end token's key; no word holds a space
WORD_KIND, GRAM_KIND = 0, 1
# Fixed value: the multiplier of the hash.
PRIME = np.uint64(0x9E3779B97F4A7C15)
FACTORS = np.random.default_rng(0).integers(1, 1 << 63, 64, dtype=np.uint64)  # by place in a word
PLAIN = np.uint64((1 << (8 * GRAM)) - 1)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[*b" \t\n\v\f\r", BOUNDARY]] = True
CASE = 0x20  # a small letter has this bit more than its capital
LATIN = 0xC3  # first byte of the letters from U+00C0 on, whose capitals go on with 0x80 to 0x9E


def gram_keys(data: bytes) -> np.ndarray:
    """The grams that end at each byte and at the end boundary, as 63-bit numbers.

    The low 48 bits are the byte and the five before it. Where the word so far, with the white
    space before it, is longer than those five, the upper 15 bits are a hash of the rest (up to
    `WORD_BYTES`).
    """
    return np.concatenate(list(gram_pieces(data)))


def gram_pieces(data: bytes) -> Iterator[np.ndarray]:
    """The grams of a text, at most `PASS` at a time."""
    before = WORD_BYTES + 1  # one more tells whether the first of them is half a letter
    padded = np.frombuffer(b"\xff" * before + data + b"\xff", np.uint8)
    for start in range(0, len(data) + 1, PASS):
        yield _window_keys(padded[start : start + before + PASS], before)


def joined_grams(data: list[bytes]) -> Iterator[tuple[np.ndarray, list[int], np.ndarray]]:
    """(grams, which texts they are of, where each of these begins): short texts share a pass, long ones are cut."""
    before = WORD_BYTES + 1
    some: list[int] = []
    size = 0

    def settle() -> tuple[np.ndarray, list[int], np.ndarray]:
        gap = b"\xff" * before
        window = np.frombuffer(gap + gap.join([data[i] for i in some]) + b"\xff", np.uint8)
        runs = np.full((len(some), 2), before - 1)
        runs[:, 0] = [len(data[i]) + 1 for i in some]
        own = np.repeat(np.tile([True, False], len(some)), runs.ravel())[: len(window) - before]
        return _window_keys(window, before)[own], list(some), np.cumsum(runs[:, 0]) - runs[:, 0]

    for i, text in enumerate(data):
        if len(text) >= PASS:
            for keys in gram_pieces(text):
                yield keys, [i], np.zeros(1, np.int64)
            continue
        if some and size + len(text) >= PASS:
            yield settle()
            some.clear()
            size = 0
        some.append(i)
        size += len(text) + before
    if some:
        yield settle()


def _window_keys(window: np.ndarray, before: int) -> np.ndarray:
    """The grams that end at each byte of `window` but the first `before`."""
    count = len(window) - before
    eight = np.ndarray(count, ">u8", window, before - 7, (1,))  # the byte and the seven before it
    key = eight.astype(np.uint64) & PLAIN
    latin = np.concatenate(([False], window[:-1] == LATIN))
    small = window + np.uint8(CASE) * folds(window, latin)
    place = np.arange(len(window), dtype=np.int32)
    length = place - np.maximum.accumulate(np.where(separates(window), place, np.int32(0)))
    length = length[before - 1 : before - 1 + count]
    long = np.flatnonzero(length >= ORDERS)
    length, rest = length[long] + 1, np.zeros(len(long), np.uint64)
    live, at = np.arange(len(long)), long + before
    for back in range(ORDERS + 1, WORD_BYTES + 1):
        mixed = (rest[live] + small[at - back] + np.uint64(1)) * PRIME
        rest[live] = mixed ^ (mixed >> np.uint64(29))
        further = length[live] > back
        live, at = live[further], at[further]
    key[long] |= ((rest * PRIME) >> np.uint64(64 - HASH_BITS)) << np.uint64(8 * GRAM)
    return key


def separates(byte: np.ndarray) -> np.ndarray:
    return (byte == 0x20) | (byte - np.uint8(9) < 5) | (byte == BOUNDARY)


def folds(byte: np.ndarray, latin: np.ndarray) -> np.ndarray:
    """Which bytes belong to a capital letter; `latin`: whether the byte before is `LATIN`."""
    return (byte - np.uint8(65) < 26) | (latin & (byte >= 0x80) & (byte <= 0x9E))


class Counts:
    """How often keys occur, for ranges of keys: sorted distinct keys and running sums."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
        sums = np.add.reduceat(counts[order], starts) if len(starts) else counts
        self.keys, self.sums = keys[starts], np.concatenate((np.zeros(1, np.int64), np.cumsum(sums, dtype=np.int64)))

    def below(self, key: np.ndarray) -> np.ndarray:
        return self.sums[np.searchsorted(self.keys, key)]

    def totals(self, key: np.ndarray) -> np.ndarray:
        """For sorted distinct keys, by b: how often their contexts occur before the first b bits of their last bytes."""
        found = np.empty((9, len(key)))
        own = len(key) == len(self.keys) and np.array_equal(key, self.keys)
        apart = key[1:] ^ key[:-1]
        for bits in range(9):
            shift = np.uint64(8 - bits)
            starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), (apart >> shift) > 0)))
            bounds = np.concatenate((starts, [len(key)]))
            if own:
                sums = np.diff(self.sums[bounds])
            else:
                first = (key[starts] >> shift) << shift
                last = first + (np.uint64(1) << shift) - np.uint64(1)
                sums = self.sums[np.searchsorted(self.keys, last, "right")] - self.below(first)
            found[bits] = np.repeat(sums, np.diff(bounds))
        return found

    def branches(self, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each bit of the keys' last byte: zeros and ones after the bits before it."""
        first = key & ~np.uint64(0xFF)
        low, high = self.below(first), self.below(first + np.uint64(0x100))
        for bit in range(8):
            shift, half = np.uint64(8 - bit), np.uint64(1 << (7 - bit))
            middle = self.below(((key >> shift) << shift) + half)
            yield (middle - low).astype(np.float64), (high - middle).astype(np.float64)
            one = (key & half) > 0
            low, high = np.where(one, middle, low), np.where(one, high, middle)


def of_order(key: np.ndarray, order: int) -> np.ndarray:
    """The context of a predictor and the byte itself: the last `order + 1` bytes, or the word's."""
    if order < ORDERS:
        return key & np.uint64((1 << (8 * (order + 2))) - 1)
    context = [((key >> np.uint64(8 * back)) & np.uint64(0xFF)).astype(np.uint8) for back in range(ORDERS + 1)]
    folded = key.copy()
    for back in range(1, ORDERS + 1):
        latin = context[back + 1] == LATIN if back < ORDERS else np.zeros(len(key), bool)
        folded += folds(context[back], latin).astype(np.uint64) * np.uint64(CASE << (8 * back))
    mask = np.full(len(key), (1 << 64) - 1, np.uint64)
    for length in range(ORDERS, 0, -1):
        mask[SEPARATOR[context[length]]] = (1 << (8 * (max(length, WORD_LEAST) + 1))) - 1
    return folded & mask


def squash(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


Shorts = list[tuple[np.ndarray, np.ndarray]]


def shorts_of(key: np.ndarray) -> Shorts:
    """Per predictor the different contexts and bytes, sorted, and which of them each gram has."""
    return [np.unique(of_order(key, order), return_inverse=True) for order in range(PREDICTORS)]


class Seen:
    """What the predictors say about grams: worked out once per different context and byte, then looked up."""

    def __init__(self, counts: list[Counts], key: np.ndarray, left_out: bool, shorts: Shorts | None = None):
        self.key = key
        self.back, self.odds, self.levels = [], [], []
        for order, (own, (short, back)) in enumerate(zip(counts, shorts or shorts_of(key))):
            totals = own.totals(short)
            taken, other = totals[1:], totals[:-1] - totals[1:]
            if left_out:
                taken = np.maximum(0.0, taken - 1.0)
            odds = np.log((taken + DELTA) / (other + DELTA))
            for bit in range(8):
                np.negative(odds[bit], out=odds[bit], where=(short >> np.uint64(7 - bit)) & np.uint64(1) == 0)
            if order >= PREDICTORS - 2:
                seen = taken + other
                level = (seen > 0).astype(np.uint8) + (seen > 3) + (seen > 30)
                self.levels.append(level * np.uint8(4 if order == PREDICTORS - 1 else 1))
            self.back.append(back)
            self.odds.append(odds)

    def inputs(self, some: np.ndarray | slice) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each bit of some grams (log odds per predictor and a constant, gate within the bit, the bit itself)."""
        key, back = self.key[some], [b[some] for b in self.back]
        for bit in range(8):
            value = ((key >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.float64)
            x = np.empty((INPUTS, len(key)))
            x[PREDICTORS] = 0.3
            for order in range(PREDICTORS):
                np.take(self.odds[order][bit], back[order], out=x[order], mode="clip")
            place = self.levels[0][bit][back[PREDICTORS - 2]] + self.levels[1][bit][back[PREDICTORS - 1]]
            yield x, place, value


class Mixer:
    """Predicts the bits of grams from the predictors' counts, gate weights and the refinement table."""

    def __init__(self, counts: list[Counts], weights: np.ndarray | None = None, refined: np.ndarray | None = None):
        self.counts = counts
        self.weights = start_weights() if weights is None else weights
        self.refined = refined

    def inputs(self, key: np.ndarray, left_out: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each bit (log odds per predictor and a constant, gate within the bit, the bit itself)."""
        yield from Seen(self.counts, key, left_out).inputs(slice(None))

    def mixed(self, x: np.ndarray, bit: int, place: np.ndarray) -> np.ndarray:
        scores = self.weights[bit * BIT_GATES : (bit + 1) * BIT_GATES] @ x
        return np.clip(scores[place, np.arange(len(place))], -12.0, 12.0)

    def learn(
        self, seen: Seen, some: np.ndarray, count: np.ndarray, trust: np.ndarray, start: "Mixer", table: np.ndarray
    ) -> float:
        """One online step per gate over some of the grams; returns the bits that `start` needs for them.

        `trust` holds per gate how sharply all decisions so far fix the weights: the sum of
        p (1 - p) x x'. A step is the error's gradient over that, so it shrinks as evidence grows.
        What followed each probability of `start` is added to `table`, by node and bucket.
        """
        spent = 0.0
        key = seen.key[some]
        for bit, (x, place, value) in enumerate(seen.inputs(some)):
            score = start.mixed(x, bit, place)
            p = squash(score)
            spent -= float(np.log2(np.where(value > 0, p, 1.0 - p)) @ count)
            node, low, part = self._place(key, bit, score)
            first, size = BUCKETS << bit, BUCKETS << bit  # the nodes of this bit
            at = node * BUCKETS + low - first
            for shift, share in ((0, count * (1.0 - part)), (1, count * part)):
                table[0, first : first + size] += np.bincount(at + shift, share, size)
                table[1, first : first + size] += np.bincount(at + shift, share * value, size)
            p = squash(self.mixed(x, bit, place))
            error, sharp = (value - p) * count, np.maximum(p * (1.0 - p), 1e-4) * count
            order = np.argsort(place, kind="stable")
            x, error, sharp = x.take(order, axis=1), error[order], sharp[order]
            bounds = np.cumsum([0, *np.bincount(place, minlength=BIT_GATES).tolist()]).tolist()
            own = slice(bit * BIT_GATES, (bit + 1) * BIT_GATES)
            gradient = np.zeros((BIT_GATES, INPUTS))
            scaled = x * sharp
            for gate, (first, last) in enumerate(zip(bounds, bounds[1:])):
                if first < last:
                    gradient[gate] = x[:, first:last] @ error[first:last]
                    trust[own.start + gate] += scaled[:, first:last] @ x[:, first:last].T
            step = np.linalg.solve(trust[own], gradient[:, :, None])[:, :, 0]
            self.weights[own] += np.clip(step, -LONGEST_STEP, LONGEST_STEP)
        return spent

    @staticmethod
    def _place(key: np.ndarray, bit: int, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        node = (((key & np.uint64(0xFF)) | np.uint64(0x100)) >> np.uint64(8 - bit)).astype(np.int64)
        scaled = (score + 12.0) * ((BUCKETS - 1) / 24.0)
        low = np.minimum(scaled.astype(np.int64), BUCKETS - 2)
        return node, low, scaled - low

    def cost(self, key: np.ndarray, shorts: Shorts | None = None) -> np.ndarray:
        """log10 probability of each gram's byte after its context, from the frozen model.

        A decision's probability is kept between 1e-6 and its complement; the two sides still add up to 1.
        """
        total = np.zeros(len(key))
        for first in range(0, len(key), LOOKED_UP):
            known = shorts if len(key) <= LOOKED_UP else None
            seen = Seen(self.counts, key[first : first + LOOKED_UP], False, known)
            for start in range(0, len(seen.key), BATCH):
                some = slice(start, start + BATCH)
                total[first + start : first + start + len(seen.key[some])] = self._cost(seen, some)
        return total

    def _cost(self, seen: Seen, some: slice) -> np.ndarray:
        key = seen.key[some]
        total = np.zeros(len(key))
        for bit, (x, place, value) in enumerate(seen.inputs(some)):
            score = self.mixed(x, bit, place)
            p = squash(score)
            if self.refined is not None:
                node, low, part = self._place(key, bit, score)
                at = node * BUCKETS + low
                p = 0.5 * p + 0.5 * (self.refined[at] * (1.0 - part) + self.refined[at + 1] * part)
            p = np.clip(p, 1e-6, 1.0 - 1e-6)
            total += np.log10(np.where(value > 0, p, 1.0 - p))
        return total


def start_weights() -> np.ndarray:
    start = np.zeros((GATES, INPUTS))
    start[:, :PREDICTORS] = 0.3
    return start


def start_trust() -> np.ndarray:
    return np.tile(PRIOR * np.eye(INPUTS), (GATES, 1, 1))


def refinement(table: np.ndarray) -> np.ndarray:
    """Probability per node and bucket; a bucket without evidence keeps its own centre."""
    centre = np.tile(squash(np.linspace(-12.0, 12.0, BUCKETS)), 256)
    return (table[1] + 20.0 * centre) / (table[0] + 20.0)


class HeadCosts:
    """Costs of some grams; NaN for all others. They lie by hash, those with the same first `HEAD_BITS` side by side."""

    def __init__(self, keys: np.ndarray, costs: np.ndarray):
        spot = keys * PRIME  # an odd factor keeps keys apart
        order = np.argsort(spot)
        self.spots = np.concatenate((spot[order], np.zeros(1, np.uint64)))
        self.costs = np.concatenate((costs[order], [np.nan]))
        bounds = np.arange((1 << HEAD_BITS) + 1, dtype=np.uint64)
        self.starts = np.searchsorted(self.spots[:-1] >> np.uint64(64 - HEAD_BITS), bounds).astype(np.int32)

    def cost(self, key: np.ndarray) -> np.ndarray:
        spot = key * PRIME
        home = (spot >> np.uint64(64 - HEAD_BITS)).astype(np.int64)
        at = self.starts[home]
        left = self.starts[home + 1] - at
        found = (self.spots[at] == spot) & (left > 0)
        cost = np.where(found, self.costs[at], np.nan)
        open_ = np.flatnonzero(~found & (left > 1))
        spot, at, left = spot[open_], at[open_] + 1, left[open_] - 1
        while len(open_):
            found = self.spots[at] == spot
            cost[open_[found]] = self.costs[at[found]]
            further = ~found & (left > 1)
            open_, spot, at, left = open_[further], spot[further], at[further] + 1, left[further] - 1
        return cost


class Scorer:
    """Sums gram costs, with a direct-mapped memo of `2 ** MEMO_BITS` grams."""

    def __init__(self, mixer: Mixer | HeadCosts):
        self.mixer = mixer
        self.memo = np.zeros((1 << MEMO_BITS, 2), np.uint64)  # keys and costs
        self.memo[:, 0] = (1 << 64) - 1

    def scores(self, data: list[bytes]) -> list[float]:
        """log10 probabilities of texts."""
        return self.split(data)[0]

    def split(self, data: list[bytes]) -> tuple[list[float], list[list[np.ndarray]]]:
        """Per text the sum of the costs that are known, and the grams without one.

        Texts share a pass over the model, long ones are cut.
        """
        result = [0.0] * len(data)
        rest: list[list[np.ndarray]] = [[] for _ in data]
        for key, owners, starts in joined_grams(data):
            cost = self._costs(key)
            open_ = np.flatnonzero(np.isnan(cost))
            cost[open_] = 0.0
            for owner, value in zip(owners, np.add.reduceat(cost, starts).tolist()):
                result[owner] += value
            if len(open_):
                cuts = np.searchsorted(open_, starts[1:])
                for owner, some in zip(owners, np.split(key[open_], cuts)):
                    if len(some):
                        rest[owner].append(some)
        return result, rest

    def _costs(self, key: np.ndarray) -> np.ndarray:
        at = ((key * PRIME) >> np.uint64(64 - MEMO_BITS)).astype(np.int64)
        found = self.memo.take(at, axis=0, mode="clip")
        cost = found[:, 1].copy().view(np.float64)
        missing = np.flatnonzero(found[:, 0] != key)
        if len(missing):
            fresh, at = key[missing], at[missing]
            if isinstance(self.mixer, HeadCosts):
                values = self.mixer.cost(fresh)
            else:
                once, back = np.unique(fresh, return_inverse=True)
                values = self.mixer.cost(once)[back]
            cost[missing] = values
            self.memo[at, 0], self.memo[at, 1] = fresh, values.view(np.uint64)
        return cost


def tokens_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words between ASCII white space, A-Z in lower case, as UTF-8, and which row each is of; null has none."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    words = split.flatten().cast(pa.large_binary())
    owners = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy())
    real = pc.greater(pc.binary_length(words), 0)
    return words.filter(real), owners[real.to_numpy(zero_copy_only=False)]


def packed(numbers: np.ndarray) -> bytes:
    """Numbers in as few bytes as all of them need, compressed byte position by byte position."""
    most = int(numbers.max()) if len(numbers) and numbers.dtype.kind in "iu" else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w)) if numbers.dtype.kind in "iu" else 8
    if width < 8:
        numbers = numbers.astype(f"u{width}")
    raw = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, width).T.tobytes()
    return bytes([width]) + len(raw).to_bytes(8, "big") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    width, size = data[0], int.from_bytes(data[1:9], "big")
    raw = np.frombuffer(pa.decompress(data[9:], size, codec="zstd", asbytes=True), np.uint8).reshape(width, -1)
    numbers = np.ascontiguousarray(raw.T).view(kind if width == 8 else f"u{width}").ravel()
    return numbers if width == 8 else numbers.astype(kind)


def _laid_out(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where words of a large_binary array begin, one more for the end, and their bytes."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def packed_words(words: pa.Array) -> bytes:
    offsets, data = _laid_out(words)
    raw = data[offsets[0] : offsets[-1]].tobytes()
    lengths = packed(np.diff(offsets))
    return b"".join((len(lengths).to_bytes(8, "big"), lengths, len(raw).to_bytes(8, "big"), pa.compress(raw, codec="zstd", asbytes=True)))


def unpacked_words(data: bytes) -> pa.Array:
    at = 8 + int.from_bytes(data[:8], "big")
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(unpacked(data[8:at], np.int64))))
    raw = pa.decompress(data[at + 8 :], int.from_bytes(data[at : at + 8], "big"), codec="zstd", asbytes=True)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])


def word_share(words: pa.Array) -> np.ndarray:
    """A share for each word, by a hash of its first 64 bytes; no word is empty."""
    if not len(words):
        return np.zeros(0, np.int64)
    offsets, data = _laid_out(words)
    length = np.minimum(np.diff(offsets), len(FACTORS))
    starts = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(starts, length)
    mixed = (data[place + np.repeat(offsets[:-1], length)] + np.uint64(1)) * FACTORS[place]
    return ((np.add.reduceat(mixed, starts) * PRIME) >> np.uint64(40)).astype(np.int64) % SHARES


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys, as what each exceeds the one before it by."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def spread(key: np.ndarray) -> np.ndarray:
    """Spark's hash of the grams' last three context bytes, case aside, as a bigint."""
    context = ((key >> np.uint64(8)) & np.uint64((1 << (8 * WORD_LEAST)) - 1)).astype(np.uint32)
    context |= np.uint32(int.from_bytes(bytes([CASE] * WORD_LEAST), "big"))

    def turned(value: np.ndarray, by: int) -> np.ndarray:
        return (value << np.uint32(by)) | (value >> np.uint32(32 - by))

    found = np.uint32(42) ^ (turned(context * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593))
    for _ in range(2):  # the upper half of the bigint is zero and adds nothing
        found = turned(found, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    found ^= np.uint32(8)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        found = (found ^ (found >> np.uint32(shift))) * np.uint32(factor)
    return (found ^ (found >> np.uint32(16))).view(np.int32)


def dealt(place: np.ndarray, number: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places below `number` that occur, and where, in the order in which they stand."""
    order = np.argsort(place.astype(np.uint16) if number <= 1 << 16 else place, kind="stable")
    found = place[order]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(found)), bool), found[1:] != found[:-1])))
    return zip(found[starts].tolist(), np.split(order, starts[1:]))


def merged(some: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    if len(some) == 1:
        return some[0]
    found = Counts(*(np.concatenate(arrays) for arrays in zip(*some)))
    return found.keys, np.diff(found.sums)


def _rows(table: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The table in batches of `schema`; columns that it lacks are null."""
    missing = {f.name: pa.nulls(len(table), f.type) for f in schema if f.name not in table.column_names}
    columns = [missing[f.name] if f.name in missing else table[f.name].cast(f.type) for f in schema]
    yield from pa.table(columns, schema=schema).to_batches(max_chunksize=50_000)


COUNT_SCHEMA = "kind byte, share int, n bigint, times bigint, keys binary, learned binary, held binary"
COUNT_ARROW = pa.schema([
    ("kind", pa.int8()), ("share", pa.int32()), ("n", pa.int64()), ("times", pa.int64()),
    ("keys", pa.binary()), ("learned", pa.binary()), ("held", pa.binary()),
])


def gather(rows: DataFrame) -> DataFrame:
    """(kind, share, n, times, keys, learned, held) of the words (with the end token) and of the grams in `text`.

    A share of the words or grams is one row: their number `n`, the packed keys, how often each occurs in the
    rows to learn from, with the sum `times`, and, for grams, in those with `held_out`.
    Counted per task in bounded memory first, then summed.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[pa.Array] = []
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        pending: list[np.ndarray] = []
        size = 0

        def squeeze() -> None:
            nonlocal size
            if pending:
                grams.append(np.unique(np.concatenate(pending), return_counts=True))
            pending.clear()
            size = 0

        def drain() -> Iterator[pa.RecordBatch]:
            if grams:
                keys, counts = merged(grams)
                grams.clear()
                found = [
                    {"kind": GRAM_KIND, "share": share, "keys": packed_keys(keys[at]), "learned": packed(counts[at])}
                    for share, at in dealt(spread(keys) % SHARES, SHARES)
                ]
                yield from pa.Table.from_pylist(found, schema=COUNT_ARROW).to_batches()

        def drain_words() -> Iterator[pa.RecordBatch]:
            if words:
                counted = pa.chunked_array(words).value_counts()
                words.clear()
                keys, counts = counted.field(0), counted.field(1).to_numpy()
                found = [
                    {"kind": WORD_KIND, "share": share, "keys": packed_words(keys.take(pa.array(at))), "learned": packed(counts[at])}
                    for share, at in dealt(word_share(keys), SHARES)
                ]
                yield from pa.Table.from_pylist(found, schema=COUNT_ARROW).to_batches()

        for batch in batches:
            held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            known, _ = tokens_of(batch.column(0).filter(pa.array(~held)))
            words += [known, pa.array([END] * int((~held).sum()), pa.large_binary())]
            if sum(map(len, words)) >= TOKENS:
                yield from drain_words()
            data = [raw or b"" for raw in batch.column(0).cast(pa.binary()).to_pylist()]
            for mark in (False, True):
                for key, _, _ in joined_grams([text for text, h in zip(data, held) if h == mark]):
                    pending.append(key | HELD if mark else key)
                    size += len(key)
                    if size >= PENDING:
                        squeeze()
                        if sum(len(keys) for keys, _ in grams) > DISTINCT:
                            yield from drain()
        squeeze()
        yield from drain_words()
        yield from drain()

    def add_words(packs: list[tuple[bytes, bytes]]) -> dict:
        keys = pa.concat_arrays([unpacked_words(keys) for keys, _ in packs])
        counts = pa.array(np.concatenate([unpacked(counts, np.int64) for _, counts in packs]))
        found = pa.table([keys, counts], ["key", "n"]).group_by("key", use_threads=False).aggregate([("n", "sum")])
        keys, counts = found["key"].combine_chunks(), found["n_sum"].to_numpy()
        return {"n": len(keys), "times": int(counts.sum()), "keys": packed_words(keys), "learned": packed(counts)}

    def add_grams(packs: list[tuple[bytes, bytes]]) -> dict:
        some: list[tuple[np.ndarray, np.ndarray]] = []
        for keys, counts in packs:
            some.append((unpacked_keys(keys), unpacked(counts, np.int64)))
            if sum(len(keys) for keys, _ in some[1:]) > DISTINCT:
                some = [merged(some)]
        marked, counts = merged(some)
        learned = int(np.searchsorted(marked, HELD))
        both = Counts(marked & ~HELD, np.concatenate((counts[:learned], np.zeros(len(counts) - learned, np.int64))))
        times = np.diff(both.sums)
        held = np.zeros(len(times), np.int64)
        held[np.searchsorted(both.keys, marked[learned:] ^ HELD)] = counts[learned:]
        row = {"n": len(times), "times": int(times.sum()), "keys": packed_keys(both.keys)}
        return row | {"learned": packed(times), "held": packed(held)}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs: dict[tuple[int, int], list[tuple[bytes, bytes]]] = defaultdict(list)
        for batch in batches:
            for kind, share, *pack in zip(*(batch.column(c).to_pylist() for c in ("kind", "share", "keys", "learned"))):
                packs[kind, share].append(tuple(pack))
        while packs:
            (kind, share), some = packs.popitem()
            row = {"kind": kind, "share": share} | (add_words if kind == WORD_KIND else add_grams)(some)
            yield pa.RecordBatch.from_pylist([row], schema=COUNT_ARROW)

    found = map_batches(rows.select("text", "held_out"), count, COUNT_SCHEMA)
    return map_batches(found.repartition(parallelism(rows.sparkSession), "kind", "share"), add, COUNT_SCHEMA)


PART_SCHEMA = "part int, keys binary, learned binary, held binary"
PART_ARROW = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("learned", pa.binary()), ("held", pa.binary())])


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, if there is one, keys, how often they are learned from, how often held out)."""
    for batch in batches:
        parts = batch.column("part").to_pylist() if "part" in batch.schema.names else [None] * batch.num_rows
        for part, *row in zip(parts, *(batch.column(c).to_pylist() for c in ("keys", "learned", "held"))):
            yield part, unpacked_keys(row[0]), unpacked(row[1], np.int64), unpacked(row[2], np.int64)


def _part_row(part: int, keys: np.ndarray, learned: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
    row = {"part": part, "keys": packed_keys(keys), "learned": packed(learned), "held": packed(held)}
    return pa.RecordBatch.from_pylist([row], schema=PART_ARROW)


def parts_number(grams: DataFrame) -> int:
    """It follows from the number of grams alone, so neither cores nor files change what is learned."""
    return max(1, -(-(grams.agg(F.sum("n")).first()[0] or 0) // PART_GRAMS))


def parts_of(grams: DataFrame, number: int) -> DataFrame:
    """The grams in parts, one row each, written once and read by every round without a shuffle.

    Grams with the same last three context bytes, case aside, share a part.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, learned, held in _packs(batches):
            for part, at in dealt(spread(keys) % number, number):
                yield _part_row(part, keys[at], learned[at], held[at])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple[bytes, bytes, bytes]]] = defaultdict(list)
        for batch in batches:
            for part, *row in zip(*(column.to_pylist() for column in batch.columns)):
                parts[part].append(tuple(row))
        while parts:
            part, some = parts.popitem()
            keys = np.concatenate([unpacked_keys(row[0]) for row in some])
            learned, held = (np.concatenate([unpacked(row[i], np.int64) for row in some]) for i in (1, 2))
            order = np.argsort(keys)
            yield _part_row(part, keys[order], learned[order], held[order])

    shares = map_batches(grams.select("keys", "learned", "held"), split, PART_SCHEMA)
    return materialize(map_batches(shares.repartition(-(-number // PARTS), "part"), join, PART_SCHEMA), "gram-parts")


def low_counts(grams: DataFrame) -> list[Counts]:
    """Counts of the orders that all tasks share."""

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, learned, _ in _packs(batches):
            some = learned > 0
            found = Counts(of_order(keys[some], LOW_ORDERS - 1), learned[some])
            columns = [pa.array(found.keys.astype(np.int64)), pa.array(np.diff(found.sums))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n"])

    found = map_batches(grams.select("keys", "learned", "held"), short, "key bigint, n bigint")
    found = found.groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key = found.column(0).to_numpy().astype(np.uint64)
    return [Counts(of_order(key, order), found.column(1).to_numpy()) for order in range(LOW_ORDERS)]


def summed(parts: DataFrame, size: int, add: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """The sum over all parts of the `size` numbers that `add(key, count, sums)` adds up.

    Tasks add up their parts, the executors the tasks, by number; `size` numbers reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size)
        for _, key, count, _ in _packs(batches):
            add(key[count > 0], count[count > 0].astype(np.float64), sums)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["place", "value"])

    found = map_batches(parts, run, "place bigint, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    result = np.zeros(size)
    result[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return result


def gram_costs(grams: DataFrame, number: int) -> DataFrame:
    """The grams' parts with the cost and the number of occurrences of each gram, after learning from all of them.

    Every part learns online from the weights so far, all parts at once. Their weights are averaged
    by what each part knows (its `trust`), and the next round starts there, until the average saves less
    than `SETTLED` of the bits, `ROUNDS` at most. The refinement table is that of the weights kept.
    """
    low = grams.sparkSession.sparkContext.broadcast(low_counts(grams))
    parts = parts_of(grams, number)

    def exact(key: np.ndarray, count: np.ndarray) -> tuple[list[Counts], Shorts]:
        shorts = shorts_of(key)
        own = [Counts(short, np.bincount(back, count, len(short)).astype(np.int64)) for short, back in shorts[LOW_ORDERS:]]
        return low.value + own, shorts

    cuts = np.cumsum([1, GATES * INPUTS * INPUTS, GATES * INPUTS])

    def learning(weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def add(key: np.ndarray, count: np.ndarray, sums: np.ndarray) -> None:
            counts, shorts = exact(key, count)
            mixer, start, trust = Mixer(counts, weights.copy()), Mixer(counts, weights), start_trust()
            table = sums[cuts[2] :].reshape(2, -1)
            order = np.random.default_rng(0).permutation(len(key))
            for first in range(0, len(key), LOOKED_UP):
                chosen = np.sort(order[first : first + LOOKED_UP])
                seen = Seen(counts, key[chosen], True, shorts if len(chosen) == len(key) else None)
                for batch in range(first, min(first + LOOKED_UP, len(key)), BATCH):
                    some = np.sort(order[batch : batch + BATCH])
                    sums[0] += mixer.learn(seen, np.searchsorted(chosen, some), count[some], trust, start, table)
            sums[cuts[0] : cuts[1]] += trust.ravel()
            sums[cuts[1] : cuts[2]] += np.einsum("gij,gj->gi", trust, mixer.weights).ravel()

        spent, trust, pull, table = np.split(summed(parts, int(cuts[2]) + 2 * 256 * BUCKETS, add), cuts)
        if trust.any():
            weights = np.linalg.solve(trust.reshape(GATES, INPUTS, INPUTS), pull.reshape(GATES, INPUTS, 1))[:, :, 0]
        return float(spent[0]), weights, refinement(table.reshape(2, -1))

    weights = start_weights()
    spent, better, refined = learning(weights)
    for _ in range(ROUNDS):
        if not spent:  # nothing to learn from
            break
        before, weights = spent, better
        spent, better, refined = learning(weights)
        if before - spent <= SETTLED * before:
            break

    def costing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, key, count, held in _packs(batches):
            counts, shorts = exact(key, count)
            costs = Mixer(counts, weights, refined).cost(key, shorts)
            row = {"part": part, "keys": packed_keys(key), "costs": packed(costs), "times": packed(count + held)}
            yield pa.RecordBatch.from_pylist([row], schema=COST_ARROW)

    return map_batches(parts, costing, COST_SCHEMA)


COST_SCHEMA = "part int, keys binary, costs binary, times binary"
COST_ARROW = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("costs", pa.binary()), ("times", pa.binary())])


def head_costs(costs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and costs of the most frequent grams, at most HEAD_GRAMS; equally frequent ones stay together."""

    def levels(times: bytes) -> np.ndarray:
        return np.floor(np.log2(unpacked(times, np.int64)) * 8).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for times in batch.column(0).to_pylist():
                found = np.unique(levels(times), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(f) for f in found], ["level", "n"])

    least = _least(map_batches(costs.select("times"), count, "level bigint, n bigint"), HEAD_GRAMS)
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grams, values, times in zip(*(column.to_pylist() for column in batch.columns)):
                some = levels(times) >= least
                columns = [unpacked_keys(grams)[some].astype(np.int64), unpacked(values, np.float64)[some]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "cost"])

    found = map_batches(costs.select("keys", "costs", "times"), choose, "key bigint, cost double").toArrow()
    return found.column(0).to_numpy().astype(np.uint64), found.column(1).to_numpy()


def head_words(words: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """The most frequent words, at most HEAD_WORDS, and how often they occur; equally frequent ones stay together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for times in batch.column(0).to_pylist():
                found = np.unique(unpacked(times, np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int64)) for f in found], ["level", "n"])

    least = _least(map_batches(words.select("learned"), count, "level bigint, n bigint"), HEAD_WORDS)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, times in zip(*(column.to_pylist() for column in batch.columns)):
                counts = unpacked(times, np.int64)
                some = np.flatnonzero(counts >= least)
                found = unpacked_words(keys).take(pa.array(some)).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([found, pa.array(counts[some])], ["key", "n"])

    if least is None:
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    found = map_batches(words.select("keys", "learned"), choose, "key binary, n bigint").toArrow()
    return found.column(0).combine_chunks().cast(pa.large_binary()), found.column(1).to_numpy()


def _least(levels: DataFrame, most: int) -> int | None:
    """The lowest level, if any, so that `most` things at most, by the sums of (level, n), are at it or above."""
    least, total = None, 0
    for row in sorted(levels.groupBy("level").agg(F.sum("n").alias("n")).collect(), key=lambda r: -r["level"]):
        total += row["n"]
        if total > most:
            break
        least = row["level"]
    return least


def rare_sums(rare: DataFrame, costs: DataFrame, words: DataFrame) -> DataFrame:
    """(rest_row, rest_score, rest_base, rest_known): what the rare grams and words of (kind, part, keys, owners) add, by owner.

    The sums of a part go, packed, to where the owners' other sums go: by a share of the partitions that numbered the owners.
    """

    names = ["rest_row", "rest_score", "rest_base", "rest_known"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners: list[np.ndarray] = []
        values: list[np.ndarray] = []  # gram costs, logarithms of word counts, known words

        def drain() -> Iterator[pa.RecordBatch]:
            if owners:
                found, back = np.unique(np.concatenate(owners), return_inverse=True)
                sums = [np.bincount(back, some, len(found)) for some in np.concatenate(values, axis=1)]
                owners.clear()
                values.clear()
                for block, at in dealt((found >> 33) % SHARES, SHARES):  # see `monotonically_increasing_id`
                    columns = [packed_keys(found[at].astype(np.uint64)), *(packed(some[at]) for some in sums)]
                    columns = [pa.array([block], pa.int64()), *(pa.array([c], pa.binary()) for c in columns)]
                    yield pa.RecordBatch.from_arrays(columns, ["block", *names])

        known: list[tuple] = []  # of the place: words or grams, and their counts or costs
        asked_words: list[pa.Array] = []
        word_owners: list[np.ndarray] = []

        def answer() -> None:
            if not asked_words:
                return
            words, numbers = known[0]
            at = pc.fill_null(pc.index_in(pa.concat_arrays(asked_words), words), -1).to_numpy()
            found = np.zeros((3, len(at)))
            found[1], found[2] = np.where(at >= 0, np.log10(numbers[at] + 1.0), 0.0), at >= 0
            owners.append(np.concatenate(word_owners))
            values.append(found)
            asked_words.clear()
            word_owners.clear()

        place = None
        for batch in batches:
            columns = ("kind", "part", "asked", "keys", "numbers")
            for kind, part, asked, keys, own in zip(*(batch.column(c).to_pylist() for c in columns)):
                if place != (kind, part):
                    answer()
                    place = kind, part
                    known.clear()
                if not asked and kind == WORD_KIND:
                    known.append((unpacked_words(keys), unpacked(own, np.int64)))
                elif not asked:
                    known.append((unpacked_keys(keys), unpacked(own, np.float64)))
                elif kind == WORD_KIND and known:  # else none of these words is learned from
                    asked_words.append(unpacked_words(keys))
                    word_owners.append(unpacked(own, np.int64))
                    if sum(map(len, word_owners)) >= max(RARE // 4, len(known[0][0])):
                        answer()
                elif kind == GRAM_KIND:
                    if len(known) > 1:
                        grams, costs = (np.concatenate(some) for some in zip(*known))
                        order = np.argsort(grams)
                        known[:] = [(grams[order], costs[order])]
                    owners.append(unpacked(own, np.int64))
                    values.append(np.zeros((3, len(owners[-1]))))
                    values[-1][0] = known[0][1][np.searchsorted(known[0][0], unpacked_keys(keys))]
                if sum(map(len, owners)) >= RARE:
                    yield from drain()
        answer()
        yield from drain()

    kind = F.lit(GRAM_KIND).cast("byte").alias("kind")
    all_ = costs.select(kind, (F.col("part") % SHARES).alias("part"), F.lit(0).alias("asked"), "keys", F.col("costs").alias("numbers"))
    kind = F.lit(WORD_KIND).cast("byte").alias("kind")
    shares = words.select(kind, F.col("share").alias("part"), F.lit(0).alias("asked"), "keys", F.col("learned").alias("numbers"))
    all_ = all_.unionByName(shares)
    all_ = all_.unionByName(rare.select("kind", "part", F.lit(1).alias("asked"), "keys", F.col("owners").alias("numbers")))
    placed = all_.repartition(parallelism(costs.sparkSession), "kind", "part").sortWithinPartitions("kind", "part", "asked")
    found = map_batches(placed, look_up, "block bigint, " + ", ".join(f"{n} binary" for n in names))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs: dict[int, list[tuple[bytes, ...]]] = defaultdict(list)
        for batch in batches:
            for block, *pack in zip(*(column.to_pylist() for column in batch.columns)):
                packs[block].append(tuple(pack))
        while packs:
            _, some = packs.popitem()
            owners = np.concatenate([unpacked_keys(pack[0]) for pack in some]).astype(np.int64)
            owners, back = np.unique(owners, return_inverse=True)
            sums = [np.bincount(back, np.concatenate([unpacked(p[i], np.float64) for p in some])) for i in (1, 2, 3)]
            columns = [owners, *sums[:2], np.rint(sums[2]).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    schema = "rest_row bigint, rest_score double, rest_base double, rest_known bigint"
    return map_batches(found.repartition(parallelism(costs.sparkSession), "block"), add, schema)


SCORED_SCHEMA = (
    f"{ROW} bigint, doc_id bigint, n_tokens bigint, known bigint, head_score double, gram_score double, "
    "n_bytes bigint, kind byte, part int, keys binary, owners binary"
)
SCORED_ARROW = pa.schema([
    (ROW, pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()),
    ("head_score", pa.float64()), ("gram_score", pa.float64()), ("n_bytes", pa.int64()), ("kind", pa.int8()),
    ("part", pa.int32()), ("keys", pa.binary()), ("owners", pa.binary()),
])
_SCORERS: dict[str, Scorer] = {}


def score_documents(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Learns from the rows whose crc32(doc_id as text) mod 7 is not 2; a null id counts as the
    empty text. A null text is empty: one end token, and the boundary as its only symbol.
    `base_score` is the add-one unigram score, `score` the mixing model's log10 probability of
    the text with its end. Repeated rows count and are scored each; an empty training part
    gives counts of zero. Columns other than doc_id and text are not read.

    Frequent words and grams (a bounded number) are looked up where the texts are; the others go,
    in packs, to a lookup in the full tables, part by part, so no vocabulary has to fit into memory.
    """
    spark = documents.sparkSession
    rows = documents.select("doc_id", "text")
    held_out = doc_remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    counts = materialize(gather(rows.withColumn("held_out", held_out)), "corpus-counts")
    words = counts.filter(F.col("kind") == WORD_KIND).select("share", "n", "times", "keys", "learned")
    grams = counts.filter(F.col("kind") == GRAM_KIND).select("n", "keys", "learned", "held")
    size = words.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "times"))).first()
    total, distinct = int(size["times"]), int(size["n"])
    head = head_words(words)
    number = parts_number(grams)
    costs = materialize(gram_costs(grams, number), "gram-costs")
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, head, head_costs(costs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, (common, often), frequent = shared.value
        if name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[name] = Scorer(HeadCosts(*frequent))
        scorer = _SCORERS[name]
        often = np.concatenate((often, [0]))  # the last one for all other words
        rare_keys: list[np.ndarray] = []
        rare_rows: list[np.ndarray] = []
        rare_words: list[pa.Array] = []
        word_rows: list[np.ndarray] = []

        def drain() -> Iterator[pa.RecordBatch]:
            if rare_keys:
                keys, owners = np.concatenate(rare_keys), np.concatenate(rare_rows)
                rare_keys.clear()
                rare_rows.clear()
                order = np.argsort(keys)
                keys, owners = keys[order], owners[order]
                yield from blobs(GRAM_KIND, dealt(spread(keys) % number % SHARES, SHARES), owners, lambda at: packed_keys(keys[at]))

        def drain_words() -> Iterator[pa.RecordBatch]:
            if rare_words:
                words, owners = pa.concat_arrays(rare_words), np.concatenate(word_rows)
                rare_words.clear()
                word_rows.clear()
                yield from blobs(WORD_KIND, dealt(word_share(words), SHARES), owners, lambda at: packed_words(words.take(pa.array(at))))

        def blobs(kind: int, places: Iterator, owners: np.ndarray, keys: Callable) -> Iterator[pa.RecordBatch]:
            found = [{"kind": kind, "part": part, "keys": keys(at), "owners": packed(owners[at])} for part, at in places]
            yield from pa.Table.from_pylist(found, schema=SCORED_ARROW).to_batches(max_chunksize=1000)

        for batch in batches:
            data = [raw or b"" for raw in batch.column(0).cast(pa.binary()).to_pylist()]
            row = batch.column(1).to_numpy()
            scores, rest = scorer.split(data)
            for number_, some in zip(row, rest):
                rare_keys.extend(some)
                rare_rows.extend(np.full(len(s), number_) for s in some)
            tokens, owners = tokens_of(batch.column(0))
            tokens = pa.concat_arrays([tokens, pa.array([END] * len(data), pa.large_binary())])
            owners = np.concatenate((owners, np.arange(len(data))))
            seen = often[pc.fill_null(pc.index_in(tokens, common), len(common)).to_numpy()]
            rare = np.flatnonzero(seen == 0)
            if len(rare):
                rare_words.append(tokens.take(pa.array(rare)))
                word_rows.append(row[owners[rare]])
            columns = [
                batch.column(1),
                batch.column(2),
                pa.array(np.bincount(owners, minlength=len(data))),
                pa.array(np.bincount(owners, seen > 0, len(data)).astype(np.int64)),
                pa.array(np.bincount(owners, np.log10(seen + 1.0), len(data))),
                pa.array(scores, pa.float64()),
                pa.array([len(raw) for raw in data], pa.int64()),
            ]
            yield from _rows(pa.table(columns, SCORED_ARROW.names[: len(columns)]), SCORED_ARROW)
            if sum(map(len, rare_keys)) >= RARE:
                yield from drain()
            if sum(map(len, rare_words)) >= RARE:
                yield from drain_words()
        yield from drain()
        yield from drain_words()

    scored = materialize(map_batches(with_row(rows).select("text", ROW, "doc_id"), run, SCORED_SCHEMA), "scored")
    rare = scored.filter(F.col("kind").isNotNull()).select("kind", "part", "keys", "owners")
    scored = scored.filter(F.col("kind").isNull()).drop("kind", "part", "keys", "owners")
    joined = scored.join(rare_sums(rare, costs, words), F.col(ROW) == F.col("rest_row"), "left")
    score = F.col("gram_score") + F.coalesce("rest_score", F.lit(0.0))
    norm = float(np.log10(total + distinct + 1))
    base = F.col("head_score") + F.coalesce("rest_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)
    return joined.select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        base.alias("base_score"),
        score.alias("score"),
        "n_bytes",
        (score * F.lit(-float(np.log2(10.0))) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
