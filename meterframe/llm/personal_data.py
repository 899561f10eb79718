"""Personal data in texts: patterns, and a character BiLSTM with a CRF for what they miss.

The patterns find four kinds; their spans always stay. The network labels each character as
outside, or as begin or inside of a kind. It is trained in numpy from labelled spans: windows
around the patterns' spans in the documents (a bounded sample), variants of the kinds that
the patterns do not cover, and look-alikes. A text is read in overlapping windows; the network
runs in both directions over each, Viterbi decodes it under the CRF's transitions, and the spans
of all windows of the text are reconciled by choosing the heaviest set that does not overlap.
A span of any kind holds a digit or an at sign, so windows without either cannot hold one and are
not run.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.llm.common import map_batches, texts

# The kinds in their order, and the patterns that define the base spans.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANCHOR = re.compile(r"[0-9@]")

WINDOW, STRIDE = 128, 64
HIDDEN = 16
TRAIN_WINDOWS = 2_000  # bound on the windows taken from documents
PER_DOCUMENT = 3
MADE_WINDOWS = 2_000
STEPS, BATCH, RATE = 220, 64, 0.02
RUN = 1_024  # windows per pass of the network
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
CLASSES = "@.-+()_%=:/#,;\"' \n"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """Leftmost matches, found from the at signs, so that no long run is read twice."""
    spans, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            spans.append(("email", start, match.end()))
            done = match.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    return spans


def base_spans(text: str) -> list[Span]:
    """The patterns' spans by start, then kind. Each kind is searched on its own."""
    spans = emails(text) if "@" in text else []
    if ANCHOR.search(text):
        for match in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in match[0].split(".")):
                spans.append(("ip", *match.span()))
        for match in CARD.finditer(text):
            if match.end() - match.start() <= 38 and 14 <= len(digits := digits_of(match[0])) <= 19 and luhn(digits):
                spans.append(("card", *match.span()))
        for match in PHONE.finditer(text) if "+" in text else ():
            if 10 <= len(digits_of(match[0])) <= 15:
                spans.append(("phone", *match.span()))
    return in_order(spans)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def plausible(kind: str, text: str) -> bool:
    """What a span that only the network found must satisfy."""
    digits = digits_of(text)
    if kind == "email":
        return bool(re.fullmatch(r"\S+\s?@\s?\S+\s?\.\s?[A-Za-z]{2,}", text))
    if kind == "ip":
        parts = re.split(r"\D+", text)
        return len(parts) == 4 and all(p and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"[0-9 ./-]+", text) is not None
    return 10 <= len(digits) <= 15 and re.fullmatch(r"[(0-9][0-9 ()./-]+[0-9]", text) is not None and not text.isdigit()


def classes(text: str) -> np.ndarray:
    """Character classes: padding 0, other 1, letters (a-f apart), digits, and marks of their own."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CLASS_OF[np.minimum(codes, 255)]


def _class_table() -> np.ndarray:
    table = np.ones(256, np.int64)
    for code in range(128):
        char = chr(code)
        if char in "abcdefABCDEF":
            table[code] = 2
        elif char.isalpha():
            table[code] = 3 if char.islower() else 4
        elif char.isdigit():
            table[code] = 5
        elif char in CLASSES:
            table[code] = 6 + CLASSES.index(char)
    table[192:256] = 3  # letters with marks, and everything beyond
    return table


_CLASS_OF = _class_table()
CLASS_COUNT = 6 + len(CLASSES)


def tags(length: int, spans: list[Span]) -> np.ndarray:
    result = np.zeros(length, np.int64)
    for kind, start, end in spans:
        number = 1 + 2 * KINDS.index(kind)
        result[start:end] = number + 1
        result[start] = number
    return result


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


class Network:
    """BiLSTM emissions and CRF transitions; all weights in the dictionary `w`."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None):
        if weights is None:
            random = np.random.default_rng(7)
            weights = {
                "out": random.normal(0, 0.2, (2 * HIDDEN, TAGS)),
                "bias": np.zeros(TAGS),
                "moves": np.zeros((TAGS, TAGS)),
                "first": np.zeros(TAGS),
            }
            for side in ("left", "right"):
                weights[f"{side}_in"] = random.normal(0, 0.3, (CLASS_COUNT, 4 * HIDDEN))
                weights[f"{side}_in"][:, HIDDEN : 2 * HIDDEN] += 1.0  # remember by default
                weights[f"{side}_step"] = random.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
        self.w = {k: v.astype(np.float32) for k, v in weights.items()}

    def _lstm(self, inputs: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """Hidden states for class numbers (steps, batch); `keep` collects what learning needs."""
        table, step = self.w[f"{side}_in"], self.w[f"{side}_step"]
        steps, batch = inputs.shape
        h = np.zeros((batch, HIDDEN), np.float32)
        c = np.zeros((batch, HIDDEN), np.float32)
        states = np.empty((steps, batch, HIDDEN), np.float32)
        for t in range(steps):
            z = table[inputs[t]] + h @ step
            gates = sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            if keep is not None:
                keep.append((h, c, i, f, o, g))
            c = f * c + i * g
            h = o * np.tanh(c)
            states[t] = h
        return states

    def emissions(self, inputs: np.ndarray, keep: tuple[list, list] | None = None) -> np.ndarray:
        """(steps, batch, tags) for class numbers (steps, batch)."""
        left = self._lstm(inputs, "left", keep[0] if keep else None)
        right = self._lstm(inputs[::-1], "right", keep[1] if keep else None)[::-1]
        return np.concatenate((left, right), axis=2) @ self.w["out"] + self.w["bias"]

    def gradient(self, inputs: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the gold tags under the CRF, and its gradient."""
        keep: tuple[list, list] = ([], [])
        scores = self.emissions(inputs, keep).astype(np.float64)
        steps, batch = inputs.shape
        moves, first = self.w["moves"].astype(np.float64), self.w["first"].astype(np.float64)
        forward = np.empty_like(scores)
        forward[0] = first + scores[0]
        for t in range(1, steps):
            forward[t] = _logsum(forward[t - 1][:, :, None] + moves, 1) + scores[t]
        backward = np.zeros_like(scores)
        for t in range(steps - 2, -1, -1):
            backward[t] = _logsum(moves + (scores[t + 1] + backward[t + 1])[:, None, :], 2)
        total = _logsum(forward[-1], 1)
        marginal = np.exp(forward + backward - total[None, :, None])
        rows = np.arange(batch)
        d_scores = marginal.copy()
        path = first[gold[0]] + scores[0][rows, gold[0]]
        d_moves = np.zeros_like(moves)
        for t in range(steps):
            d_scores[t][rows, gold[t]] -= 1.0
            if t:
                path += moves[gold[t - 1], gold[t]] + scores[t][rows, gold[t]]
                pair = forward[t - 1][:, :, None] + moves + (scores[t] + backward[t])[:, None, :]
                d_moves += np.exp(pair - total[:, None, None]).sum(axis=0)
                np.subtract.at(d_moves, (gold[t - 1], gold[t]), 1.0)
        d_scores = (d_scores / batch).astype(np.float32)
        result = {"moves": d_moves / batch, "first": d_scores[0].sum(axis=0), "bias": d_scores.sum(axis=(0, 1))}
        left = np.stack([o * np.tanh(f * c + i * g) for _, c, i, f, o, g in keep[0]])
        right = np.stack([o * np.tanh(f * c + i * g) for _, c, i, f, o, g in keep[1]])[::-1]
        both = np.concatenate((left, right), axis=2)
        result["out"] = np.einsum("tbh,tbk->hk", both, d_scores)
        d_both = d_scores @ self.w["out"].T
        self._lstm_gradient(inputs, "left", keep[0], d_both[:, :, :HIDDEN], result)
        self._lstm_gradient(inputs[::-1], "right", keep[1], d_both[::-1, :, HIDDEN:], result)
        return float((total - path).mean()), result

    def _lstm_gradient(self, inputs, side, keep, d_states, result) -> None:
        step = self.w[f"{side}_step"]
        d_in, d_step = np.zeros_like(self.w[f"{side}_in"]), np.zeros_like(step)
        d_h = np.zeros_like(keep[0][0])
        d_c = np.zeros_like(d_h)
        for t in range(len(inputs) - 1, -1, -1):
            h, c, i, f, o, g = keep[t]
            cell = np.tanh(f * c + i * g)
            d_h = d_h + d_states[t]
            d_c = d_c + d_h * o * (1 - cell * cell)
            d_z = np.concatenate(
                (d_c * g * i * (1 - i), d_c * c * f * (1 - f), d_h * cell * o * (1 - o), d_c * i * (1 - g * g)), axis=1
            )
            np.add.at(d_in, inputs[t], d_z)
            d_step += h.T @ d_z
            d_h = d_z @ step.T
            d_c = d_c * f
        result[f"{side}_in"], result[f"{side}_step"] = d_in, d_step

    def train(self, inputs: np.ndarray, gold: np.ndarray, steps: int = STEPS) -> list[float]:
        """Adam over batches drawn in a fixed random order; inputs and gold are (windows, steps)."""
        random = np.random.default_rng(11)
        mean = {k: np.zeros_like(v) for k, v in self.w.items()}
        square = {k: np.zeros_like(v) for k, v in self.w.items()}
        losses = []
        for n in range(1, steps + 1):
            some = random.integers(0, len(inputs), BATCH)
            loss, gradient = self.gradient(inputs[some].T, gold[some].T)
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in gradient.values()))
            scale = min(1.0, 5.0 / (norm + 1e-9))
            rate = RATE * min(1.0, 2.0 * (1.0 - (n - 1) / steps))
            for name, g in gradient.items():
                g = (g * scale).astype(np.float32)
                mean[name] = 0.9 * mean[name] + 0.1 * g
                square[name] = 0.99 * square[name] + 0.01 * g * g
                m, s = mean[name] / (1 - 0.9**n), square[name] / (1 - 0.99**n)
                self.w[name] -= rate * m / (np.sqrt(s) + 1e-6)
        return losses

    def decode(self, inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best tags, advantage over outside) as (windows, steps), for class numbers likewise."""
        scores = self.emissions(inputs.T)
        steps, batch, _ = scores.shape
        moves = self.w["moves"]
        best = self.w["first"] + scores[0]
        back = np.empty((steps, batch, TAGS), np.int8)
        for t in range(1, steps):
            paths = best[:, :, None] + moves
            back[t] = paths.argmax(axis=1)
            best = paths.max(axis=1) + scores[t]
        rows = np.arange(batch)
        tag = np.empty((steps, batch), np.int64)
        tag[-1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            tag[t - 1] = back[t][rows, tag[t]]
        advantage = np.take_along_axis(scores, tag[:, :, None], axis=2)[:, :, 0] - scores[:, :, 0]
        return tag.T, advantage.T


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def window_starts(text: str) -> list[int]:
    """Starts of the overlapping windows that hold a digit or an at sign."""
    starts: dict[int, None] = {}
    at = ANCHOR.search(text)
    while at:
        last = at.start() // STRIDE * STRIDE
        for start in range(max(0, last - WINDOW + STRIDE), last + 1, STRIDE):
            starts[start] = None
        at = ANCHOR.search(text, last + STRIDE)  # the next stride's windows
    return list(starts)


def padded(text: str, start: int) -> np.ndarray:
    part = classes(text[start : start + WINDOW])
    return np.pad(part, (0, WINDOW - len(part)))


def spans_of(tag: np.ndarray, gain: np.ndarray, start: int) -> list[tuple[float, Span]]:
    """(weight, span) of one decoded window, in the text's positions."""
    found, at = [], 0
    marked = np.flatnonzero(tag)
    if not len(marked):
        return found
    at, end = int(marked[0]), int(marked[-1]) + 1
    while at < end:
        if not tag[at]:
            at += 1
            continue
        kind, stop = (tag[at] - 1) // 2, at + 1
        while stop < end and tag[stop] == 2 * kind + 2:
            stop += 1
        found.append((float(gain[at:stop].sum()), (KINDS[kind], start + at, start + stop)))
        at = stop
    return found


def reconciled(weighted: list[tuple[float, Span]]) -> list[Span]:
    """The heaviest set of spans that do not overlap, over all windows of a text."""
    best: dict[Span, float] = {}
    for weight, span in weighted:
        best[span] = max(weight, best.get(span, 0.0))
    spans = sorted(best, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in spans]
    totals, chosen = [0.0], []
    for n, span in enumerate(spans):
        before = int(np.searchsorted(ends[:n], span[1], side="right"))
        take = totals[before] + best[span]
        chosen.append((take > totals[n], before))
        totals.append(max(take, totals[n]))
    result, n = [], len(spans)
    while n:
        taken, before = chosen[n - 1]
        if taken:
            result.append(spans[n - 1])
            n = before
        else:
            n -= 1
    return result[::-1]


def find(bodies: list[str], network: Network) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) per text. A network span that overlaps a base span is left out."""
    owners, starts = [], []
    for n, body in enumerate(bodies):
        for start in window_starts(body):
            owners.append(n)
            starts.append(start)
    weighted: list[list[tuple[float, Span]]] = [[] for _ in bodies]
    for first in range(0, len(owners), RUN):
        part = range(first, min(first + RUN, len(owners)))
        tag, gain = network.decode(np.stack([padded(bodies[owners[i]], starts[i]) for i in part]))
        for row, i in enumerate(part):
            weighted[owners[i]].extend(spans_of(tag[row], gain[row], starts[i]))
    result = []
    for body, found in zip(bodies, weighted):
        base = base_spans(body)
        taken = base
        if found:
            found = [(w, s) for w, s in found if w > 0 and plausible(s[0], body[s[1] : s[2]])]
            extra = [s for s in reconciled(found) if not any(s[1] < e and b < s[2] for _, b, e in base)]
            taken = in_order(base + extra)
        result.append((base, taken))
    return result


def made_windows(count: int = MADE_WINDOWS) -> list[tuple[str, list[Span]]]:
    """Windows with variants of the kinds, and with look-alikes that are none."""
    random = np.random.default_rng(3)

    def number(length: int) -> str:
        return "".join(str(d) for d in random.integers(0, 10, length))

    def word() -> str:
        return "".join("etaoinshrdlucmfwypvbgk"[i] for i in random.integers(0, 22, random.integers(1, 12)))

    def card() -> str:
        body = number(15)
        return body + next(d for d in "0123456789" if luhn(body + d))

    def grouped(digits: str, mark: str) -> str:
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))

    makers = [
        ("email", lambda: f"{word()}.{number(2)}@{word()}{number(1)}.example.com"),
        ("email", lambda: f"{word()}@{word()}.{random.choice(['com', 'org', 'net', 'de'])}"),
        ("email", lambda: f"{word()} @ {word()}.{random.choice(['com', 'org', 'net', 'de'])}"),
        ("ip", lambda: ".".join(str(p) for p in random.integers(0, 256, 4))),
        ("card", card),
        ("card", lambda: grouped(card(), random.choice([" ", "-", "."]))),
        ("phone", lambda: f"+{number(1)} ({number(3)}) {number(3)}-{number(4)}"),
        ("phone", lambda: f"+{number(2)} {number(3)} {number(7)}"),
        ("phone", lambda: f"({number(3)}) {number(3)}-{number(4)}"),
        ("phone", lambda: f"{number(3)}-{number(3)}-{number(4)}"),
        (None, lambda: hashlib.sha1(number(9).encode()).hexdigest()),
        (None, lambda: f"20{number(2)}-0{number(1)}-1{number(1)}"),
        (None, lambda: f"{number(1)}.{number(1)}.{number(2)}"),
        (None, lambda: f"{number(2)}:{number(2)}:{number(2)}"),
        (None, lambda: number(int(random.integers(1, 9)))),
        (None, lambda: f"{number(3)},{number(2)} @{word()}"),
        (None, word),
    ]
    windows = []
    for n in range(count):
        kind, make = makers[n % len(makers)]
        before = " ".join(word() for _ in range(random.integers(0, 8)))
        before += random.choice([" ", " ", ": ", ', "', " (", "\n"]) if before else ""
        item = make()
        after = random.choice([" ", " ", ", ", ". ", '" ', ") ", "\n", "*** ", "!! "])
        after += " ".join(word() for _ in range(random.integers(0, 9)))
        text = (before + item + after)[:WINDOW]
        end = len(before) + len(item)
        windows.append((text, [(kind, len(before), end)] if kind and end <= len(text) else []))
    return windows


def fit(documents: DataFrame) -> dict[str, np.ndarray]:
    """Weights learned in one task from at most `TRAIN_WINDOWS` windows of `documents` and made ones."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bodies, labels = [], [], []
            for text in texts(batch):
                spans = base_spans(text)
                for kind, start, end in spans[:PER_DOCUMENT]:
                    if end - start > STRIDE:
                        continue
                    key = hashlib.blake2b(f"{start}:{text[start:end]}".encode(), digest_size=7).hexdigest()
                    low = max(0, start - int(key[:2], 16) % (WINDOW - (end - start)))
                    part = text[low : low + WINDOW]
                    inside = [(k, s - low, e - low) for k, s, e in spans if s >= low and e <= low + len(part)]
                    keys.append(key)
                    bodies.append(part)
                    labels.append(joined(inside))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (keys, bodies, labels)], ["key", "body", "spans"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = made_windows()
        for batch in batches:
            for body, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in label.split(",") if x)]
                windows.append((body, spans))
        network = learned(windows)
        names = sorted(network.w)
        columns = [pa.array(names), pa.array([network.w[n].tobytes() for n in names], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["name", "weights"])

    found = map_batches(documents.select("text"), cut, "key string, body string, spans string")
    sample = found.dropDuplicates(["key"]).orderBy("key").limit(TRAIN_WINDOWS)
    ordered = sample.repartition(1).sortWithinPartitions("key")
    rows = map_batches(ordered, learn, "name string, weights binary").collect()
    if not rows:  # Spark skips the task when no row can come
        return learned(made_windows()).w
    shapes = {name: value.shape for name, value in Network().w.items()}
    return {r["name"]: np.frombuffer(r["weights"], np.float32).reshape(shapes[r["name"]]) for r in rows}


def learned(windows: list[tuple[str, list[Span]]]) -> Network:
    network = Network()
    inputs = np.stack([padded(text, 0) for text, _ in windows])
    network.train(inputs, np.stack([tags(WINDOW, spans) for _, spans in windows]))
    return network


def personal_data(documents: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """Per row: doc_id, counts of the base spans by kind, base_sha256, spans, n_added.

    `spans` lists base and added spans as kind:start:end by start, in code points, end
    exclusive. A null text is empty and has none. Null and repeated ids are passed on, one result
    row per input row; only doc_id and text are read. The network is trained on `documents`
    unless `weights` are given. A span that only the network finds is at most one window long.
    """
    shared = documents.sparkSession.sparkContext.broadcast(weights if weights is not None else fit(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(shared.value)
        for batch in batches:
            found = find(texts(batch, "text"), network)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            digests = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            columns = [
                batch.column(0),
                *counts,
                pa.array(digests, pa.string()),
                pa.array([joined(taken) for _, taken in found], pa.string()),
                pa.array([len(taken) - len(base) for base, taken in found], pa.int64()),
            ]
            names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]
            yield pa.RecordBatch.from_arrays(columns, names)

    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return map_batches(
        documents.select("doc_id", "text"), run, f"doc_id bigint, {counts}, base_sha256 string, spans string, n_added bigint"
    )


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one mark."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out.append(text[at:start] + f"<{kind}>")
        at = max(at, end)
    return "".join(out) + text[at:]


def redacted(documents: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """`documents` with personal data masked in `text` and `n_chars` set to the new length.

    All other columns and all rows stay; a null text stays null, an n_chars column is only
    written where there is one.
    """
    shared = documents.sparkSession.sparkContext.broadcast(weights if weights is not None else fit(documents))
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(shared.value)
        for batch in batches:
            columns = list(batch.columns)
            bodies = batch.column(names.index("text")).to_pylist()
            found = find([b or "" for b in bodies], network)
            clean = [None if b is None else mask(b, taken) for b, (_, taken) in zip(bodies, found)]
            columns[names.index("text")] = pa.array(clean, batch.schema.field(names.index("text")).type)
            if "n_chars" in names:
                kind = batch.schema.field(names.index("n_chars")).type
                old = batch.column(names.index("n_chars")).to_pylist()
                sizes = [o if c is None else len(c) for o, c in zip(old, clean)]
                columns[names.index("n_chars")] = pa.array(sizes, kind)
            yield pa.RecordBatch.from_arrays(columns, names)

    ship = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    return map_batches(documents, run, ship)
