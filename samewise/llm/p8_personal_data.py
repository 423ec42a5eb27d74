"""Problem 8: personal information in free text, found and replaced by typed placeholders.

Method: a linear-chain conditional random field over word-shape features. It is trained from the small labelled table
of p8_labelled (rows are a documented parameter) by gradient descent on the exact likelihood (forward-backward over
batches of lines). That is done once, by ``python -m samewise.llm.p8_personal_data``, which writes the weights to
p8_model.npz beside this file; queries read and broadcast them (under MOST_BYTES, which is checked). Lines are decoded by
Viterbi in numpy, many lines at once; no rule looks at a mention after that.

Tokens are runs of letters, runs of digits and single other characters; white space only tells how tokens are apart.
A token's features are its word if the table has it, its shape, length and ending, the same of its neighbours, shapes in
a row, its place in a short line, and what its white-space-delimited piece holds. A line in which no token could begin a mention that pays, whatever
the transitions, has the empty labelling as its best one and isn't decoded further; this bound is exact.

Defined results: null keys and texts and texts without mentions give no rows; equal mentions of a document give one row;
texts and lines of any length are tagged whole; repeated rows change nothing; other columns are ignored.
"""

from __future__ import annotations

import io
import os
from collections import Counter
from collections.abc import Iterator
from functools import cache
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text as T
from .p8_labelled import KINDS, labelled

TABLE_ROWS = 100_000  # of the labelled table
LEAST_WEIGHT = 0.02  # smaller weights aren't kept
MOST_BYTES = 64 << 20  # of the weights
SPAN = 4  # neighbours on either side whose features count
LABELS = 1 + 2 * len(KINDS)  # 0 outside; 1 + 2k begins and 2 + 2k continues a mention of kind k
HASHED = 1 << 13
KEPT_TOKENS = 1 << 19  # a worker looks tokens up anew beyond this many
NONE = -1e4
MODEL = "p8_model.npz"


@cache
def char_classes() -> np.ndarray:
    """0 line end, 1 white space, 2 letter, 3 digit, 4 other."""
    table = np.full(T.CODE_POINTS, 4, np.uint8)
    table[np.flatnonzero(T.is_word_char())] = 2
    table[[c for c in np.flatnonzero(T.is_word_char()).tolist() if chr(c).isdecimal()]] = 3
    table[np.flatnonzero(T.is_space_char())] = 1
    table[[10, 13]] = 0
    return table


_SHAPES = [*".,-()[]<>@+/:;|#=_º—*\"'{}!?%", "X", "Xx", "XX", "x", "xX", "other", "d1", "d2", "d3", "d4", "d5", "d6", "d7", "d8", "d9", "d10", "D"]
_SHAPE_OF = {s: i for i, s in enumerate(_SHAPES)}


def shape(token: str) -> str:
    if token[0].isdecimal():
        return f"d{len(token)}" if len(token) <= 10 else "D"
    if not token[0].isalpha():
        return token if token in _SHAPE_OF else "other"
    if token.islower() or not token[0].isupper():
        return "x" if token == token.lower() else "xX"
    return "X" if len(token) == 1 else "XX" if token.isupper() else "Xx" if token[1:].islower() else "xX"


def token_features(token: str) -> list[str]:
    s, low = shape(token), token.lower()
    out = [f"s={s}", f"w={low}"]
    if token[0].isalpha():
        out += [f"l={s}{min(len(token), 12) // 2}", f"3={s}{low[-3:]}", f"4={s}{low[-4:]}", f"2={low[-2:]}", f"^={s}{low[:3]}"]
    return out


class Tokens:
    """The tokens of some texts, laid out one line after another."""

    def __init__(self, texts: list[str]):
        data, self.begins = T.code_points(texts)
        kind = char_classes()[data]
        same = (kind[1:] == kind[:-1]) & (kind[1:] < 4)
        edge = np.concatenate(([0], np.flatnonzero(~same) + 1))
        run = kind[edge]
        stops = np.append(edge[1:], len(data))
        real = run >= 2
        self.starts, self.stops = edge[real], stops[real]
        n = len(self.starts)
        self.hashes = T.span_hashes(T.char_values()[data], self.starts, self.stops)
        # white space before a token: 0 none, 1 some, 2 a new line
        before = np.searchsorted(edge[run == 0], self.starts)
        line = np.concatenate(([True], before[1:] != before[:-1])) if n else np.zeros(0, bool)
        spaced = np.concatenate(([True], self.starts[1:] != self.stops[:-1])) if n else np.zeros(0, bool)
        self.gap = np.where(line, 2, spaced).astype(np.int64)
        self.lines = np.flatnonzero(line)
        self.data = data

    def text(self, k: int) -> str:
        return self.data[self.starts[k] : self.stops[k]].tobytes().decode("utf-32-le", "surrogatepass")


class Tagger:
    """Features and weights."""

    def __init__(self) -> None:
        self.names: dict[str, int] = {}
        self.types: dict[int, int] = {}  # token's hash -> row of the tables below
        self.rows_of: dict[tuple, int] = {}  # tokens with the same features share a row
        self.type_features: list[list[int]] = []
        self.type_shapes: list[int] = []
        self.marks: list[int] = []  # 1 for @, 2 for "at", 3 for "dot"
        self.transitions = np.zeros((LABELS, LABELS), np.float32)
        self.weights: np.ndarray | None = None  # (feature, neighbour, label)
        self.hashed: np.ndarray | None = None
        self.rows: np.ndarray | None = None  # the weights of each row's features summed, by neighbour
        self.summed = 0

    def type_ids(self, t: Tokens) -> np.ndarray:
        found, first, back = np.unique(t.hashes, return_index=True, return_inverse=True)
        if len(self.types) > KEPT_TOKENS:
            self.types.clear()
        ids = np.empty(len(found), np.int64)
        for i, h in enumerate(found.tolist()):
            k = self.types.get(h)
            if k is None:
                token = t.text(int(first[i]))
                features = tuple(f for x in token_features(token) if (f := self.names.get(x)) is not None)
                mark = {"@": 1, "at": 2, "dot": 3}.get(token.lower(), 0)
                k = self.rows_of.setdefault((features, mark, s := _SHAPE_OF[shape(token)]), len(self.rows_of))
                self.types[h] = k
                if k == len(self.type_features):
                    self.type_features.append(features)
                    self.type_shapes.append(s)
                    self.marks.append(mark)
            ids[i] = k
        return ids[back]

    def positions(self, t: Tokens, types: np.ndarray) -> list[np.ndarray]:
        """Rows of the hashed table for each token: shapes in a row, spacing, and what the piece holds."""
        n = len(types)
        sh = np.array(self.type_shapes, np.int64)[types] if n else np.zeros(0, np.int64)
        mark = np.array(self.marks, np.int64)[types] if n else np.zeros(0, np.int64)
        g = t.gap
        line = np.cumsum(g == 2)

        def at(x: np.ndarray, step: int, default: int) -> np.ndarray:
            """x of the token ``step`` further on the same line."""
            out = np.full(n, default, np.int64)
            if abs(step) < n:
                a, b = (slice(None, n - step), slice(step, None)) if step > 0 else (slice(-step, None), slice(None, n + step))
                out[a] = np.where(line[a] == line[b], x[b], default)
            return out

        s = {k: at(sh, k, 63) if k else sh for k in range(-2, 4)}
        gaps = {k: at(g, k, 2) if k else g for k in range(-1, 4)}
        piece = np.cumsum(g > 0)
        has_at = (np.bincount(piece, mark == 1, int(piece[-1]) + 1)[piece] > 0).astype(np.int64) if n else mark

        begin = np.flatnonzero(g == 2)
        sizes = np.diff(np.append(begin, n))
        size, place = np.minimum(np.repeat(sizes, sizes), 7), np.minimum(np.arange(n) - np.repeat(begin, sizes), 4)

        def ahead(kind: int, most: int) -> np.ndarray:
            where = np.flatnonzero(mark == kind) if kind != 2 else np.flatnonzero((mark == 1) | (mark == 2))
            if not len(where):
                return np.full(n, most)
            k = np.searchsorted(where, np.arange(n))
            nxt = where[np.minimum(k, len(where) - 1)]
            d = np.where((k < len(where)) & (line[nxt] == line), nxt - np.arange(n), most)
            return np.minimum(d, most)

        def behind(most: int) -> np.ndarray:
            where = np.flatnonzero((mark == 1) | (mark == 2))
            if not len(where):
                return np.full(n, most)
            k = np.searchsorted(where, np.arange(n), "right") - 1
            prev = where[np.maximum(k, 0)]
            d = np.where((k >= 0) & (line[prev] == line), np.arange(n) - prev, most)
            return np.minimum(d, most)

        rows = [
            (s[-1], s[0], gaps[0]), (s[0], s[1], gaps[1]), (s[-1], s[0], s[1], gaps[0], gaps[1]), (s[0], s[1], s[2], gaps[1], gaps[2]), (s[-2], s[-1], s[0], gaps[-1], gaps[0]),
            (s[0], s[1], s[2], s[3], gaps[1], gaps[2], gaps[3]), (gaps[-1], gaps[0], gaps[1], gaps[2]), (has_at, at(has_at, 1, 2), s[0], gaps[0]),
            (ahead(2, 9), ahead(3, 9), behind(12), s[0]), (size, place, s[0], s[1]),
        ]
        out = []
        for k, parts in enumerate(rows):
            h = np.full(n, k + 1, np.uint64)
            for p in parts:
                h = (h * np.uint64(0x100000001B3)) ^ p.astype(np.uint64)
            out.append((T.mix(h, 8) >> np.uint64(64 - HASHED.bit_length() + 1)).astype(np.int64))
        return out

    def emissions(self, t: Tokens) -> np.ndarray:
        types = self.type_ids(t)
        need = len(self.type_features)
        if self.rows is None or need >= self.rows.shape[1]:
            more = np.zeros((2 * SPAN + 1, 2 * need + 1, LABELS), np.float32)
            if self.rows is not None:
                more[:, : self.summed] = self.rows[:, : self.summed]
            self.rows = more
        for k in range(self.summed, need):
            if self.type_features[k]:
                self.rows[:, k] = self.weights[list(self.type_features[k])].sum(0)
        self.summed = need
        n, beyond = len(types), self.rows.shape[1] - 1  # the last row stays empty, for what lies beyond a line
        out = np.take(self.rows[SPAN], types, 0)
        line = np.cumsum(t.gap == 2)
        for step in range(1, SPAN + 1):
            if step < n:
                same = line[step:] == line[:-step]
                out[:-step] += np.take(self.rows[SPAN + step], np.where(same, types[step:], beyond), 0)
                out[step:] += np.take(self.rows[SPAN - step], np.where(same, types[:-step], beyond), 0)
        for rows in self.positions(t, types):
            out += np.take(self.hashed, rows, 0)
        return out

    def decode(self, t: Tokens) -> np.ndarray:
        """The best labels of each line.

        A mention from token i to token j changes the score of the empty labelling by its emissions' and transitions'
        differences. v bounds that of one token; a token through which no stretch can gain is outside in the best
        labelling, so only the stretches between such tokens are decoded.
        """
        labels = np.zeros(len(t.starts), np.int8)
        if not len(labels):
            return labels
        score, a = self.emissions(t), self.transitions
        inner = float(a[1:, 1:].max() - a[0, 0])
        ends = float(a[0, 1:].max() - a[0, 0]) + float(a[1:, 0].max() - a[0, 0]) - inner
        v = (score[:, 1:].max(1) - score[:, 0]).astype(np.float64) + inner
        line = np.cumsum(t.gap == 2)

        def best_ending(v: np.ndarray, line: np.ndarray) -> np.ndarray:
            """The greatest sum of a stretch of the same line that ends here."""
            sums, far = np.cumsum(v), 1e6 * line
            return sums - (np.minimum.accumulate(sums - v - far) + far)

        through = best_ending(v, line) + best_ending(v[::-1], line[-1] - line[::-1])[::-1] - v + ends
        maybe = np.flatnonzero(through > -1e-3)
        if not len(maybe):
            return labels
        first = np.flatnonzero(np.concatenate(([True], (maybe[1:] != maybe[:-1] + 1) | (line[maybe[1:]] != line[maybe[:-1]]))))
        begin, sizes = maybe[first], np.diff(np.append(first, len(maybe)))
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            many = 1024 if sizes[order[min(at + 1023, len(order) - 1)]] <= 128 else 16  # few long stretches at once
            group = order[at : at + many]
            at += many
            size = sizes[group]
            longest = int(size[-1])
            place = begin[group][:, None] + np.minimum(np.arange(longest), (size - 1)[:, None])
            best = viterbi(score[place], a, size)
            inside = np.arange(longest) < size[:, None]
            labels[place[inside]] = best[inside]
        return labels


def viterbi(score: np.ndarray, transitions: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Best labels for lines padded to one length; past its end a line keeps its state."""
    n, length, k = score.shape
    back = np.empty((length, n, k), np.int8)
    now = score[:, 0] + transitions[0]  # a line begins as if after a token outside
    stay = np.broadcast_to(np.arange(k, dtype=np.int8), (n, k))
    for i in range(1, length):
        paths = now[:, :, None] + transitions
        live = (i < sizes)[:, None]
        arg = paths.argmax(1).astype(np.int8)
        back[i] = np.where(live, arg, stay)
        now = np.where(live, np.take_along_axis(paths, arg[:, None].astype(np.int64), 1)[:, 0] + score[:, i], now)
    out = np.empty((n, length), np.int8)
    out[:, -1] = (now + transitions[:, 0]).argmax(1)
    for i in range(length - 1, 0, -1):
        out[:, i - 1] = np.take_along_axis(back[i], out[:, i, None].astype(np.int64), 1)[:, 0]
    return out


def _marginals(score: np.ndarray, transitions: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the labels of padded lines, and of label pairs summed over all places: forward-backward with
    each place scaled to a sum of 1."""
    n, length, k = score.shape
    live = np.arange(length) < sizes[:, None]
    e, a = np.exp(score - score.max(2, keepdims=True)), np.exp(transitions)
    ahead = np.empty_like(e)
    now = a[0] * e[:, 0]
    ahead[:, 0] = now / now.sum(1, keepdims=True)
    for i in range(1, length):
        now = (ahead[:, i - 1] @ a) * e[:, i]
        ahead[:, i] = np.where(live[:, i, None], now / now.sum(1, keepdims=True), ahead[:, i - 1])
    behind = np.broadcast_to(a[:, 0], (n, k))
    out, pairs = np.empty_like(e), np.zeros((k, k))
    for i in range(length - 1, -1, -1):
        both = ahead[:, i] * behind
        out[:, i] = both / both.sum(1, keepdims=True) * live[:, i, None]
        if i:
            right = e[:, i] * behind
            total = ((ahead[:, i - 1] @ a) * right).sum(1)
            pairs += a * ((ahead[:, i - 1] / total[:, None]).T @ (right * live[:, i, None]))
            new = right @ a.T
            behind = np.where(live[:, i, None], new / new.sum(1, keepdims=True), behind)
    pairs[0] += out[:, 0].sum(0)
    pairs[:, 0] += out[np.arange(n), sizes - 1].sum(0)
    return out, pairs


def _allowed() -> np.ndarray:
    ok = np.ones((LABELS, LABELS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


def gold(t: Tokens, mentions: list[list[tuple[int, int, str]]]) -> np.ndarray:
    labels = np.zeros(len(t.starts), np.int64)
    for i, found in enumerate(mentions):
        for s, e, kind in found:
            a, z = np.searchsorted(t.starts, (t.begins[i] + s, t.begins[i] + e))
            labels[a:z] = 2 + 2 * KINDS.index(kind)
            labels[a] -= 1
    return labels


def train(rows: list[tuple[str, list[tuple[int, int, str]]]], rounds: int = 6, batch: int = 256, rate: float = 0.15, decay: float = 1e-6, seed: int = 1) -> Tagger:
    """The tagger fitted to labelled lines, by stochastic gradients with a step size of its own for each weight."""
    tagger = Tagger()
    t = Tokens([text for text, _ in rows])
    y = gold(t, [m for _, m in rows])
    count: Counter = Counter()
    found, first, times = np.unique(t.hashes, return_index=True, return_counts=True)
    for i, k in zip(first.tolist(), times.tolist(), strict=True):
        for f in token_features(t.text(i)):
            count[f] += k
    tagger.names = {f: i for i, f in enumerate(sorted(f for f, k in count.items() if k >= 3))}
    types = tagger.type_ids(t)
    n, wide = len(y), 2 * SPAN + 1
    hashed = tagger.positions(t, types)
    line = np.cumsum(t.gap == 2)
    # every active feature of every token as one row of one table of weights
    size = len(tagger.names) * wide
    token_list, row_list = [], []
    lens = np.array([len(f) for f in tagger.type_features])
    flat = np.array([f for fs in tagger.type_features for f in fs], np.int64)
    start = np.cumsum(lens) - lens
    for step in range(-SPAN, SPAN + 1):
        here = np.arange(max(0, -step), min(n, n - step))
        here = here[line[here] == line[here + step]]
        k = types[here + step]
        rep = np.repeat(here, lens[k])
        inner = np.arange(len(rep)) - np.repeat(np.cumsum(lens[k]) - lens[k], lens[k])
        token_list.append(rep)
        row_list.append(flat[np.repeat(start[k], lens[k]) + inner] * wide + step + SPAN)
    for h in hashed:
        token_list.append(np.arange(n))
        row_list.append(h + size)
    token, row = np.concatenate(token_list), np.concatenate(row_list)
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    where = np.searchsorted(token, np.arange(n + 1))
    weights, square = np.zeros((size + HASHED, LABELS), np.float32), np.full((size + HASHED, LABELS), 1e-2, np.float32)
    trans, trans_square = np.where(_allowed(), 0.0, NONE), np.full((LABELS, LABELS), 1e-2)
    bounds = np.append(t.lines, n)
    lines = np.arange(len(t.lines))
    rng = np.random.default_rng(seed)
    for r in range(rounds):
        step_size = rate * (1 - r / (rounds + 1))
        mixed = rng.permutation(lines)
        for b in range(0, len(mixed), batch):
            group = mixed[b : b + batch]
            sizes = bounds[group + 1] - bounds[group]
            place = bounds[group][:, None] + np.minimum(np.arange(sizes.max()), (sizes - 1)[:, None])
            inside = np.arange(sizes.max()) < sizes[:, None]
            flat_place = place[inside]
            reps = where[flat_place + 1] - where[flat_place]
            entry = np.repeat(where[flat_place], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            rows_used = row[entry]
            sums = np.add.reduceat(weights[rows_used], np.cumsum(reps) - reps)
            score = np.zeros((*place.shape, LABELS))
            score[inside] = sums
            prob, pairs = _marginals(score, trans, sizes)
            grad = prob[inside].astype(np.float32)
            grad[np.arange(len(flat_place)), y[flat_place]] -= 1
            # the gradient of each row that is used
            sort = np.argsort(rows_used, kind="stable")
            used = rows_used[sort]
            begin = np.flatnonzero(np.concatenate(([True], used[1:] != used[:-1])))
            g = np.add.reduceat(np.repeat(grad, reps, 0)[sort], begin) / len(group)
            u = used[begin]
            g += decay * weights[u]
            square[u] += g * g
            weights[u] -= step_size * g / np.sqrt(square[u])
            before = np.concatenate(([0], y[:-1]))[flat_place]
            before[t.gap[flat_place] == 2] = 0
            np.subtract.at(pairs, (before, y[flat_place]), 1)
            np.subtract.at(pairs, (y[bounds[group + 1] - 1], 0), 1)
            pairs /= len(group)
            trans_square += pairs * pairs
            trans = np.where(_allowed(), trans - step_size * pairs / np.sqrt(trans_square), NONE)
    tagger.weights, tagger.hashed = weights[:size].reshape(len(tagger.names), wide, LABELS), weights[size:]
    tagger.transitions = trans.astype(np.float32)
    # rows of the training tokens aren't carried to the workers
    tagger.types, tagger.rows_of, tagger.type_features, tagger.type_shapes, tagger.marks = {}, {}, [], [], []
    return tagger


def dump(tagger: Tagger) -> bytes:
    """The weights that aren't next to nothing."""
    names, flat = sorted(tagger.names, key=tagger.names.get), tagger.weights.reshape(len(tagger.names), -1)
    row, column = np.nonzero(np.abs(flat) > LEAST_WEIGHT)
    used = np.unique(row)
    out = io.BytesIO()
    np.savez_compressed(
        out, names=np.array("\n".join(names[k] for k in used.tolist()).encode()), row=np.searchsorted(used, row).astype(np.uint16), column=column.astype(np.uint8),
        value=flat[row, column].astype(np.float16), hashed=tagger.hashed.astype(np.float16), transitions=tagger.transitions,
    )
    return out.getvalue()


def restore(data: bytes) -> Tagger:
    f, tagger = np.load(io.BytesIO(data)), Tagger()
    names = bytes(f["names"]).decode().split("\n")
    tagger.names = {x: i for i, x in enumerate(names)}
    weights = np.zeros((len(names), (2 * SPAN + 1) * LABELS), np.float32)
    weights[f["row"], f["column"]] = f["value"]
    tagger.weights, tagger.hashed, tagger.transitions = weights.reshape(len(names), 2 * SPAN + 1, LABELS), f["hashed"].astype(np.float32), f["transitions"]
    return tagger


@cache
def trained() -> Tagger:
    tagger = restore(files(__package__).joinpath(MODEL).read_bytes())
    if tagger.weights.nbytes + tagger.hashed.nbytes > MOST_BYTES:
        raise ValueError(f"weights of more than {MOST_BYTES} bytes aren't broadcast")
    return tagger


def tag(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Start, end and kind of each mention in each text, in order."""
    t = Tokens(texts)
    labels = tagger.decode(t)
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    firsts = np.flatnonzero(labels % 2 == 1)
    ends = np.append(np.flatnonzero((labels == 0) | (labels % 2 == 1)), len(labels))
    after = ends[np.searchsorted(ends, firsts, "right")]
    newline = np.append(t.lines, len(labels))
    after = np.minimum(after, newline[np.searchsorted(newline, firsts, "right")])
    of = np.searchsorted(t.begins, t.starts[firsts], "right") - 1
    for k, a, z, d in zip(labels[firsts].tolist(), firsts.tolist(), after.tolist(), of.tolist(), strict=True):
        kind, base = KINDS[(k - 1) // 2], int(t.begins[d])
        out[d].append((int(t.starts[a]) - base, int(t.stops[z - 1]) - base, kind))
    return out


def _tagging(documents: DataFrame, key: str, text: str, handle, schema: str, tagger: Tagger | None) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(tagger or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for i, j in T.blocks(texts):
                yield handle(keys.slice(i, j - i), texts[i:j], tag(tagger, texts[i:j]))

    rows = documents.select(key, text).where(f"{key} is not null and {text} is not null")
    return rows.mapInArrow(run, schema)


def mentions(documents: DataFrame, key: str = "doc_id", text: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """``key, kind, found``: each piece of personal information of each document, once, as it stands in the text."""

    def handle(keys: pa.Array, texts: list[str], found: list[list[tuple[int, int, str]]]) -> pa.RecordBatch:
        rows = [(i, kind, t[s:e]) for i, (t, f) in enumerate(zip(texts, found, strict=True)) for s, e, kind in f]
        rows = list(dict.fromkeys(rows))
        of = pa.array([r[0] for r in rows], pa.int64())
        return pa.RecordBatch.from_arrays([keys.take(of), *(pa.array([r[k] for r in rows], pa.string()) for k in (1, 2))], [key, "kind", "found"])

    kind = documents.schema[key].dataType.simpleString()
    return _tagging(documents, key, text, handle, f"{key} {kind}, kind string, found string", tagger).distinct()


def redacted(documents: DataFrame, key: str = "doc_id", text: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """``key, text, mentions``: each text with a placeholder such as [EMAIL] for each mention and otherwise unchanged."""

    def handle(keys: pa.Array, texts: list[str], found: list[list[tuple[int, int, str]]]) -> pa.RecordBatch:
        out = []
        for t, f in zip(texts, found, strict=True):
            parts, last = [], 0
            for s, e, kind in f:
                parts += [t[last:s], f"[{kind.upper()}]"]
                last = e
            out.append("".join([*parts, t[last:]]))
        return pa.RecordBatch.from_arrays([keys, pa.array(out, pa.string()), pa.array([len(f) for f in found], pa.int32())], [key, text, "mentions"])

    kind = documents.schema[key].dataType.simpleString()
    return _tagging(documents, key, text, handle, f"{key} {kind}, {text} string, mentions int", tagger)


if __name__ == "__main__":
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), MODEL), "wb") as out:
        out.write(dump(train(labelled(TABLE_ROWS))))
