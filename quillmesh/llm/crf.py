"""Linear-chain conditional random field in numpy: training by full-batch gradient, Viterbi in batches.

A token's emission is the sum of three learned vectors: its own features, those of the token before and
those of the token after, plus one vector of document features. The token vectors are computed once for
each distinct token of a batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

LOW = -1e4


@dataclass
class Crf:
    labels: list[str]
    own: dict[str, np.ndarray] = field(default_factory=dict)
    prev: dict[str, np.ndarray] = field(default_factory=dict)
    next: dict[str, np.ndarray] = field(default_factory=dict)
    doc: dict[str, np.ndarray] = field(default_factory=dict)
    trans: np.ndarray | None = None
    start: np.ndarray | None = None

    def vectors(self, features: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        zero = np.zeros(len(self.labels))
        return tuple(sum((w[f] for f in features if f in w), zero) for w in (self.own, self.prev, self.next))

    def document(self, features: list[str]) -> np.ndarray:
        return sum((self.doc[f] for f in features if f in self.doc), np.zeros(len(self.labels)))


def allowed(labels: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Additive masks of transitions and starts: I-x only follows B-x or I-x."""
    n = len(labels)
    trans, start = np.zeros((n, n)), np.zeros(n)
    for j, b in enumerate(labels):
        if b.startswith("I"):
            start[j] = LOW
            for i, a in enumerate(labels):
                if a == "O" or a[1:] != b[1:]:
                    trans[i, j] = LOW
    return trans, start


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(sequences: list[tuple[list[list[str]], list[str], list[str]]], labels: list[str], steps: int = 120, l2: float = 0.02, rate: float = 0.3) -> Crf:
    """sequences: (features of each token, label of each token, document features)."""
    index: dict[tuple[str, str], int] = {}
    length = max(len(t) for t, _, _ in sequences)
    n, k = len(sequences), len(labels)
    rows, cols, ids = [], [], []
    gold = np.zeros((n, length), np.int64)
    mask = np.zeros((n, length), bool)
    at = {x: i for i, x in enumerate(labels)}
    for s, (tokens, tags, doc) in enumerate(sequences):
        for t in range(len(tokens)):
            gold[s, t], mask[s, t] = at[tags[t]], True
            fs = [("own", f) for f in tokens[t]] + [("doc", f) for f in doc]
            fs += [("prev", f) for f in tokens[t - 1]] if t else []
            fs += [("next", f) for f in tokens[t + 1]] if t + 1 < len(tokens) else []
            for f in fs:
                rows.append(s)
                cols.append(t)
                ids.append(index.setdefault(f, len(index)))
    rows, cols, ids = map(np.array, (rows, cols, ids))
    block, tmask, smask = np.zeros((len(index), k)), *allowed(labels)
    theta = [block, np.zeros((k, k)), np.zeros(k)]
    m1, m2 = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    last = mask.sum(1) - 1
    one = np.eye(k)
    for step in range(1, steps + 1):
        w, tr, st = theta[0], theta[1] + tmask, theta[2] + smask
        e = np.zeros((n, length, k))
        np.add.at(e, (rows, cols), w[ids])
        alpha = np.empty((n, length, k))
        alpha[:, 0] = st + e[:, 0]
        for t in range(1, length):
            alpha[:, t] = np.where(mask[:, t, None], e[:, t] + _lse(alpha[:, t - 1, :, None] + tr, 1), alpha[:, t - 1])
        beta = np.zeros((n, length, k))
        for t in range(length - 2, -1, -1):
            step_back = _lse(tr + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], step_back, 0)
        z = _lse(alpha[np.arange(n), last], 1)
        post = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        diff = one[gold] * mask[..., None] - post
        g0 = np.zeros_like(w)
        np.add.at(g0, ids, diff[rows, cols])
        pair = np.exp(alpha[:, :-1, :, None] + tr + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        seen = np.zeros((k, k))
        np.add.at(seen, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
        grads = [g0 / n - l2 * w / n, (seen - pair.sum((0, 1))) / n - l2 * theta[1] / n, (one[gold[:, 0]] - post[:, 0]).mean(0) - l2 * theta[2] / n]
        for i, g in enumerate(grads):
            m1[i] = 0.9 * m1[i] + 0.1 * g
            m2[i] = 0.999 * m2[i] + 0.001 * g * g
            theta[i] = theta[i] + rate * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)
    out = Crf(labels, trans=theta[1] + tmask, start=theta[2] + smask)
    for (kind, f), i in index.items():
        getattr(out, kind)[f] = theta[0][i]
    return out


def viterbi(model: Crf, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best labels of sequences padded to one length: emissions (n, t, k) -> (n, t) label numbers."""
    n, t_max, k = emissions.shape
    best = model.start + emissions[:, 0]
    back = np.zeros((n, t_max, k), np.int16)
    stay = np.arange(k)
    for t in range(1, t_max):
        through = best[:, :, None] + model.trans
        arg = through.argmax(1)
        live = (t < lengths)[:, None]
        back[:, t] = np.where(live, arg, stay)
        best = np.where(live, np.take_along_axis(through, arg[:, None, :], 1)[:, 0] + emissions[:, t], best)
    path = np.zeros((n, t_max), np.int64)
    path[:, -1] = best.argmax(1)
    for t in range(t_max - 1, 0, -1):
        path[:, t - 1] = back[np.arange(n), t, path[:, t]]
    return path


def shape(token: str) -> str:
    """Run-length-collapsed character classes: 'Mail7.example' -> 'Xxd.x'."""
    out = []
    for c in token:
        s = "d" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out)


def surely_o(model: Crf, emissions: np.ndarray) -> np.ndarray:
    """Of successive tokens (n, k): where no best path has another label than O, whatever the tokens around.

    If a path has y at t, O is put there, and B-x for an I-x behind it. Where that gains for all labels before and
    after, y is in no best path. The emission behind a chain's end may be any: it can only make a token less sure.
    """
    labels, trans = model.labels, model.trans
    o, ids = labels.index("O"), range(len(labels))
    step = lambda a, b: 0.0 if b is None else trans[a, b]
    first = {i: labels.index("B" + x[1:]) for i, x in enumerate(labels) if x.startswith("I")}
    lost = np.full(len(emissions), -np.inf)
    for y in ids:
        if y == o:
            continue
        enter = max(row[y] - row[o] for row in [*trans, model.start] if row[y] > LOW / 2)
        most = np.full(len(emissions), enter + max(step(y, b) - step(o, b) for b in [*ids, None] if b not in first))
        for i, b in first.items():
            if trans[y, i] > LOW / 2:
                leave = max(step(i, c) - step(b, c) for c in [*ids, None] if step(i, c) > LOW / 2)
                swap = emissions[1:, i] - emissions[1:, b] + enter + trans[y, i] - trans[o, b] + leave
                most[:-1] = np.maximum(most[:-1], swap)
        lost = np.maximum(lost, emissions[:, y] - emissions[:, o] + most)
    return lost < -1e-6


def blocks(texts: list[str], token: re.Pattern) -> Iterator[list[tuple[int, int, int]]]:
    """(text number, start, end) of the texts in blocks of some PIECE characters; longer texts are cut behind tokens.
    A token is a maximal run of one class of characters."""
    block, size = [], 0
    for n, text in enumerate(texts):
        a = 0
        while a < len(text):
            last = token.search(text, a + PIECE) if len(text) - a > PIECE else None
            b = last.end() if last else len(text)
            if block and size + b - a > PIECE:
                yield block
                block, size = [], 0
            block.append((n, a, b))
            a, size = b, size + b - a
    if block:
        yield block


#: Sequences of one decode call; bounds the memory of a Viterbi batch together with its longest sequence.
BATCH = 512
#: Characters of texts that are scored at once, and tokens and their characters whose vectors are kept.
PIECE, KNOWN, KNOWN_CHARS = 200_000, 100_000, 4_000_000


class Tagger:
    """label() decodes every token of whole texts. decode() is for runs of tokens between others that the caller fixes
    to O, which cuts the chain exactly there; each run has the features of its neighbours."""

    def __init__(self, model: Crf, features):
        self.model, self.features = model, features
        self.cache: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        sides = (model.own, model.prev, model.next)
        self.weight_of = {f: i + 1 for i, f in enumerate(dict.fromkeys(f for w in sides for f in w))}
        self.weights = np.zeros((len(self.weight_of) + 1, 3, len(model.labels)))
        for j, w in enumerate(sides):
            for f, x in w.items():
                self.weights[self.weight_of[f], j] = x
        self.forget()

    def forget(self) -> None:
        self.known, self.known_chars = {"": 0}, 0  # "" stands for no token and has no vectors
        self.table = np.zeros((1024, 3, len(self.model.labels)))

    def rows(self, tokens: list[str]) -> np.ndarray:
        """The tokens' rows of the table of vectors, valid until the next call."""
        if len(self.known) > KNOWN or self.known_chars > KNOWN_CHARS:
            self.forget()
        new, used, starts = set(tokens) - self.known.keys(), [], []
        weight_of, features = self.weight_of.get, self.features
        for t in new:
            starts.append(len(used))
            used.append(0)
            used += [weight_of(f, 0) for f in features(t)]  # row 0 is of none
        if new:
            at = len(self.known)
            self.known.update(zip(new, range(at, at + len(new)), strict=True))
            self.known_chars += sum(map(len, new))
            if len(self.known) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((len(self.known), *self.table.shape[1:]))])
            self.table[at : at + len(new)] = np.add.reduceat(self.weights[used], starts)
        return np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))

    def label(self, texts: list[str], token: re.Pattern, docs: list[np.ndarray]) -> list[list[tuple[str, int, int]]]:
        """(label, start, end) of every token of each text whose best label is not O; docs: the texts' vectors.

        All tokens of all texts are scored. Where O is sure the chain is cut, and the rest is decoded.
        """
        labels, o = self.model.labels, self.model.labels.index("O")
        number, before = [0] * len(texts), [""] * len(texts)
        parts: list[list[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]] = [[] for _ in texts]
        for block in blocks(texts, token):
            flat, at = [], []
            for n, a, b in block:
                found, behind = token.findall(texts[n], a, b), token.search(texts[n], b)
                at.append((len(flat) + 1, len(flat) + 1 + len(found)))
                flat += [before[n], *found, behind[0] if behind else ""]
                before[n] = found[-1] if found else before[n]
            r = self.rows(flat)
            e = np.zeros((len(flat), len(labels)))
            e[1:-1] = self.table[r[1:-1], 0] + self.table[r[:-2], 1] + self.table[r[2:], 2]
            for (n, _, _), (s, t) in zip(block, at, strict=True):
                e[s:t] += docs[n]
            sure = surely_o(self.model, e)
            for (n, a, b), (s, t) in zip(block, at, strict=True):
                if t > s and flat[t]:
                    sure[t - 1] = False  # the emission behind it is in the next block
                left = np.flatnonzero(~sure[s:t])
                if len(left):
                    where = [m.span() for m in token.finditer(texts[n], a, b)]
                    parts[n].append((left + number[n], e[s:t][left], [where[x] for x in left]))
                number[n] += t - s
        runs = []
        for n, found in enumerate(parts):
            if found:
                left, e, where = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]), [y for x in found for y in x[2]]
                cuts = [0, *(np.flatnonzero(np.diff(left) > 1) + 1), len(left)]
                for s, t in zip(cuts, cuts[1:], strict=False):
                    if left[s] > 0:
                        e[s] += self.model.trans[o] - self.model.start
                    if left[t - 1] + 1 < number[n]:
                        e[t - 1] += self.model.trans[:, o]
                    runs.append((n, e[s:t], where[s:t]))
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        for (n, _, where), path in zip(runs, self.paths([e for _, e, _ in runs]), strict=True):
            out[n] += [(labels[x], *span) for x, span in zip(path, where, strict=True) if x != o]
        return out

    def paths(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """Best label numbers of each sequence (t, k)."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(emissions)
        order = sorted(range(len(emissions)), key=lambda i: len(emissions[i]))
        while order:
            part = order[:BATCH]
            while len(part) > 1 and len(part) * len(emissions[part[-1]]) > 200_000:
                part = part[: len(part) // 2]
            order = order[len(part) :]
            lengths = np.array([len(emissions[i]) for i in part])
            e = np.zeros((len(part), lengths.max(), len(self.model.labels)))
            for r, i in enumerate(part):
                e[r, : lengths[r]] = emissions[i]
            for i, path, n in zip(part, viterbi(self.model, e, lengths), lengths, strict=True):
                out[i] = path[:n]
        return out

    def of(self, token: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = self.cache.get(token)
        if got is None:
            if len(self.cache) > 50_000:
                self.cache.clear()
            got = self.cache[token] = self.model.vectors(self.features(token))
        return got

    def decode(self, runs: list[tuple[str | None, list[str], str | None, np.ndarray]]) -> list[list[str]]:
        """runs: (token before, tokens, token after, document vector) -> labels of each run."""
        out: list[list[str]] = [[] for _ in runs]
        order = sorted(range(len(runs)), key=lambda i: len(runs[i][1]))
        k, o = len(self.model.labels), self.model.labels.index("O")
        while order:
            part = order[:BATCH]
            while len(part) > 1 and len(part) * len(runs[part[-1]][1]) > 200_000:
                part = part[: len(part) // 2]
            order = order[len(part) :]
            lengths = np.array([len(runs[i][1]) for i in part])
            e = np.zeros((len(part), max(1, lengths.max()), k))
            for r, i in enumerate(part):
                before, tokens, after, doc = runs[i]
                vec = [self.of(x) for x in tokens]
                for t, (own, _, _) in enumerate(vec):
                    e[r, t] = own + doc
                    if t:
                        e[r, t] += vec[t - 1][1]
                    elif before is not None:
                        e[r, t] += self.of(before)[1]
                    if t + 1 < len(vec):
                        e[r, t] += vec[t + 1][2]
                    elif after is not None:
                        e[r, t] += self.of(after)[2]
                # the fixed O on either side takes part through its transitions
                e[r, 0] += (self.model.trans[o] if before is not None else self.model.start) - self.model.start
                if after is not None:
                    e[r, lengths[r] - 1] += self.model.trans[:, o]
            path = viterbi(self.model, e, lengths)
            for r, i in enumerate(part):
                out[i] = [self.model.labels[x] for x in path[r, : lengths[r]]]
        return out
