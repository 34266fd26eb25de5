"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features and those of the lines beside it give its own odds, and
two weights favour runs of like lines. Forward-backward marginals of "good", weighted by line
length, average to the document's share of good text, which a logistic curve turns into a score.

Labels are of documents, so training starts from lines that have the label of their document; then
lines of low documents that the field finds good are relabelled, and the field is fitted anew. Lines
are measured in tasks, all of every document in the sample. The driver gets the measures, 48 bytes a line,
and goes on until the likelihood does not rise any more. Its memory grows with the lines of the sample, whose
documents are bounded by ``most``.

Edge cases: null and empty texts have no lines; their share of good text is 0. Each row gives one
row, and other columns are kept. Without labels of both kinds the score is the share of the label
that there is, or 0.5 without any.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corvid.llm.batches import sliced
from corvid.llm.learn import labelled_sample, logistic

N_OWN = 12
_ALPHA = bytes(c for c in range(256) if 65 <= c <= 90 or 97 <= c <= 122)
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_PLAIN = b" .,;:'\"-()?!\n"
_KEEP_UPPER = bytes(c for c in range(256) if c not in _UPPER)
_KEEP_DIGIT = bytes(c for c in range(256) if c not in _DIGIT)
_KEEP_SYMBOL = bytes(c for c in range(256) if c >= 128 or c in _ALPHA or c in _DIGIT or c in _PLAIN)
_KEEP_ALPHA = bytes(c for c in range(256) if c not in _ALPHA)


def own_features(line: str, seen: bool) -> list[float]:
    raw = line.encode()
    n, words = len(raw), line.split()
    k = len(words) or 1
    alpha = len(raw.translate(None, _KEEP_ALPHA))
    repeats = sum(map(str.__eq__, words, words[1:]))
    end = raw.rstrip()[-1:]
    return [
        1.0,
        math.log1p(len(line)) / 5,
        len(raw.translate(None, _KEEP_UPPER)) / (alpha or 1),
        min(len(raw.translate(None, _KEEP_SYMBOL)) / n * 5, 2.0),
        len(raw.translate(None, _KEEP_DIGIT)) / n * 3,
        repeats / k,
        len(set(words)) / k,
        raw.count(b"|") / k,
        raw.count(b"!!") / k,
        min(len(line) / k / 10, 3.0),
        float(end in (b".", b"!", b"?")),
        float(seen),
    ]


def lines_of(text: str | None) -> list[str]:
    return [x for x in (text or "").split("\n") if x.strip()]


def own_of(lines: list[str]) -> np.ndarray:
    """A row for each line: its own features."""
    seen: set[str] = set()
    own = np.zeros((len(lines), N_OWN))
    for i, x in enumerate(lines):
        own[i] = own_features(x, x in seen)
        seen.add(x)
    return own


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """With the features of the line before and of the line behind, none of which is all 0."""
    none = np.zeros((1, N_OWN))
    return np.hstack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none])]) if len(own) else np.zeros((0, 3 * N_OWN))


def features(lines: list[str]) -> np.ndarray:
    return with_neighbours(own_of(lines))


@dataclass
class Field:
    """Weights of a line's log-odds of good over bad; scores of good after good, bad after bad."""

    weights: np.ndarray
    stay: tuple[float, float]
    curve: tuple[float, float]
    constant: float | None = None

    def marginals(self, odds: list[float]) -> list[float]:
        """Log-odds of each line in its chain."""
        good, bad = math.exp(self.stay[0]), math.exp(self.stay[1])
        pass_on = lambda m: math.log((math.exp(m) * good + 1) / (math.exp(m) + bad))
        ahead, m = [], None
        for u in odds:
            m = max(-30.0, min(30.0, u + (0.0 if m is None else pass_on(m))))
            ahead.append(m)
        back = 0.0
        for i in range(len(odds) - 1, -1, -1):
            ahead[i] += back
            back = pass_on(max(-30.0, min(30.0, odds[i] + back)))
        return ahead

    def good_share(self, text: str | None) -> float:
        lines = lines_of(text)
        if not lines:
            return 0.0
        odds = np.clip(features(lines) @ self.weights, -30, 30).tolist()
        good = [1 / (1 + math.exp(-max(-30.0, min(30.0, m)))) for m in self.marginals(odds)]
        lengths = [len(x) for x in lines]
        return sum(map(float.__mul__, good, map(float, lengths))) / sum(lengths)

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.curve[0] * _logit(self.good_share(text)) + self.curve[1]))))


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


@dataclass
class Lines:
    """Measured lines of documents, the longest document first: all first lines, then all second ones, and so on.

    ``first`` is where the lines of each place begin; a line's document is its place among those.
    """

    x: np.ndarray
    length: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    order: np.ndarray

    @classmethod
    def of(cls, own: list[np.ndarray], length: list[np.ndarray]) -> Lines:
        sizes = np.array([len(o) for o in own], np.int64)
        order = np.argsort(-sizes, kind="stable")
        ordered = sizes[order]
        at = np.searchsorted(-ordered, -np.arange(ordered.max(initial=0)), side="left")
        first = np.r_[0, np.cumsum(at)].astype(np.int64)
        whole = np.vstack([with_neighbours(own[i]) for i in order]) if len(own) else np.zeros((0, 3 * N_OWN))
        doc = np.repeat(np.arange(len(order)), ordered)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(ordered) - ordered, ordered)
        turn = np.lexsort((doc, place))
        lengths = np.concatenate([length[i] for i in order]) if len(own) else np.zeros(0)
        return cls(whole[turn], lengths[turn], doc[turn], first, order)

    def places(self) -> list[slice]:
        return [slice(a, b) for a, b in zip(self.first, self.first[1:], strict=False)]


def _chain(lines: Lines, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Of a field: log weight of each document's labellings, marginals, and expected pairs of good and of bad lines."""
    w, gg, bb = theta[:-2], theta[-2], theta[-1]
    odds, places = lines.x @ w, lines.places()
    good, bad = odds.copy(), np.zeros(len(odds))
    last = np.zeros(len(lines.order), np.int64)
    for before, here in zip([None, *places], places, strict=False):
        m = here.stop - here.start
        last[:m] = np.arange(here.start, here.stop)
        if before is not None:
            g, b = good[before.start : before.start + m], bad[before.start : before.start + m]
            good[here] += np.logaddexp(g + gg, b)
            bad[here] = np.logaddexp(g, b + bb)
    there = len(places) and places[0].stop
    z = np.logaddexp(good[last[:there]], bad[last[:there]])
    after_g, after_b, p = np.zeros(there), np.zeros(there), np.zeros(len(odds))
    e_gg = e_bb = 0.0
    for before, here in zip([None, *places][::-1][1:], places[::-1], strict=True):
        m = here.stop - here.start
        g, b = after_g[:m], after_b[:m]
        p[here] = np.exp(good[here] + g - z[:m])
        if before is not None:
            one = odds[here] + g
            old_g, old_b = good[before.start : before.start + m], bad[before.start : before.start + m]
            e_gg += np.exp(old_g + gg + one - z[:m]).sum()
            e_bb += np.exp(old_b + bb + b - z[:m]).sum()
            after_g[:m], after_b[:m] = np.logaddexp(gg + one, b), np.logaddexp(one, bb + b)
    return z, p, e_gg, e_bb


def _loss(lines: Lines, good: np.ndarray, theta: np.ndarray, ridge: float = 1e-3) -> tuple[float, np.ndarray]:
    """Negative log-likelihood of a labelling, for each line, with a ridge; and its slope."""
    z, p, e_gg, e_bb = _chain(lines, theta)
    same_g = same_b = 0
    places = lines.places()
    for before, here in zip(places, places[1:], strict=False):
        old = good[before.start : before.start + here.stop - here.start]
        same_g += (old & good[here]).sum()
        same_b += (~old & ~good[here]).sum()
    w = theta[:-2]
    likely = (lines.x[good] @ w).sum() + same_g * theta[-2] + same_b * theta[-1] - z.sum()
    slope = np.r_[lines.x.T @ (good - p), same_g - e_gg, same_b - e_bb]
    n = len(lines.x)
    return -likely / n + ridge / 2 * theta @ theta, -slope / n + ridge * theta


def minimise(loss, theta: np.ndarray, rounds: int = 200, memory: int = 8, least: float = 1e-7) -> np.ndarray:
    """Limited-memory quasi-Newton steps with halving, until a step gains less than ``least``."""
    value, slope = loss(theta)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, held = -slope, []
        for s, y in reversed(steps):
            a = s @ way / (s @ y)
            held.append(a)
            way = way - a * y
        if steps:
            s, y = steps[-1]
            way = way * (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(held), strict=True):
            way = way + s * (a - y @ way / (s @ y))
        size = 1.0 if steps else min(1.0, 1 / (np.abs(slope).sum() + 1e-12))
        while True:
            then, new_slope = loss(theta + size * way)
            if then <= value + 1e-4 * size * (slope @ way) or size < 1e-10:
                break
            size /= 2
        step, turn = size * way, new_slope - slope
        if value - then < least * max(1.0, abs(value)):
            return theta + step if then < value else theta
        if step @ turn > 1e-12:
            steps = [*steps, (step, turn)][-memory:]
        theta, value, slope = theta + step, then, new_slope
    return theta


def train(own: list[np.ndarray], length: list[np.ndarray], labels: list[int]) -> Field:
    """The field for labelled documents, of which all lines' own features and lengths are given."""
    y = np.array(labels, dtype=bool)
    if len(set(labels)) < 2:
        return Field(np.zeros(3 * N_OWN), (0.0, 0.0), (0.0, 0.0), constant=float(y[0]) if len(y) else 0.5)
    lines = Lines.of(own, length)
    if not len(lines.x):
        return Field(np.zeros(3 * N_OWN), (0.0, 0.0), (0.0, 0.0), constant=float(y.mean()))
    y = y[lines.order]
    good = y[lines.doc]
    theta = minimise(lambda t: _loss(lines, good, t), np.zeros(3 * N_OWN + 2))
    # Lines of low documents that look good are good; each low document keeps its worst line.
    odds = lines.x @ theta[:-2]
    worst = np.lexsort((odds, lines.doc))
    worst = worst[np.r_[True, lines.doc[worst][1:] != lines.doc[worst][:-1]]]
    again = good | (odds > 0)
    again[worst[~y[lines.doc[worst]]]] = False
    theta = minimise(lambda t: _loss(lines, again, t), theta)
    field = Field(theta[:-2], (float(theta[-2]), float(theta[-1])), (1.0, 0.0))
    p = _chain(lines, theta)[1]
    weight = np.bincount(lines.doc, lines.length, len(y))
    share = np.bincount(lines.doc, lines.length * p, len(y)) / np.maximum(weight, 1)
    curve = logistic(np.array([[_logit(q)] for q in share]), y.astype(float), ridge=1e-4)
    field.curve = (float(curve[0]), float(curve[1]))
    return field


def measured(texts: DataFrame) -> DataFrame:
    """``y`` with the own features of each line, as 32-bit floats, and its length, of texts with ``text`` and ``y``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 50):
            lines = [lines_of(t) for t in batch.column(0).to_pylist()]
            own = [own_of(x).astype(np.float32).tobytes() for x in lines]
            length = [np.array([len(i) for i in x], np.float32).tobytes() for x in lines]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(own, pa.binary()), pa.array(length, pa.binary())], names=["y", "own", "length"])

    return texts.select("text", "y").mapInArrow(scan, "y int, own binary, length binary")


def train_on(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held_out: int = 2, most: int = 2000, **more) -> Field:
    """Fits on at most ``most`` documents of each label, all outside the held-out fold."""
    rows = measured(labelled_sample(docs, labels, label, folds, held_out, most=most, **more)).collect()
    rows.sort(key=lambda r: (r.y, r.own))
    floats = lambda raw: np.frombuffer(raw, np.float32).astype(float)
    return train([floats(r.own).reshape(-1, N_OWN) for r in rows], [floats(r.length) for r in rows], [r.y for r in rows])


def score_quality(docs: DataFrame, field: Field, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the quality score of each whole text; a column of that name is replaced."""
    out = docs.drop(name)
    names = out.columns
    schema = T.StructType([*out.schema.fields, T.StructField(name, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(batch.schema.get_field_index(text))
            scores = pa.array([sent.value.score(t.as_py()) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), scores], names=[*names, name])

    return out.mapInArrow(scan, schema)
