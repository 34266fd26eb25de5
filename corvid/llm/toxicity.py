"""Toxicity from a weighted finite-state grammar over clauses.

A lexical transducer turns words into tags: insult, threat, target, negation, report. Four more
follow what came before in the clause: a negation, a target and an insult or threat reach a few words, a
report the rest of its clause. Their product reads the tags of a clause and says, for each insult or threat,
whether it is aimed, negated or reported; a target soon behind a plain one aims it after all. Only matched
clauses count: a document is scored by how many there are of each kind, the kind of a clause being that
of its heaviest match, by their weights, by the heaviest of all, and by the share of clauses that match.

Insults are learned: words, and beginnings of words, that toxic documents have significantly more
often than others, all of them. So is the weight of each kind of match.

Edge cases: null and empty texts have no clauses and get the score of a text without matches. Each
row gives one row, and other columns are kept. Without labels of both kinds, fixed weights serve.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.llm.batches import sliced
from corvid.llm.learn import labelled_sample, logistic

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
# Common words of the grammar in the four languages of the documents.
WORDS = {
    INSULT: "idiot moron stupid dumb loser scum trash worthless pathetic disgusting clown imbecile crétin abruti débile dumm trottel abschaum estúpido imbécil basura",
    THREAT: "kill murder destroy hurt beat burn hang shoot tuer détruire frapper brûler töten schlagen vernichten matar destruir golpear quemar",
    TARGET: "you your yours u they them he she him her tu te toi vous du dich ihr euch sie tú ustedes vosotros ellos",
    NEGATION: "not no never nor without isn aren don didn won cannot ne pas jamais nicht kein keine nie sin nunca jamás",
    REPORT: "said says say wrote claimed claims called quoted reportedly dit disait écrit appelé sagte schrieb nannte dijo escribió llamó",
}
_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:\n]+")
_BEGINNINGS = (4, 5, 6, 7)
MANNERS = ("plain", "aimed", "negated", "reported")
KINDS = [(tag, manner) for tag in (INSULT, THREAT) for manner in MANNERS]
#: What a target says that comes soon behind a match: a plain one is aimed.
AIMED_AFTER = len(KINDS)
# The weights of kinds without labels.
_DEFAULT = (1.0, 1.5, 0.2, 0.2) * 2


@dataclass(frozen=True)
class Transducer:
    """``arcs[state][tag]`` is the next state; a state over 0 holds its mark for the next word."""

    arcs: tuple[tuple[int, ...], ...]

    @classmethod
    def reaching(cls, tags: tuple[int, ...], words: int) -> Transducer:
        """Marks the ``words`` words after one of ``tags``."""
        return cls(tuple(tuple(words if t in tags else max(s - 1, 0) for t in range(6)) for s in range(words + 1)))

    @classmethod
    def lasting(cls, tag: int) -> Transducer:
        """Marks the rest of the clause after ``tag``."""
        return cls((tuple(int(t == tag) for t in range(6)), (1,) * 6))


def compose(negation: Transducer, target: Transducer, report: Transducer, match: Transducer) -> list[list[tuple[int, int]]]:
    """The product: ``[state][tag]`` gives the next state and the kind of match, -1 for none."""
    sizes = [len(t.arcs) for t in (negation, target, report, match)]
    states = list(product(*map(range, sizes)))
    number = {s: i for i, s in enumerate(states)}
    table = []
    for n, t, r, m in states:
        row = []
        for tag in range(6):
            kind = -1
            if tag in (INSULT, THREAT):
                kind = (3 if r else 2 if n else 1 if t else 0) + len(MANNERS) * (tag - INSULT)
            elif tag == TARGET and m:
                kind = AIMED_AFTER
            row.append((number[negation.arcs[n][tag], target.arcs[t][tag], report.arcs[r][tag], match.arcs[m][tag]], kind))
        table.append(row)
    return table


GRAMMAR = compose(Transducer.reaching((NEGATION,), 3), Transducer.reaching((TARGET,), 5), Transducer.lasting(REPORT), Transducer.reaching((INSULT, THREAT), 2))


@dataclass
class Model:
    """``lexicon`` has a weight for each insulting word or, with ``*`` behind, beginning."""

    lexicon: dict[str, float]
    weights: list[float]
    known: dict[str, tuple[int, float]] = field(default_factory=dict)

    def lexical(self, word: str) -> tuple[int, float]:
        """The tag and weight of a word; the whole word counts before its longest beginning."""
        hit = self.known.get(word)
        if hit is None:
            learned = self.lexicon.get(word)
            if learned is None:
                learned = next((self.lexicon[b] for k in reversed(_BEGINNINGS) if len(word) >= k and (b := word[:k] + "*") in self.lexicon), None)
            if learned is not None:
                hit = (INSULT, learned)
            else:
                hit = next(((tag, 1.0) for tag, words in _TAGGED if word in words), (OTHER, 0.0))
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = hit
        return hit

    def clauses(self, text: str | None) -> tuple[list[tuple[int, float]], int]:
        """Kind and weight of each matched clause, and how many clauses with words there are."""
        found, n = [], 0
        for clause in _CLAUSE.split((text or "").lower()):
            words = _WORD.findall(clause)
            n += bool(words)
            state, weights, last = 0, {}, (0, 0.0)
            for word in words:
                tag, weight = self.lexical(word)
                if tag or state:
                    state, kind = GRAMMAR[state][tag]
                    if kind == AIMED_AFTER:
                        kind, weight = last
                        if MANNERS[kind % len(MANNERS)] == "plain":
                            weights[kind] -= weight
                            kind += MANNERS.index("aimed")
                            weights[kind] = weights.get(kind, 0.0) + weight
                            last = (kind, weight)
                    elif kind >= 0:
                        weights[kind] = weights.get(kind, 0.0) + weight
                        last = (kind, weight)
            if weights:
                kind = max(weights, key=weights.__getitem__)
                found.append((kind, sum(weights.values())))
        return found, n

    def matches(self, text: str | None) -> list[float]:
        """What a document is scored by: see ``FEATURES``."""
        found, n = self.clauses(text)
        count, total = [0] * len(KINDS), [0.0] * len(KINDS)
        worst = 0.0
        for kind, weight in found:
            count[kind] += 1
            total[kind] += weight
            if MANNERS[kind % len(MANNERS)] in ("plain", "aimed"):
                worst = max(worst, weight)
        return [*map(math.log1p, total), *(min(c, 2.0) for c in count), math.log1p(worst), 10 * len(found) / (n + 5)]

    def score(self, text: str | None) -> float:
        z = sum(map(float.__mul__, map(float, self.matches(text)), self.weights[:-1])) + self.weights[-1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


#: Weight and number, up to 2, of the clauses of each kind; the heaviest clause; the share of matched ones.
FEATURES = 2 * len(KINDS) + 2
_TAGGED = [(tag, frozenset(words.split())) for tag, words in WORDS.items()]


def _seen(texts: DataFrame) -> DataFrame:
    """For each word and beginning, how many toxic and other documents have it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in sliced(batches):
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(_WORD.findall((text or "").lower()))
                found[y].update(words | {w[:k] + "*" for w in words for k in _BEGINNINGS if len(w) >= k} | {""})
        names = list(found[0] | found[1])
        for i in range(0, len(names), 50_000):
            some = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([found[1][w] for w in some], pa.int64()), pa.array([found[0][w] for w in some], pa.int64())], names=["term", "toxic", "other"])

    return texts.mapInArrow(count, "term string, toxic bigint, other bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def train_on(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0, most: int = 6000, **more) -> Model:
    """Learns from at most ``most`` documents of each label, all outside the held-out fold.

    Terms are those whose document share is higher in toxic documents by over 6 standard errors.
    Only they, and ``FEATURES`` numbers a document, reach the driver.
    """
    sample = labelled_sample(docs, labels, label, folds, held_out, most=most, **more)
    seen = _seen(sample)
    total = seen.where("term = ''").select("toxic", "other").collect()
    if not total or not total[0].toxic or not total[0].other:
        return Model({}, [*_DEFAULT, *[0.0] * len(KINDS), 0.5, 0.0, -3.0])
    a, b = total[0]
    share = (F.col("toxic") + F.col("other")) / (a + b)
    z = (F.col("toxic") / a - F.col("other") / b) / F.sqrt(share * (1 - share) * (1 / a + 1 / b) + 1e-12)
    odds = F.log((F.col("toxic") + 0.1) / (a + 0.1) / ((F.col("other") + 0.1) / (b + 0.1)))
    terms = seen.where("term <> '' AND toxic >= 4").select("term", z.alias("z"), odds.alias("odds")).where("z > 6 AND odds > 1.2").orderBy(F.desc("z"), "term").collect()
    model = Model({r.term: r.odds for r in terms}, [])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([sent.value.matches(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64()))], names=["y", "x"])

    rows = sample.mapInArrow(measure, "y int, x array<double>").collect()
    rows.sort(key=lambda r: (r.y, r.x))
    model.weights = logistic(np.array([r.x for r in rows]), np.array([r.y for r in rows], float), ridge=1e-4).tolist()
    model.known = {}
    return model


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the toxicity score of each whole text; a column of that name is replaced."""
    out = docs.drop(name)
    names = out.columns
    schema = T.StructType([*out.schema.fields, T.StructField(name, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(batch.schema.get_field_index(text))
            scores = pa.array([sent.value.score(t.as_py()) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), scores], names=[*names, name])

    return out.mapInArrow(scan, schema)
