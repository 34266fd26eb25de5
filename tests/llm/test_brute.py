"""Trained operators, schedules and the whole pipeline against plain versions of what they compute."""

import itertools
import random
import re
from collections import Counter
from fractions import Fraction
from math import ceil, floor, inf

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvid.llm import decontaminate, jaccard_join, mixing, quality, toxicity
from tests.llm.test_operators import brute_components, brute_spans, docs_of

SF = "/root/testdata/sf0.001"


# 3


def slow_order(blocks, shares):
    """Earliest deadline first, of times that a simulation of the ideal mixture gives in fractions."""
    names = sorted(s for s, n in blocks.items() if n > 0)

    def placed(v):
        """What all sources have placed when each has had ``v`` for each share, or all of its own."""
        return sum(min(Fraction(blocks[s]), v * shares[s]) for s in names)

    window = {(s, j): (floor(placed(Fraction(j, shares[s]))), ceil(placed(Fraction(j + 1, shares[s])))) for s in names for j in range(blocks[s])}
    done, out = dict.fromkeys(names, 0), []
    for t in range(sum(blocks.values())):
        ready = [(window[s, done[s]][1], s) for s in names if done[s] < blocks[s] and window[s, done[s]][0] <= t]
        due, s = min(ready)
        assert due > t
        out.append((s, done[s]))
        done[s] += 1
    return out


def test_order_is_that_of_simulated_windows():
    random.seed(41)
    for _ in range(60):
        blocks = {f"s{i}": random.randint(0, 12) for i in range(random.randint(1, 8))}
        shares = {s: random.randint(1, 9) for s in blocks}
        assert list(mixing.in_order(blocks, shares)) == slow_order(blocks, shares)


def test_mixing_places_documents_by_the_simulated_order(spark):
    random.seed(42)
    counts = {"a": 61, "b": 17, "c": 5, "d": 1}
    rows = [(i, s) for i, s in enumerate(random.sample([s for s, n in counts.items() for _ in range(n)], sum(counts.values())))] + [(None, "b")] * 9
    counts["b"] += 9
    shares = {"a": 3, "b": 2, "c": 1, "d": 1}
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), shares, block=4).collect()
    order = slow_order({s: -(-n // 4) for s, n in counts.items()}, shares)
    first = dict(zip(order, itertools.accumulate([0] + [min(4, counts[s] - 4 * j) for s, j in order]), strict=False))
    assert Counter((r.source, r.block, r.slot) for r in got) == Counter({(s, j, t): min(4, counts[s] - 4 * j) for t, (s, j) in enumerate(order)})
    assert sorted(r.position for r in got) == list(range(len(rows)))
    assert all(first[r.source, r.block] <= r.position < first[r.source, r.block] + 4 for r in got)


# 4


def slow_clauses(model, text):
    """Kind and weight of each matched clause, by looking around every match."""
    out = []
    for clause in re.split(r"[.!?;:\n]+", (text or "").lower()):
        tagged = [model.lexical(w) for w in re.findall(r"[^\W\d_]+", clause)]
        tags, manner = [t for t, _ in tagged], {}
        for i, t in enumerate(tags):
            if t in (toxicity.INSULT, toxicity.THREAT):
                near = lambda tag, n: tag in tags[max(0, i - n) : i]  # noqa: E731, B023
                manner[i] = "reported" if toxicity.REPORT in tags[:i] else "negated" if near(toxicity.NEGATION, 3) else "aimed" if near(toxicity.TARGET, 5) else "plain"
            elif t == toxicity.TARGET and any(j in manner for j in (i - 1, i - 2)):
                last = max(j for j in manner if j < i)
                manner[last] = "aimed" if manner[last] == "plain" else manner[last]
        kinds = {}
        for i in manner:
            kind = toxicity.KINDS.index((tags[i], manner[i]))
            kinds[kind] = kinds.get(kind, 0) + tagged[i][1]
        if kinds:
            out.append((max(kinds.values()), sum(kinds.values()), set(k for k, v in kinds.items() if v == max(kinds.values()))))
    return out


def test_clauses_are_those_of_a_plain_search():
    random.seed(43)
    model = toxicity.Model({"blob": 2.0, "slug*": 0.5}, [])
    words = "blob slugger idiot kill you they not never said wrote the a tree walks".split()
    for _ in range(2000):
        text = "".join(random.choice(words) + random.choice([" ", " ", " ", " ", ". ", "\n"]) for _ in range(random.randint(0, 14)))
        found, _ = model.clauses(text)
        want = slow_clauses(model, text)
        assert len(found) == len(want), text
        for (kind, weight), (_, total, kinds) in zip(found, want, strict=True):
            assert weight == pytest.approx(total) and kind in kinds, text


def test_toxicity_query_scores_as_the_model_does(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train_on(docs.select("doc_id", "text"), labels)
    for r in toxicity.score_toxicity(docs.select("doc_id", "text"), model).collect()[::7]:
        z = np.dot(model.matches(r.text), model.weights[:-1]) + model.weights[-1]
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))))


# 8


def test_chain_is_that_of_all_labellings():
    rng = np.random.default_rng(44)
    own = [rng.normal(size=(n, quality.N_OWN)) for n in (3, 1, 5, 2, 5, 0)]
    lines = quality.Lines.of(own, [np.ones(len(o)) for o in own])
    theta = rng.normal(size=3 * quality.N_OWN + 2) / 3
    z, p, e_gg, e_bb = quality._chain(lines, theta)
    sure = both_g = both_b = 0
    for d, o in enumerate(lines.order):
        if not len(own[o]):
            continue
        odds = quality.with_neighbours(own[o]) @ theta[:-2]
        labellings = list(itertools.product((0, 1), repeat=len(odds)))
        pairs = lambda y, v: sum(a == b == v for a, b in zip(y, y[1:]))
        weight = np.exp([np.dot(odds, y) + theta[-2] * pairs(y, 1) + theta[-1] * pairs(y, 0) for y in labellings])
        assert z[d] == pytest.approx(np.log(weight.sum()))
        marginal = (weight[:, None] * np.array(labellings)).sum(0) / weight.sum()
        assert np.allclose(p[lines.doc == d], marginal)
        sure += 1
        both_g += (weight * [pairs(y, 1) for y in labellings]).sum() / weight.sum()
        both_b += (weight * [pairs(y, 0) for y in labellings]).sum() / weight.sum()
    assert sure == 5 and (e_gg, e_bb) == (pytest.approx(both_g), pytest.approx(both_b))


def test_slope_is_that_of_the_loss():
    rng = np.random.default_rng(45)
    own = [rng.normal(size=(n, quality.N_OWN)) for n in (4, 1, 6)]
    lines = quality.Lines.of(own, [np.ones(len(o)) for o in own])
    good, theta = rng.random(len(lines.x)) > 0.5, rng.normal(size=3 * quality.N_OWN + 2) / 3
    slope = quality._loss(lines, good, theta)[1]
    for k in range(0, len(theta), 5):
        step = 1e-6 * np.eye(len(theta))[k]
        assert slope[k] == pytest.approx((quality._loss(lines, good, theta + step)[0] - quality._loss(lines, good, theta - step)[0]) / 2e-6, abs=1e-6)
    best = quality.minimise(lambda t: quality._loss(lines, good, t), np.zeros(len(theta)), least=1e-12)
    assert np.abs(quality._loss(lines, good, best)[1]).max() < 1e-3


def test_quality_query_scores_as_the_field_does(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    field = quality.train_on(docs.select("doc_id", "text"), labels)
    for r in quality.score_quality(docs.select("doc_id", "text"), field).collect()[::7]:
        lines = [x for x in (r.text or "").split("\n") if x.strip()]
        odds = quality.features(lines) @ field.weights
        best = inf
        if 0 < len(lines) <= 8:
            weight = {y: np.exp(np.dot(odds, y) + sum(field.stay[0] if a and b else field.stay[1] if not a and not b else 0 for a, b in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=len(lines))}
            share = sum(len(x) * sum(w for y, w in weight.items() if y[i]) for i, x in enumerate(lines)) / sum(weight.values()) / sum(map(len, lines))
            best = 1 / (1 + np.exp(-(field.curve[0] * quality._logit(share) + field.curve[1])))
        assert 0 <= r.score <= 1 and (best == inf or r.score == pytest.approx(best, abs=1e-6))


# The pipeline


def test_pipeline_is_its_stages_by_hand(spark):
    docs, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    field = quality.train_on(docs, labels)
    rows = sorted((r for r in docs.collect() if field.score(r.text) >= 0.7), key=lambda r: r.doc_id)
    components = brute_components([r.text for r in rows])
    kept = [r for r, (i, _, first) in zip(rows, components, strict=True) if i == first]
    grams = {tuple(w[i : i + min(10, len(w))]) for w in (decontaminate.words_of((r.text or "").encode()) for r in items.collect()) if w for i in range(max(1, len(w) - 9))}
    want = {}
    for r in kept:
        words = decontaminate.words_of((r.text or "").encode())
        hit = {j for size in {len(g) for g in grams} for k in range(len(words) - size + 1) if tuple(words[k : k + size]) in grams for j in range(k, k + size)}
        if 2 * len(hit) > len(words):
            continue
        spans = decontaminate.merged([(j, j + 1) for j in hit])
        text = decontaminate.without(r.text, spans) if hit else r.text
        clean, at = "", 0
        for _, a, b in brute_spans(text):
            if a >= at:
                clean += (text or "")[at:a] + "[secret]"
            at = max(at, b)
        want[r.doc_id] = (text if text is None else clean + text[at:], r.source)
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: (r.text, r.source) for r in got} == want and len(got) == len(want)
    sizes = Counter(s for _, s in want.values())
    order = slow_order({s: -(-n // 16) for s, n in sizes.items()}, mixing.target_shares(sizes))
    assert {(r.slot, r.source, r.block) for r in got} == {(t, s, j) for t, (s, j) in enumerate(order)}


# 5


def test_equal_short_digests_are_different_nodes(spark, monkeypatch):
    first, second = b"\x01" * 8 + b"aaaa", b"\x01" * 8 + b"bbbb"
    nodes = np.frombuffer(second + first + second, jaccard_join._NODE)
    every, number = jaccard_join._numbered(nodes)
    assert [n.tobytes() for n in every[number]] == [second, first, second] and len(every) == 2
    assert len(set(jaccard_join._part_of(nodes, 7).tolist())) == 1
    # Dealt to one part and back, each keeps its own shingles.
    hashes, owners = np.array([5, 9, 9, 11], np.uint64), np.array([0, 0, 1, 1])
    dealt = list(jaccard_join._deal(jaccard_join._BY_HASH, np.zeros(4, np.int64), 1, hashes, None, owners, np.frombuffer(first + second, jaccard_join._NODE)))
    shared = [r for b in jaccard_join._shared(1)(jaccard_join._batches(iter(dealt), jaccard_join._DEALT)) for r in b.to_pylist()]
    h, df, o, n = jaccard_join._gather(shared)
    assert sorted(zip(h.tolist(), df.tolist(), [n[i].tobytes() for i in o], strict=True)) == [(9, 2, first), (9, 2, second)]


def test_rows_of_one_text_are_one_node(spark):
    docs = docs_of(spark, ["one two three four five six"] * 50 + ["one two three four five seven"])
    got = jaccard_join.jaccard_join(docs.repartition(8))
    assert Counter((r.n_shingles, r.component_id) for r in got.collect()) == Counter({(2, 0): 50, (2, 50): 1})
    assert got.select("text_hash").distinct().count() == 2 and got.where(F.col("text_hash").isNull()).count() == 0
