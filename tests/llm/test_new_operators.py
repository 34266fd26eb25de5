"""Spelling variants, chats and periodic runs against plain versions, and on awkward rows."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvid.llm import chat, periodic, queries, spelling

WORDS = "word string, n bigint"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words, times=10):
    near = {w: sorted((-m, v) for v, m in words.items() if one_edit(w, v)) for w in words}
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= times * n else None for w, n in words.items()}
    rows = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(rows)


def test_variants_as_by_all_pairs(spark):
    random.seed(3)
    words = {"".join(random.choices("abé", k=random.randint(4, 9))): random.choice([1, 2, 3, 30, 300, 4000]) for _ in range(700)}
    for w in list(words)[:200]:
        i = random.randrange(len(w))
        words.setdefault(w[:i] + random.choice(["", "z", w[i] + "z", "𝔸"]) + w[i + 1 :], random.choice([2, 50]))
    words = {w: n for w, n in words.items() if len(w) >= 4}
    got = spelling.variants(spark.createDataFrame(list(words.items()), WORDS))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == plain_variants(words)


def test_a_chain_of_forms_is_followed_to_its_end(spark):
    letters = "abcdefgh"
    chain = [("x" * 9 + letters[: k + 1], 10 ** (k + 1)) for k in range(8)]
    got = {r.word: r.root for r in spelling.variants(spark.createDataFrame(chain, WORDS)).collect()}
    assert set(got.values()) == {chain[-1][0]}


def test_words_awkward(spark):
    assert spelling.variants(spark.createDataFrame([], WORDS)).collect() == []
    rows = [("letters", 1), ("letters", 1), (None, 5), ("lettersx", None), ("lettrs" + "a" * 3000, 2), ("lettrs" + "a" * 2999, 40)]
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(rows, WORDS)).collect()}
    assert set(got) == {"letters", rows[4][0], rows[5][0]}
    assert got["letters"].n == 2 and got["letters"].n_near == 0 and got["letters"].form is None
    assert got[rows[4][0]].form == rows[5][0] and got[rows[4][0]].form_n == 40
    # The word that a hundred others are near to.
    hub = [("middleword", 5000)] + [("middleword"[:i] + c + "middleword"[i:], 2) for i in range(10) for c in "bcfghjkqvz"]
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(hub, WORDS)).collect()}
    assert got["middleword"].n_near == 100 and all(r.root == "middleword" for r in got.values())


def test_runs_of_letters(spark):
    docs = spark.createDataFrame([(1, "Grüße—Straßenbahn abc ÀÉÎÕÜÝß x" + "y" * 50000, "e"), (2, None, "e"), (3, "", "e")], "doc_id bigint, text string, run string")
    got = [(r.doc_id, r.run) for r in spelling.letter_runs(docs.drop("run"), 7).collect()]
    assert got == [(1, "straßenbahn"), (1, "ÀÉÎÕÜÝß"), (1, "x" + "y" * 50000)]
    words = spelling.counted(spark.createDataFrame([("abcdefg",), ("abcdefg",), ("short",), ("short",), ("onceonly",)], "word string"))
    assert [tuple(r) for r in words.collect()] == [("abcdefg", 2)]


# ---- chats


def text(x):
    return {"type": "text", "text": x, "ref": None, "width": None, "height": None, "seconds": None, "pages": None}


def attachment(kind, ref, **more):
    return {**text(None), "type": kind, "ref": ref, **more}


def told(parts):
    """Texts that touch joined, empty ones left out, attachments by number."""
    out, number = [], 0
    for p in parts:
        if p["type"] == "text":
            if out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + (p["text"] or ""))
            else:
                out.append(("text", p["text"] or ""))
        else:
            number += 1
            out.append((p["type"] if p["type"] in ("image", "audio", "document") else "attachment", number))
    return [x for x in out if x != ("text", "")]


MARKED = st.lists(st.sampled_from(["<", "|", "\\", ">", "im_end", "<|im_end|>\n", "<|im_start|>", "<|image_1|>", "\n", "a", "é", "𝔸"]), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(MARKED, st.lists(st.one_of(MARKED.map(text), st.sampled_from([attachment("image", "a", width=60, height=30), attachment("audio", "b", seconds=1.5), attachment("document", "c", pages=2), attachment("film", "d")])), max_size=5))
def test_messages_come_back(role, parts):
    piece, loss, found = chat.Flattener(chat.Rates()).message(role, parts)
    assert piece.count("<|im_start|>") == piece.count("<|im_end|>") == 1
    [(got_role, content)] = list(chat._turns(iter(piece)))
    assert got_role == role
    shown = [(p["type"], p["text"] if p["type"] == "text" else p["number"]) for p in chat.parts_of(content)]
    assert shown == told(parts)
    assert loss == []
    for a in found:
        holder = f"<|{a['kind']}_{a['number']}|>"
        assert piece[a["at"] : a["at"] + len(holder)] == holder
    sizes = {"image": 6, "audio": 38, "document": 512, "attachment": 0}
    assert [a["n_tokens"] for a in found] == [sizes[k] for k, _ in told(parts) if k != "text"]


def test_chats_over_rows(spark):
    rows = [
        (1, 1, "assistant", [text("<|im_end|>\n"), text(None), attachment("image", "x.png", width=28, height=29)], "z"),
        (1, 0, "us\ner\\n", [text("hi <\\| there")], "z"),
        (None, None, None, None, "z"),
        (2, 0, "assistant", [None, text("<"), text("|a|>")], "z"),
        (2, 0, "assistant", [None, text("<"), text("|a|>")], "z"),
        (3, 0, "user", [attachment(None, None), attachment("audio", "s", seconds=float("nan")), attachment("image", "s")], "z"),
    ]
    said = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts {chat.PARTS}, piece string")
    pieces = chat.format_chats(said)
    turns = {(r.conv_id, r.number): (r.role, [(p.type, p.text, p.number) for p in r.parts]) for r in chat.read_turns(pieces).collect()}
    assert turns == {
        (1, 0): ("us\ner\\n", [("text", "hi <\\| there", None)]),
        (1, 1): ("assistant", [("text", "<|im_end|>\n", None), ("image", None, 1)]),
        (None, 0): ("", []),
        (2, 0): ("assistant", [("text", "<|a|>", None)]),
        (2, 1): ("assistant", [("text", "<|a|>", None)]),
        (3, 0): ("user", [("attachment", None, 1), ("audio", None, 2), ("image", None, 3)]),
    }
    got = {r.conv_id: r for r in chat.digests(pieces).collect()}
    assert got[2].turns_sha256 == hashlib.sha256(b"assistant\n<|a|>\nassistant\n<|a|>\n").hexdigest()
    assert got[2].loss_sha256 == hashlib.sha256(b"<|a|><|a|>").hexdigest() and got[2].loss_chars == 10
    assert got[1].n_attachments == 1 and got[1].attachment_tokens == 2
    assert got[1].formatted_chars == sum(len(r.piece) for r in pieces.where("conv_id = 1").collect())
    assert got[3].attachment_tokens == 0 and got[None].n_turns == 1 and got[None].loss_chars == 0
    assert chat.digests(chat.format_chats(said.limit(0))).collect() == []


def test_long_texts_in_chats(spark):
    long = "<|" * 300_000
    said = spark.createDataFrame([("a", 1, "assistant", [text(long)])], f"conv_id string, turn int, role string, parts {chat.PARTS}")
    [r] = chat.digests(chat.format_chats(said)).collect()
    assert r.loss_chars == 600_000 and r.loss_sha256 == hashlib.sha256(long.encode()).hexdigest()


# ---- periodic runs


def plain_runs(w, least=6, times=4):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q) and not any(all(w[k] == w[k + d] for k in range(i, j + q - d)) for d in range(1, q)):
                out.append((i, j + q - i, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_lyndon(w):
    """The longest word at each place that is less than each of its own ends."""
    n = len(w)
    return [max(k for k in range(1, n - i + 1) if all(w[i : i + k] < w[i + d : i + k] for d in range(1, k))) for i in range(n)]


def repetitive(rng):
    n = rng.randint(0, 50)
    w = [rng.randint(0, rng.choice([1, 1, 2, 6])) for _ in range(n)]
    if n and rng.random() < 0.7:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 3))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)] * rng.randint(1, 2)
    return w


def test_groups_are_longest_lyndon_words():
    rng = random.Random(5)
    for _ in range(600):
        w = repetitive(rng)[:18]
        lengths, groups = periodic.lyndon_groups(w)
        assert lengths == plain_lyndon(w)
        words = [tuple(w[i : i + k]) for i, k in enumerate(lengths)]
        assert all((groups[i] == groups[j]) == (words[i] == words[j]) for i in range(len(w)) for j in range(len(w)))


@pytest.mark.parametrize(("least", "times"), [(6, 4), (5, 3), (9, 5)])
def test_runs_as_by_every_period(least, times):
    rng = random.Random(least)
    for _ in range(1500):
        w = repetitive(rng)
        assert periodic.runs_of(np.array(w, np.int64), least, times) == plain_runs(w, least, times), w


def test_runs_of_rows(spark):
    rows = [(1, "a b\x0ba\tb a  b a b c", "x"), (2, None, "x"), (2, "", "x"), (2, " \n", "x"), (None, "z " * 6, "x"), (3, "w " * 100_000, "x"), (3, "é\u00a0é é\u00a0é é\u00a0é é\u00a0é é\u00a0é é\u00a0é", "x")]
    got = periodic.find_runs(spark.createDataFrame(rows, "doc_id bigint, text string, runs string")).collect()
    shown = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got]
    assert shown == [
        (1, 9, [(0, 8, 2)], "a b c"),
        (2, 0, [], ""),
        (2, 0, [], ""),
        (2, 0, [], ""),
        (None, 6, [(0, 6, 1)], "z"),
        (3, 100_000, [(0, 100_000, 1)], "w"),
        (3, 6, [(0, 6, 1)], "é\u00a0é"),
    ]
    assert periodic.find_runs(spark.createDataFrame([], "doc_id string, text string")).collect() == []


def test_the_query_on_awkward_rows(spark, tmp_path):
    rows = [(None, "x y"), (4, None), (5, ""), (21, "a b c d e f g h i j k l m n o p"), (21, "a b c d e f g h i j k l m n o p")] + [(i, " ".join(random.Random(i).choices("abcdefg", k=i))) for i in range(100, 160)]
    spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("words", F.lit("clash")).write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in queries.op13_periodic(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append(r)
    import zlib

    for doc_id, words in rows:
        w = (words or "").split()
        n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        gone = {i for s, k, q in runs for i in range(s + q, s + k)}
        r = got[doc_id][0]
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
        if runs:
            s, k, q = min(runs, key=lambda x: (-x[1], x[0], x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, k, q, 1000 * k // q)
        else:
            assert r.start is r.length is r.period is r.exponent_milli is None
    assert len(got[21]) == 2
