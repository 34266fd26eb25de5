"""N-gram Jaccard join with adaptive multi-match prefixes.

Each document is a set of hashed word shingles; equal sets are one node. All nodes order their shingles
alike: by hash, those that a thousandth of all sets have last, by how often. Two nodes that link share
more than they need to, so each deals out only the first part of its shingles, without an eighth of its
size less than what it needs to share (three eighths of them at 75 percent); of those, the two share an
eighth of the larger one at least. A shingle dealt by one node only isn't shared, so a node with fewer
shared ones than that is alone.

The others order what they have dealt and share by exact frequency, rarest first. The prefix for ``l``
matches has the first ``shared - needed + l`` of them: two nodes that link share at least the smaller of
their ``l`` within their prefixes, and more as the overlap that the pair needs exceeds what each needs
alone. Each node takes the ``l`` of least estimated cost: postings that its prefix touches, and
candidates left by asking for ``l`` of them. Only nodes that meet others in their prefixes are read
again, and their whole sets verify every candidate exactly.

The frequent shingles are counted within tasks first and broadcast: no more than half a million can be as
frequent among sets of 250 shingles, and never more are taken. Any order that all nodes share gives the
same links.

Components are found without comparing all pairs of a group: first each node meets the least node
of each of its lists; what that links is contracted; then only nodes of different components meet.
Short lists give candidate pairs by a join on the prefix shingle. Long lists are cut into blocks,
and tasks verify a pair of blocks each and return no more than the links that join components.

A task that counts shingles holds those of one part of the hashes. There are as many parts as shuffle
partitions, and more if a part would have over ``most_held`` shingles.

Edge cases: null texts and texts without words have no shingles and link with nothing. Rows are
told apart by their sets, not their ids, so repeated rows and ids and null ids are fine: each row
gives one row. A component's id is its least id that isn't null. Other columns aren't touched.
Shingles are compared by 64-bit hashes; sets by 96-bit digests (that any two of 5e9 sets have the same
has a chance of 2e-10).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from corvid.llm.batches import sliced
from corvid.llm.components import connected
from corvid.llm.skew import spread_join
from corvid.storage import stored

_ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Shingles that a task gathers before it counts them or deals them out.
_FLUSH = 1_000_000
#: What frequent shingles' counts are raised by, so that all others come before them in prefixes.
_HOT = 1 << 31
#: A row is a document, the size of a node, or dealt shingles: by hash, or with their frequencies by node.
_DOCUMENT, _SIZE, _BY_HASH, _BY_NODE = range(4)
_DEALT = "part int, kind int, doc_id bigint, text_hash bigint, n bigint, node binary, hashes binary, df binary, owners binary, nodes binary"
_NODES = "doc_id bigint, text_hash bigint, n bigint, node binary, shared int, prefix array<bigint>"
_NODE = np.dtype([("high", "<u8"), ("low", "<u4")])


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def shingle_sets(texts: list[bytes | None], words: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text; of all its words if they are fewer."""
    split = [(t or b"").lower().split() for t in texts]
    hashed = np.fromiter((xxh3_64_intdigest(w) for ws in split for w in ws), np.uint64)
    span = max(len(hashed) - words + 1, 0)
    with np.errstate(over="ignore"):
        mixed = np.zeros(span, np.uint64)
        for k in range(words):
            mixed += (hashed[k : k + span] + _ODD[k % 5] * np.uint64(k + 1)) * _ODD[(k + k // 5) % 5]
            mixed ^= mixed >> np.uint64(31)
        mixed *= _MIX
        mixed ^= mixed >> np.uint64(32)
    out, at = [], 0
    for ws in split:
        n = len(ws)
        if n >= words:
            one = np.sort(mixed[at : at + n - words + 1])
            out.append(one if len(one) < 2 else one[np.r_[True, one[1:] != one[:-1]]])
        else:
            out.append(np.array([xxh3_64_intdigest(b" ".join(ws), seed=n)] if n else [], np.uint64))
        at += n
    return out


def _packed(x: np.ndarray) -> bytes:
    """The bytes of an array, all first bytes of its items first, compressed: high bytes that are alike take no room."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 1)


def _unpacked(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _numbered(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes, ascending, and which of them each is."""
    order = np.lexsort((nodes["low"], nodes["high"]))
    ordered = nodes[order]
    fresh = np.ones(len(nodes), bool)
    fresh[1:] = (ordered["high"][1:] != ordered["high"][:-1]) | (ordered["low"][1:] != ordered["low"][:-1])
    number = np.empty(len(nodes), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return ordered[fresh], number


def _part_of(nodes: np.ndarray, parts: int) -> np.ndarray:
    return (nodes["high"] % np.uint64(parts)).astype(np.int64)


def _deal(kind: int, part: np.ndarray, parts: int, hashes: np.ndarray, df: np.ndarray | None, owners: np.ndarray, nodes: np.ndarray) -> Iterator[dict]:
    """A row for each part: its shingles in order of hash, as differences, and the nodes that own them."""
    order = np.lexsort((hashes, part))
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        mine = order[ends[p] : ends[p + 1]]
        if len(mine):
            own, local = np.unique(owners[mine], return_inverse=True)
            steps = np.diff(hashes[mine], prepend=np.uint64(0))
            yield {"part": p, "kind": kind, "hashes": _packed(steps), "df": None if df is None else _packed(df[mine]), "owners": _packed(local.astype(np.uint32)), "nodes": nodes[own].tobytes()}


def _gather(rows: list[dict]) -> tuple[np.ndarray, ...]:
    """The shingles of dealt rows: hashes, df, owner by number; and the nodes by that number."""
    tables = [np.frombuffer(r["nodes"], _NODE) for r in rows]
    owned = [_unpacked(r["owners"], np.uint32) for r in rows]
    shift = np.cumsum([0, *map(len, tables)])
    owners = np.concatenate([o + s for o, s in zip(owned, shift[:-1], strict=True)])
    hashes = np.concatenate([np.cumsum(_unpacked(r["hashes"], np.uint64), dtype=np.uint64) for r in rows])
    df = np.concatenate([_unpacked(r["df"], np.uint32) if r["df"] else np.zeros(0, np.uint32) for r in rows])
    nodes, number = _numbered(np.concatenate(tables))
    return hashes, df, number[owners], nodes


def _batches(rows: Iterator[dict], ddl: str, at_once: int = 4096, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Rows in batches of at most ``at_once`` rows and about ``most`` bytes."""
    schema = _arrow(ddl)
    held: list[dict] = []
    size = 0
    for r in rows:
        held.append(r)
        size += sum(x.nbytes if isinstance(x, np.ndarray) else len(x) for x in r.values() if isinstance(x, (bytes, np.ndarray)))
        if len(held) >= at_once or size >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[dict, bytes, np.ndarray, bool]]:
    """Each document's columns but the text, its node and set, and whether its set is new to the task and not empty."""
    seen: set[bytes] = set()
    for batch in sliced(batches):
        sets = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), words)
        for row, own in zip(batch.drop_columns("text").to_pylist(), sets, strict=True):
            node = hashlib.blake2b(own.tobytes(), digest_size=_NODE.itemsize).digest()
            new = len(own) > 0 and node not in seen
            if new:
                seen.add(node)
            yield row, node, own, new


def _frequent(words: int, share: float, most: int):
    """How often a task's sets have each shingle of about ``share`` of them; without a shingle, how many sets.

    Counts leave out what occurs once among a flush's sets, and the rarest beyond ``most``. ``size`` is
    how many shingles the sets have.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts, n, whole = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0
        held: list[np.ndarray] = []
        size = 0

        def merge() -> tuple[np.ndarray, np.ndarray]:
            some, c = np.unique(np.concatenate(held), return_counts=True)
            every, where = np.unique(np.concatenate([names, some[c > 1]]), return_inverse=True)
            total = np.bincount(where, np.concatenate([counts, c[c > 1]]), len(every)).astype(np.int64)
            if len(every) > most:
                keep = np.sort(np.argpartition(-total, most)[:most])
                every, total = every[keep], total[keep]
            return every, total

        for _, _, own, new in _sets(batches, words):
            if new:
                held.append(own)
                n += 1
                size += len(own)
                whole += len(own)
                if size >= _FLUSH:
                    names, counts = merge()
                    held, size = [], 0
        if held:
            names, counts = merge()
        keep = counts >= max(8, share * n / 4)
        columns = ["token", "n", "size"]
        for i in range(0, keep.sum(), 100_000):
            some = counts[keep][i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(names[keep][i : i + 100_000].view(np.int64)), pa.array(some), pa.array(np.zeros_like(some))], names=columns)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n], pa.int64()), pa.array([whole], pa.int64())], names=columns)

    return rows


def frequent_shingles(docs: DataFrame, words: int, share: float, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Shingles, ascending, that about ``share`` of all sets have or more, the ``most`` most frequent, and their counts.

    Behind them, how many shingles all sets have.
    """
    counts = stored(docs.mapInArrow(_frequent(words, share, most), "token bigint, n bigint, size bigint").groupBy("token").agg(F.sum("n").alias("n"), F.sum("size").alias("size")), "frequent")
    total = counts.where("token IS NULL").first()
    table = counts.where(F.col("token").isNotNull() & (F.col("n") >= share / 2 * (total.n if total else 0))).orderBy(F.desc("n"), "token").limit(most).select("token", "n").toArrow()
    tokens, n = table["token"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(tokens)
    return tokens[order], n[order], total.size if total else 0


def _spare(n, percent: int):
    """How many of ``n`` shingles aren't dealt. More or larger sets never spare fewer."""
    return n * max(2 * percent - 25, 0) // 200


def _needed(n: int, percent: int) -> int:
    """How many of its dealt shingles a set shares with any that it links with."""
    return min(-(-n // 8), -(-percent * n // 100))


def _dealt_first(sets: list[np.ndarray], hot: np.ndarray, hot_n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first shingles of each set in the order of all: hashes, frequency (0 unless it is frequent) and set."""
    hashes, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    owners = np.repeat(np.arange(len(sets)), sizes)
    count = np.zeros(len(hashes), np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
        count = np.where(hot[at] == hashes, hot_n[at], 0)
        order = np.lexsort((count, owners))
        hashes, count = hashes[order], count[order]
    keep = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < (sizes - _spare(sizes, percent))[owners]
    return hashes[keep], count[keep], owners[keep]


def _shingled(parts: int, words: int, percent: int, frequent):
    """Documents to a row each, and the first of their shingles, once for each set in the task, dealt by hash.

    Frequent shingles are dealt by node, with their count as their frequency: a shingle that any
    part of all documents has doesn't meet in one task. Nor do the rows of documents, which are dealt in turn.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hot, hot_n = frequent.value
        fresh: list[tuple[bytes, np.ndarray]] = []
        held: list[tuple[np.ndarray, ...]] = []
        names: list[bytes] = []
        size = done = 0

        def select() -> int:
            held.append(_dealt_first([s for _, s in fresh], hot, hot_n, percent))
            held[-1][2][:] += len(names)
            names.extend(n for n, _ in fresh)
            fresh.clear()
            return len(held[-1][0])

        def flush() -> Iterator[dict]:
            hashes, count, owners = (np.concatenate(x) for x in zip(*held, strict=True))
            nodes = np.frombuffer(b"".join(names), _NODE)
            rare = count == 0
            yield from _deal(_BY_HASH, (hashes[rare] % np.uint64(parts)).astype(np.int64), parts, hashes[rare], None, owners[rare], nodes)
            known = ~rare
            yield from _deal(_BY_NODE, _part_of(nodes, parts)[owners[known]], parts, hashes[known], (np.minimum(count[known], _HOT - 1) + _HOT).astype(np.uint32), owners[known], nodes)

        for row, node, own, new in _sets(batches, words):
            yield {"part": done % parts, "kind": _DOCUMENT, **row, "n": len(own), "node": node}
            done += 1
            if new:
                yield {"part": int(_part_of(np.frombuffer(node, _NODE), parts)[0]), "kind": _SIZE, "n": len(own), "node": node}
                fresh.append((node, own))
                if len(fresh) == 500:
                    size += select()
                    if size >= _FLUSH:
                        yield from flush()
                        held, names, size = [], [], 0
        if fresh:
            select()
        if held:
            yield from flush()

    return lambda batches: _batches(rows(batches), _DEALT)


def _apart(batches: Iterator[pa.RecordBatch], kind: int) -> Iterator[dict | list[dict]]:
    """Rows of other kinds at once; those of ``kind`` as one list at the end."""
    held = []
    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"] != kind:
                yield r
            else:
                held.append(r)
    yield held


def _shared(parts: int):
    """Shingles of one part of the hashes to those that two nodes have or more, dealt by node."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for r in _apart(batches, _BY_HASH):
            if isinstance(r, dict):
                yield r
            elif r:
                hashes, _, owners, nodes = _gather(r)
                order = np.lexsort((owners, hashes))
                hashes, owners = hashes[order], owners[order]
                fresh = np.r_[True, (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])]
                hashes, owners = hashes[fresh], owners[fresh]
                first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
                df = np.repeat(np.diff(np.r_[first, len(hashes)]), np.diff(np.r_[first, len(hashes)]))
                keep = df > 1
                if keep.any():
                    owners = owners[keep]
                    yield from _deal(_BY_NODE, _part_of(nodes, parts)[owners], parts, hashes[keep], df[keep].astype(np.uint32), owners, nodes)

    return lambda batches: _batches(rows(batches), _DEALT)


def matches_for(df: np.ndarray, needed: int) -> int:
    """How many matches a node asks for: of 1, 2, 4 and 8 that with the least estimated cost.

    ``df`` ascends. A prefix touches the postings of its shingles; asking for ``l`` matches leaves
    at most the ``l``-th part of them as candidates, each verified at a cost like its set's size.
    """
    touched = np.cumsum(df, dtype=np.int64)
    cost = {m: touched[len(df) - needed + m - 1] * (1 + len(df) / 8 / m) for m in (1, 2, 4, 8) if m <= needed}
    return min(cost, key=cost.__getitem__)


def _prefixes(percent: int):
    """Shared shingles of one part of the nodes to those nodes that have enough of them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sizes: dict[bytes, int] = {}
        for r in _apart(batches, _BY_NODE):
            if isinstance(r, list):
                if r:
                    yield from enough(r, sizes)
            elif r["kind"] == _SIZE:
                sizes[r["node"]] = r["n"]
            else:
                yield {k: r[k] for k in ("doc_id", "text_hash", "n", "node")}

    def enough(dealt: list[dict], sizes: dict[bytes, int]) -> Iterator[dict]:
        hashes, df, owners, nodes = _gather(dealt)
        order = np.lexsort((hashes, df, owners))
        hashes, df, owners = hashes[order].view(np.int64), df[order], owners[order]
        # A node that two tasks have found has its frequent shingles twice.
        fresh = np.r_[True, (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])]
        hashes, df, owners = hashes[fresh], df[fresh], owners[fresh]
        ends = np.searchsorted(owners, np.arange(len(nodes) + 1))
        for k, node in enumerate(nodes):
            own, n = slice(ends[k], ends[k + 1]), sizes[node.tobytes()]
            shared, needed = int(ends[k + 1] - ends[k]), _needed(n, percent)
            if shared >= needed:
                matches = matches_for(df[own] & np.uint32(_HOT - 1), needed)
                yield {"n": n, "node": node.tobytes(), "shared": shared, "prefix": hashes[own][: shared - needed + matches]}

    return lambda batches: _batches(rows(batches), _NODES)


def _whole_sets(words: int):
    """Documents to the nodes and sets that are new to the task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for _, node, own, new in _sets(batches, words):
            if new:
                yield {"node": node, "tokens": own.view(np.int64)}

    return lambda batches: _batches(rows(batches), "node binary, tokens array<bigint>")


def _sets_of(nodes: DataFrame, rows: DataFrame, texts: DataFrame, words: int, most_sent: int) -> DataFrame:
    """``id``, ``n`` and ``tokens`` of ``nodes`` (node, id), from one text each.

    Which texts those are is broadcast if it is at most ``most_sent`` ids, and joined otherwise.
    """
    wanted = stored(rows.join(nodes, "node").groupBy("id").agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "wanted")
    ids = wanted.where("doc_id IS NOT NULL").distinct()
    source = texts.join(F.broadcast(ids) if wanted.count() <= most_sent else ids, "doc_id", "left_semi")
    if not wanted.where("doc_id IS NULL").isEmpty():
        source = source.unionByName(texts.where("doc_id IS NULL"))
    once = source.mapInArrow(_whole_sets(words), "node binary, tokens array<bigint>").groupBy("node").agg(F.first("tokens").alias("tokens"))
    return stored(once.join(nodes, "node").select("id", F.size("tokens").cast("bigint").alias("n"), "tokens"), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs ``a``, ``b`` of nodes that link."""
    of = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"tokens_{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.withColumn("i", F.size(F.array_intersect("tokens_a", "tokens_b"))).where(F.expr(f"100 * i >= {percent} * (n_a + n_b - i)")).select("a", "b")


def _near(percent: int, n_a: Column, n_b: Column) -> Column:
    return (100 * n_a >= percent * n_b) & (100 * n_b >= percent * n_a)


def _spared(n: str, percent: int) -> str:
    """``_spare`` in SQL."""
    return f"(({n}) * {max(2 * percent - 25, 0)} div 200)"


def _block_links(percent: int):
    """Links between the nodes of two blocks, as many as join their components."""
    import pandas as pd

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        n, comp = group["n"].to_numpy(np.int64), pd.factorize(group["comp"])[0]
        sizes = [len(t) for t in group["tokens"]]
        _, flat, count = np.unique(np.concatenate(group["tokens"].to_numpy()), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(group)), sizes)
        both = count[flat] > 1
        flat, owner = np.unique(flat[both], return_inverse=True)[1], owner[both]
        overlap = np.zeros((len(group), len(group)), np.float32)
        for start in range(0, int(flat.max(initial=-1)) + 1, 4096):
            here = (flat >= start) & (flat < start + 4096)
            dense = np.zeros((len(group), 4096), np.float32)
            dense[owner[here], flat[here] - start] = 1
            overlap += dense @ dense.T
        i = overlap.astype(np.int64)
        link = np.triu(100 * i >= percent * (n[:, None] + n[None, :] - i), 1) & (comp[:, None] != comp[None, :])
        top = list(range(comp.max(initial=-1) + 1))

        def find(x: int) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        kept = []
        for a, b in zip(*(x.tolist() for x in np.nonzero(link)), strict=True):
            x, y = find(comp[a]), find(comp[b])
            if x != y:
                top[x] = y
                kept.append((a, b))
        ids = group["id"].to_numpy()
        return pd.DataFrame({"a": [ids[a] for a, _ in kept], "b": [ids[b] for _, b in kept]}, dtype="int64")

    return verify


def _long_lists(long: DataFrame, sets: DataFrame, percent: int, block: int, steps: int = 8) -> DataFrame:
    """Links within lists of many nodes: each pair of blocks of near sizes is a task.

    Sizes fall in grades, ``steps`` of them from a size to the largest that it can link with. Against
    a block whose sizes are known, a node needs a higher overlap and so a shorter prefix; beyond
    that prefix it stays out of the task, and often out of all. A list may hold any part of the nodes: its
    rows learn into how many blocks it is cut in several ways, and are dealt by block from then on.
    """
    grade = F.floor(F.log(F.col("n").cast("double")) / (F.log(F.lit(100 / percent)) / steps) + 1e-9)
    placed = long.select("token", "id", "n", "shared", "pos", "comp", grade.alias("grade"), F.struct("token", grade.alias("grade")).alias("list"))
    counts = placed.groupBy("list").agg(F.ceil(F.count("*") / block).alias("cuts"))
    placed = spread_join(placed, counts, "list", ways=64).withColumn("cut", F.pmod(F.xxhash64("id"), "cuts")).drop("list", "cuts")
    blocks = placed.groupBy("token", "grade", "cut").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"))
    one, two = (blocks.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("grade", "cut", "low", "high", "least", "most")]) for x in "ab")
    apart = F.col("grade_b") - F.col("grade_a")
    near = ((apart == 0) & (F.col("cut_b") >= F.col("cut_a")) | apart.between(1, steps + 1)) & (100 * F.col("most_a") >= percent * F.col("least_b"))
    several = ~((F.col("low_a") == F.col("high_b")) & (F.col("high_a") == F.col("low_b")) & (F.col("low_a") == F.col("high_a")))
    tasks = one.join(two, "token").where(near & several).withColumn("task", F.xxhash64("token", "grade_a", "cut_a", "grade_b", "cut_b"))
    end = lambda x, y: F.struct(F.col(f"grade_{x}").alias("grade"), F.col(f"cut_{x}").alias("cut"), F.col(f"least_{y}").alias("least"), F.col(f"most_{y}").alias("most"))
    rows = tasks.select("token", "task", F.explode(F.array_distinct(F.array(end("a", "b"), end("b", "a")))).alias("end")).select("token", "task", "end.*")
    # What the pair shares of what both have dealt is least with the least or with the largest of the others.
    shares = lambda m: F.expr(f"ceil({percent} * (n + {m}) / {100 + percent}) - {_spared(f'greatest(n, {m})', percent)}")
    needed = F.greatest(F.lit(1), F.least(shares("least"), shares("most")))
    members = placed.join(rows, ["token", "grade", "cut"]).where(F.col("pos") <= F.col("shared") - needed).select("token", "task", "id", "comp")
    return members.join(sets, "id").groupBy("token", "task").applyInPandas(_block_links(percent), "a bigint, b bigint")


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 75, short_list: int = 48, block: int = 256, share: float = 1e-3, most_frequent: int = 500_000, most_held: int = 4_000_000, most_sent: int = 2_000_000) -> DataFrame:
    """``doc_id``, ``text_hash`` (its xxhash64), ``n_shingles`` and ``component_id`` for each row of ``docs``.

    Two documents link when their shingle sets have a Jaccard similarity of ``percent`` or more.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    hot, hot_n, size = frequent_shingles(texts, words, share, most_frequent)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size - _spare(size, percent)) // most_held))
    frequent = spark.sparkContext.broadcast((hot, hot_n))
    dealt = texts.mapInArrow(_shingled(parts, words, percent, frequent), _DEALT)
    shared = dealt.repartitionById(parts, F.col("part")).mapInArrow(_shared(parts), _DEALT)
    table = stored(shared.repartitionById(parts, F.col("part")).mapInArrow(_prefixes(percent), _NODES).withColumn("id", F.monotonically_increasing_id()), "shingles")
    rows, nodes = table.where("prefix IS NULL").select("doc_id", "text_hash", "n", "node"), table.where("prefix IS NOT NULL").drop("doc_id", "text_hash")

    postings = nodes.select("id", "n", "shared", (F.col("shared") - F.size("prefix")).alias("rest"), F.posexplode("prefix").alias("pos", "token"))
    lists = postings.groupBy("token").agg(F.count("*").alias("listed"), F.min("id").alias("least")).where("listed > 1")
    met = stored(postings.join(lists, "token").select("token", "id", "n", "shared", "rest", "pos", "listed", "least"), "postings")
    sets = _sets_of(nodes.select("node", "id").join(met.select("id").distinct(), "id", "left_semi"), rows.where("n > 0"), texts, words, most_sent)
    # Which stars to try is a guess; what they miss, the second step finds.
    near = F.expr(f"{percent} * 2 * first(n) <= {100 + percent} * (count(*) + first(rest) + {_spared('first(n)', percent)})")
    stars = met.where("id <> least").groupBy(F.col("id").alias("a"), F.col("least").alias("b")).agg(near.alias("near")).where("near").select("a", "b")
    first = stored(_verified(stars, sets, percent), "links")
    comp = connected(first)

    labelled = met.drop("least").join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root")
    mixed = labelled.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("token")
    open_ = stored(labelled.join(mixed, "token", "left_semi"), "open")
    long = open_.where(F.col("listed") > short_list)
    few = open_.where(F.col("listed") <= short_list).join(long.groupBy("id").agg(F.count("*").alias("hidden")), "id", "left").withColumn("hidden", F.coalesce("hidden", F.lit(0)))
    side = lambda x: few.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("n", "shared", "rest", "pos", "comp", "hidden")], F.col("id").alias(x))
    spared = _spared("greatest(n_a, n_b)", percent)
    enough = F.expr(f"{100 + percent} * (least(pos_a, pos_b) + least(shared_a - pos_a, shared_b - pos_b) + {spared}) >= {percent} * (n_a + n_b)")
    meet = (F.col("a") < F.col("b")) & (F.col("comp_a") != F.col("comp_b")) & _near(percent, F.col("n_a"), F.col("n_b")) & enough
    # What two prefixes don't share in short lists, their long lists and the rest of one of the sets have to.
    reach = F.expr(f"{percent} * (first(n_a) + first(n_b)) <= {100 + percent} * (count(*) + least(first(hidden_a), first(hidden_b)) + greatest(first(rest_a), first(rest_b)) + {_spared('greatest(first(n_a), first(n_b))', percent)})")
    pairs = side("a").join(side("b"), "token").where(meet).groupBy("a", "b").agg(reach.alias("reach")).where("reach").select("a", "b")
    more = _verified(pairs, sets, percent)
    much = _long_lists(long, sets, percent, block)
    second = stored(more.unionByName(much), "links")

    ends = lambda x: comp.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    lifted = second.join(ends("a"), "a", "left").join(ends("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    then = connected(lifted).select(F.col("node").alias("root"), F.col("root").alias("top"))
    # A component may have been without a link in either step; its node is then its own root.
    alone = then.join(comp.select("root").distinct(), "root", "left_anti").select(F.col("root").alias("id"), F.col("top").alias("root"))
    labels = comp.withColumnRenamed("node", "id").join(then, "root", "left").select("id", F.coalesce("top", "root").alias("root")).unionByName(alone)

    # Nodes that link with nothing have their documents only.
    grouped = nodes.select("id", "node").join(labels, "id").select("node", "root")
    lows = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("low")).join(grouped, "node", "left")
    tops = lows.where("root IS NOT NULL").groupBy("root").agg(F.min("low").alias("top"))
    of = lows.join(tops, "root", "left").select("node", F.when(F.col("root").isNull(), F.col("low")).otherwise(F.col("top")).alias("component_id"))
    linked = rows.where("n > 0").join(of, "node").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(rows.where("n = 0").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
