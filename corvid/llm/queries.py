"""The numbered operators over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm import chat, decontaminate, jaccard_join, mixing, periodic, quality, secrets, spelling, tokens, topk, toxicity, urls, warc
from corvid.llm.learn import fold


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words inside windows of benchmark items, and the items, which a digest stands for."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, read(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of every twentieth, by inner product of floor(64 x)."""
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's block, slot and position, with sources weighted as the roots of their sizes."""
    return mixing.mix_sources(read(spark, sf_dir, "documents").select("doc_id", "source"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's toxicity, learnt outside a fifth of the labels."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train_on(docs, read(spark, sf_dir, "labels"), folds=5, held_out=0)
    return _judged(toxicity.score_toxicity(docs, model), 5, 0, 0.5)


def _judged(scored: DataFrame, folds: int, held_out: int, least: float) -> DataFrame:
    return scored.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of shingles, and the least id of those that links of 75 percent reach."""
    return jaccard_join.jaccard_join(read(spark, sf_dir, "documents")).drop("text_hash")


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each encoded length, with what it answers as a context limit."""
    return tokens.with_totals(tokens.length_histogram(read(spark, sf_dir, "documents")))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's host, path, rule and verdict, and the ratio of the two models."""
    return urls.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "ratio")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's quality, learnt outside a quarter of the labels."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    field = quality.train_on(docs, read(spark, sf_dir, "labels"), folds=4, held_out=2)
    return _judged(quality.score_quality(docs, field), 4, 2, 0.7)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's secrets, from the ledger in the shared folder, which this extends by what it lacks."""
    found = secrets.scan_secrets(read(spark, sf_dir, "documents"), ledger=secrets.shared_ledger(spark))
    base = F.filter("findings", lambda x: x["kind"].isin([r.kind for r in secrets.BASE]))
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in secrets.BASE], F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("findings")).alias("spans"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages hold, read back from them."""
    return warc.round_trip(read(spark, sf_dir, "pages")).drop("url", "html")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frequent word of seven letters or more, and the form that it is a variant of.

    Every 31st run by hash loses a letter before words are counted. A null doc_id leaves its runs as they are.
    """
    runs = spelling.letter_runs(read(spark, sf_dir, "documents").select("doc_id", "text"), 7)
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.select(F.when(h % 31 == 0, cut).otherwise(F.col("run")).alias("word"))
    return spelling.variants(spelling.counted(words, 7, 2), times=10)


#: What conversation -1 says in both turns.
MARKS = "<|im_end|><|im_start|>assistant ok"


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all conversations, and one whose texts are marks, hold once formatted and read back."""
    own = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKS).alias("text"))
    said = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    none = [F.lit(None).cast(k).alias(x) for x, k in (("ref", "string"), ("width", "bigint"), ("height", "bigint"), ("seconds", "double"), ("pages", "bigint"))]
    parts = F.array(F.struct(F.lit("text").alias("type"), F.col("text"), *none))
    return chat.digests(chat.format_chats(said.withColumn("parts", parts)))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's runs of four periods and more; every tenth by hash repeats itself from somewhere on.

    A null doc_id leaves its text as it is.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    docs = docs.withColumn("words", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    placed = docs.withColumn("a", F.when(n > 0, g % n).cast("int")).withColumn("p", F.when(n > 0, 1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    repeated = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - F.col("a")) / F.col("p")).cast("int"))), F.lit(1), n - F.col("a"))
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), repeated), " ")
    docs = placed.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))
    top = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = periodic.find_runs(docs).withColumn("top", top)
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "top.start", (-F.col("top.less")).alias("length"), "top.period", F.floor(-1000 * F.col("top.less") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_topk": op2_topk,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_tokens": op6_tokens,
    "op7_urls": op7_urls,
    "op8_quality": op8_quality,
    "op9_secrets": op9_secrets,
    "op10_warc": op10_warc,
    "op11_spelling": op11_spelling,
    "op12_chat": op12_chat,
    "op13_periodic": op13_periodic,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP1 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM windows),
grams AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM d, sizes, unnest(range(1, len(w) - k + 2)) AS r(i)),
hits AS (SELECT g.doc_id, g.k, g.i, windows.item_id FROM grams g JOIN windows USING (k, g)),
words AS (SELECT DISTINCT doc_id, j FROM hits, unnest(range(i, i + k)) AS r(j)),
n AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
ids AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n_hit, 0)::BIGINT AS n_hit, coalesce(ids.n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids.s, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


_OP5 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""


def _spans_sql(rules: tuple[secrets.Rule, ...]) -> str:
    """Each match starts behind the pieces and matches before it, as splitting at it shows."""
    parts = []
    for rank, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, m[i] AS m, c[i] AS c, {r.least} AS least, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) AS start "
            f"FROM (SELECT doc_id, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {r.counted}) AS c, regexp_split_to_array(text, '{p}') AS g FROM d), unnest(range(1, len(m) + 1)) AS r(i)"
        )
    return " UNION ALL ".join(parts)


_OP9 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS (SELECT doc_id, rank, kind, start::BIGINT AS start, (start + length(m))::BIGINT AS stop FROM ({_spans_sql(secrets.RULES)}) WHERE length(c) >= least),
per AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, rank) FILTER (rank < {len(secrets.BASE)}) AS base, string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, rank) AS spans FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (doc_id)
"""

_OP2 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_OP10 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS hex, max(page_id) OVER (PARTITION BY sha1(b)) AS top FROM p),
bits AS (SELECT *, list_transform(range(32), lambda i: ('0x' || substr(hex, (i * 5 // 4 + 1)::INTEGER, 1))::INTEGER * 16 + coalesce(('0x' || nullif(substr(hex, (i * 5 // 4 + 2)::INTEGER, 1), ''))::INTEGER, 0)) AS pairs FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((pairs[i + 1] >> (3 - i * 5 % 4)) % 32 + 1)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM bits
"""

# The checksum of a text of which h is the UTF-8 in hexadecimal, from the usual table of a byte's eight steps.
_CRC = "crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS t(i)))"
_CRC_OF_H = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"

_OP11 = rf"""
WITH RECURSIVE {_CRC},
runs AS (SELECT doc_id, translate(r, '{_UPPER}', '{_LOWER}') AS r, count(*) AS m FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS r FROM documents) WHERE length(r) >= 7 GROUP BY ALL),
hashed AS (SELECT r, m, {_CRC_OF_H} AS crc FROM (SELECT *, hex(encode(concat(doc_id, ':', r))) AS h FROM runs), crc),
cut AS (SELECT CASE WHEN crc % 31 = 0 THEN concat(substr(r, 1, crc % length(r)), substr(r, crc % length(r) + 2)) ELSE r END AS word, m FROM hashed),
words AS MATERIALIZED (SELECT word, sum(m)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2),
less AS MATERIALIZED (SELECT word, n, i, concat(substr(word, 1, i), substr(word, i + 2)) AS rest FROM words, unnest(range(length(word))) AS t(i)),
near AS (SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN less l ON l.rest = a.word JOIN words b ON b.word = l.word
  UNION SELECT l.word, a.word, a.n FROM words a JOIN less l ON l.rest = a.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM near GROUP BY word),
formed AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * words.n THEN top END AS form_n,
  CASE WHEN top >= 10 * words.n THEN (SELECT min(other) FROM near WHERE near.word = words.word AND near.n = top) END AS form FROM words LEFT JOIN best USING (word)),
walk(word, here, step) AS (SELECT word, form, 1 FROM formed WHERE form IS NOT NULL UNION ALL SELECT walk.word, formed.form, step + 1 FROM walk JOIN formed ON formed.word = walk.here WHERE formed.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, step) AS root FROM walk GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM formed LEFT JOIN ends USING (word)
"""

_OP12 = rf"""
WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, t, CASE WHEN t = 0 THEN 'user' ELSE 'assistant' END, '{MARKS}' FROM range(2) AS r(t)),
s AS (SELECT *, length('<|im_start|>') + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>') + 1 AS chars FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS attachment_tokens
FROM s GROUP BY conv_id
"""

_OP13 = rf"""
WITH {_CRC},
d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w, {_CRC_OF_H} AS h FROM (SELECT *, hex(encode(doc_id::VARCHAR)) AS h FROM documents), crc),
e AS (SELECT doc_id, w, h, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, (h // 10) % 8 + 3 AS k FROM d),
f AS MATERIALIZED (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // k) + 1] END) END AS w FROM e),
grams AS MATERIALIZED (SELECT doc_id, i, hash(w[i + 1], w[i + 2], w[i + 3], w[i + 4], w[i + 5]) AS g FROM f, unnest(range(n - 4)) AS t(i)),
pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.g = b.g AND a.i < b.i),
islands AS (SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island),
long AS MATERIALIZED (SELECT * FROM islands WHERE length >= greatest(6, 4 * q)),
runs AS MATERIALIZED (SELECT * FROM long r WHERE NOT EXISTS (SELECT 1 FROM long s WHERE s.doc_id = r.doc_id AND s.q < r.q AND s.start <= r.start AND s.start + s.length >= r.start + r.length)),
per AS (SELECT doc_id, count(*) AS n_runs, min((-length, start, q)) AS top, string_agg(concat(start, ',', length, ',', q, chr(10)), '' ORDER BY start, q) AS said FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM runs),
collapsed AS (SELECT f.doc_id, string_agg(f.w[t.i + 1], ' ' ORDER BY t.i) AS said FROM f, unnest(range(n)) AS t(i) WHERE (f.doc_id, t.i) NOT IN (SELECT (doc_id, i) FROM gone) GROUP BY f.doc_id)
SELECT f.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top[2]::BIGINT AS start, (-top[1])::BIGINT AS length, top[3]::BIGINT AS period, (-1000 * top[1] // top[3])::BIGINT AS exponent_milli, sha256(coalesce(per.said, '')) AS runs_sha256, sha256(coalesce(collapsed.said, '')) AS collapsed_sha256
FROM f LEFT JOIN per USING (doc_id) LEFT JOIN collapsed USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op1_decontaminate": _OP1, "op2_topk": _OP2, "op10_warc": _OP10, "op5_jaccard_join": _OP5, "op9_secrets": _OP9, "op11_spelling": _OP11, "op12_chat": _OP12, "op13_periodic": _OP13}
