"""Scans and positional indexes over text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvid.functions.text import count_of, lines, match_starts
from corvid.operators.intervals import containing, outside
from corvid.plans.registry import query
from corvid.sources.tables import table

_LINES = """
l AS (SELECT doc_id, i AS line_no, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_byte, line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
"""


@query(f"WITH {_LINES} SELECT doc_id, line_no::INTEGER AS line_no, start_byte, strlen(line)::INTEGER AS n_bytes FROM l")
def line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and length in bytes of every line."""
    return lines(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "line_no", "start_byte", F.octet_length("line").alias("n_bytes"))


@query(f"""WITH {_LINES}, o AS (SELECT doc_id, unnest(range(0, strlen(text), 500))::BIGINT AS at FROM documents)
SELECT o.doc_id, o.at, l.line_no::INTEGER AS line_no FROM o JOIN l ON o.doc_id = l.doc_id AND o.at >= l.start_byte AND o.at <= l.start_byte + strlen(l.line)""")
def line_of_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of every five hundredth byte."""
    docs = table(spark, sf_dir, "documents")
    offsets = docs.where(F.octet_length("text") > 0).select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.octet_length("text").cast("bigint") - 1, F.lit(500).cast("bigint"))).alias("at"))
    spans = lines(docs, "doc_id").select("doc_id", "line_no", "start_byte", (F.col("start_byte") + F.octet_length("line") + 1).alias("end_byte"))
    return containing(offsets, spans, ["doc_id"], "at", "start_byte", "end_byte", width=4096).select("doc_id", "at", "line_no")


@query(f"WITH {_LINES} SELECT doc_id, line_no::INTEGER AS line_no, strpos(line, '#')::INTEGER AS marker, starts_with(ltrim(line, ' ' || chr(9)), '#') AS own_line FROM l WHERE strpos(line, '#') > 0")
def comment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a comment marker, and whether nothing stands before it."""
    at = F.instr("line", "#")
    return lines(table(spark, sf_dir, "documents"), "doc_id").where(at > 0).select("doc_id", "line_no", at.alias("marker"), F.regexp_replace("line", r"^[ \t]+", "").startswith("#").alias("own_line"))


@query(f"WITH {_LINES} SELECT doc_id, line_no::INTEGER AS line_no FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM l) WHERE ends_with(before, '|') OR ends_with(before, '\\')")
def continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that the line before continues into, by its last character."""
    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("line_no"))
    return lines(table(spark, sf_dir, "documents"), "doc_id").withColumn("before", before).where(F.col("before").endswith("|") | F.col("before").endswith("\\")).select("doc_id", "line_no")


@query("""SELECT doc_id, CASE WHEN lf = 0 THEN 'none' WHEN crlf = 0 THEN 'lf' WHEN crlf = lf THEN 'crlf' ELSE 'mixed' END AS style, lf::INTEGER AS n_breaks
FROM (SELECT doc_id, len(string_split(text, chr(10))) - 1 AS lf, len(string_split(text, chr(13) || chr(10))) - 1 AS crlf FROM documents)""")
def ending_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a document's lines end."""
    lf, crlf = count_of(F.col("text"), "\n"), count_of(F.col("text"), "\r\n")
    style = F.when(lf == 0, "none").when(crlf == 0, "lf").when(crlf == lf, "crlf").otherwise("mixed")
    return table(spark, sf_dir, "documents").select("doc_id", style.alias("style"), lf.alias("n_breaks"))


@query(f"WITH {_LINES} SELECT doc_id, count(*)::BIGINT AS n_lines FROM l WHERE trim(line, ' ' || chr(9)) <> '' GROUP BY doc_id HAVING count(*) > 20")
def script_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of more than 20 lines that aren't blank. Counted within the row: no shuffle."""
    n = F.size(F.filter(F.split("text", "\n"), lambda x: ~x.rlike(r"^[ \t]*$"))).cast("bigint")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n_lines")).where("n_lines > 20")


@query("""SELECT doc_id, len(regexp_extract_all(text, '(?:[Ll]icen[sc]ed?|[Cc]opyright|TODO|FIXME)'))::INTEGER AS n_marks, regexp_matches(text, '(?:TODO|FIXME)\\([a-z]+\\)') AS owned
FROM documents WHERE regexp_matches(text, '(?:[Ll]icen[sc]ed?|[Cc]opyright|TODO|FIXME)')""")
def todo_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with marks of open work or licences, their number, and whether one has an owner."""
    marks = r"(?:[Ll]icen[sc]ed?|[Cc]opyright|TODO|FIXME)"
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(marks))
    return docs.select("doc_id", F.regexp_count("text", F.lit(marks)).alias("n_marks"), F.col("text").rlike(r"(?:TODO|FIXME)\([a-z]+\)").alias("owned"))


@query("""SELECT page_id, coalesce(nullif(regexp_extract(html, '^#!.*/([a-z]+)', 1), ''), nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), ''), CASE WHEN url LIKE '%.php%' THEN 'php' END, 'unknown') AS dialect FROM pages""")
def dialect_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of marker line, declared language and name ending that says something."""
    some = lambda column, pattern: F.nullif(F.regexp_extract(column, pattern, 1), F.lit(""))
    dialect = F.coalesce(some("html", r"^#!.*/([a-z]+)"), some("html", r'<html lang="([a-z]+)"'), F.when(F.col("url").contains(".php"), F.lit("php")), F.lit("unknown"))
    return table(spark, sf_dir, "pages").select("page_id", dialect.alias("dialect"))


@query("""SELECT page_id, url FROM pages WHERE regexp_matches(url, '/(en|fr)/') AND NOT regexp_matches(url, '://(ads|track)[^/]*/') AND NOT regexp_matches(url, '/(node_modules|vendor|\\.git)/')""")
def scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs under the wanted paths and not under ignored ones."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").where(url.rlike("/(en|fr)/") & ~url.rlike("://(ads|track)[^/]*/") & ~url.rlike(r"/(node_modules|vendor|\.git)/")).select("page_id", "url")


@query("""SELECT page_id, i::INTEGER AS ordinal, target FROM (SELECT page_id, unnest(m) AS target, generate_subscripts(m, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS m FROM pages))""")
def embedded_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets that pages embed, in order."""
    found = F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("at", "target")
    return table(spark, sf_dir, "pages").select("page_id", found).select("page_id", (F.col("at") + 1).alias("ordinal"), "target")


@query("""WITH m AS (SELECT page_id, regexp_extract_all(html, '<p>[^<]+') AS m, regexp_split_to_array(html, '<p>[^<]+') AS g FROM pages),
s AS (SELECT page_id, i, length(m[i]) - 3 AS n, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) + 3 AS host FROM m, unnest(range(1, len(m) + 1)) AS r(i)),
f AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS own FROM s),
o AS (SELECT page_id, unnest(range(0, sum(n)::BIGINT, 100)) AS at FROM f GROUP BY page_id)
SELECT o.page_id, o.at::BIGINT AS at, (f.host + o.at - f.own)::BIGINT AS host_at FROM o JOIN f ON o.page_id = f.page_id AND o.at >= f.own AND o.at < f.own + f.n""")
def offset_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions in the joined paragraphs of a page, mapped back to the page.

    The map's pieces stay in an array beside each position: no shuffle.
    """
    pattern = "<p>[^<]+"
    pages = table(spark, sf_dir, "pages").where(F.col("html").rlike(pattern))
    sizes = F.transform(F.regexp_extract_all("html", F.lit(pattern), F.lit(0)), lambda m: F.length(m) - 3)
    mapped = pages.select("page_id", match_starts(F.col("html"), pattern).alias("hosts"), sizes.alias("sizes"))
    pieces = F.aggregate(F.arrays_zip("hosts", "sizes"), F.expr("named_struct('at', 0, 'out', CAST(array() AS array<struct<own:int,host:int,n:int>>))"), lambda s, x: F.struct((s["at"] + x["sizes"]).alias("at"), F.concat(s["out"], F.array(F.struct(s["at"].alias("own"), (x["hosts"] + 3).alias("host"), x["sizes"].alias("n")))).alias("out")))
    whole = mapped.select("page_id", pieces.alias("p")).select("page_id", F.col("p.out").alias("map"), F.col("p.at").alias("total"))
    at = F.explode(F.sequence(F.lit(0), F.col("total") - 1, F.lit(100))).alias("at")
    piece = F.get(F.filter("map", lambda x: (x["own"] <= F.col("at")) & (F.col("at") < x["own"] + x["n"])), 0)
    return whole.select("page_id", "map", at).withColumn("piece", piece).select("page_id", F.col("at").cast("bigint").alias("at"), (F.col("piece.host") + F.col("at") - F.col("piece.own")).cast("bigint").alias("host_at"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key under which a document's result is kept."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


_CACHED = """k AS (SELECT doc_id, sha256(text) AS hash FROM documents),
c AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'stale' ELSE hash END AS hash FROM k JOIN labels USING (doc_id))"""


def _cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Keys of all documents, and the kept ones: labelled documents, of which toxic ones have changed."""
    keys = content_hash(spark, sf_dir)
    kept = keys.join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id").select("doc_id", F.when(F.col("toxic") == 1, "stale").otherwise(F.col("hash")).alias("hash"))
    return keys, kept


@query(f"WITH {_CACHED} SELECT doc_id, hash FROM k WHERE EXISTS (SELECT 1 FROM c WHERE c.doc_id = k.doc_id AND c.hash = k.hash)")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose kept result is still right."""
    keys, kept = _cache(spark, sf_dir)
    return keys.join(kept, ["doc_id", "hash"], "left_semi")


@query(f"WITH {_CACHED} SELECT doc_id, hash FROM k WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = k.doc_id AND c.hash = k.hash)")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have to be analysed again."""
    keys, kept = _cache(spark, sf_dir)
    return keys.join(kept, ["doc_id", "hash"], "left_anti")


@query("SELECT lang, source, count(*)::BIGINT AS n_docs, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY CUBE (lang, source)")
def report_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by language and source, each alone, and over all."""
    return table(spark, sf_dir, "documents").cube("lang", "source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


@query("SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem")
def sorted_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct findings in report order: by place, then by kind."""
    columns = ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"]
    return table(spark, sf_dir, "lineitem").select(*columns).distinct().orderBy(*columns)


@query(f"""WITH {_LINES}, f AS (SELECT doc_id, line_no::BIGINT AS line_no, unnest([CASE WHEN line LIKE '%###%' THEN 'D1' END, CASE WHEN line LIKE '%!!%' THEN 'D2' END, CASE WHEN line LIKE '%|%' THEN 'D3' END]) AS code FROM l),
r AS (SELECT doc_id, line_no AS start, line_no + 3 AS stop FROM l WHERE line LIKE '%$$$%')
SELECT doc_id, line_no, code FROM f WHERE code IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = f.doc_id AND f.line_no >= r.start AND f.line_no < r.stop)""")
def unsuppressed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of three line rules that no directive covers, in report order.

    A directive covers its line and the two behind it; ranges that touch merge before they meet findings.
    """
    rows = lines(table(spark, sf_dir, "documents"), "doc_id")
    codes = F.array(*[F.when(F.col("line").contains(mark), F.lit(code)) for mark, code in (("###", "D1"), ("!!", "D2"), ("|", "D3"))])
    found = rows.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))
    covers = rows.where(F.col("line").contains("$$$")).select("doc_id", F.col("line_no").cast("bigint").alias("start"), (F.col("line_no") + 3).cast("bigint").alias("stop"))
    return outside(found, covers, ["doc_id"], "line_no", "start", "stop", width=64).orderBy("doc_id", "line_no", "code")
