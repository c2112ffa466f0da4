"""Queries over texts, pages and feeds, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docflow.functions import text as fx
from docflow.operators import chunks, extract, feeds, packages, pages, planning, rules, timeline, usage
from docflow.plans.adapters import oracle, table, view
from docflow.plans.registry import query
from docflow.sources.readers import clean_markdown
from docflow.sources.shared import written

WS = fx.WS


def sq(s: str) -> str:
    """A SQL string."""
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {sq(pattern)}, {sq(by)}, 'g')"


def trim_sql(x: str) -> str:
    return sub(x, f"^[{WS}]+|[{WS}]+\\z")


def collapse_sql(x: str) -> str:
    return trim_sql(sub(x, f"[{WS}]+", " "))


def paragraphs_sql(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex({x}, {sq(f'\n[{WS}]*\n')}), lambda p: {collapse_sql('p')}), lambda p: p <> '')"


def normalise_sql(x: str) -> str:
    return f"array_to_string({paragraphs_sql(x)}, chr(10) || chr(10))"


# ---------------------------------------------------------------- sources
@query("s1_library", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC")
def s1(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))


HEADS = ("%PDF-1.4 ", "PK word/document.xml ", "PK META-INF/container.xml ", "PK other ", "", "x")


def _head(i: Column) -> Column:
    return F.get(F.array(*[F.lit(h) for h in HEADS]), (i % 6).cast("int"))


@query("s2_sniff_format", f"""WITH f AS (SELECT doc_id, {list(HEADS)}[1 + CAST(doc_id % 6 AS INT)] || CASE WHEN doc_id % 6 = 5 THEN '' ELSE text END AS c,
  CASE WHEN doc_id % 4 < 2 THEN 'a.TXT' ELSE 'a.exe' END AS name FROM documents)
  SELECT doc_id, CASE WHEN strlen(c) < 4 THEN NULL WHEN starts_with(c, '%PDF') THEN 'pdf' WHEN starts_with(c, 'PK') THEN CASE WHEN contains(c, 'word/document.xml') THEN 'docx'
  WHEN contains(c, 'META-INF/container.xml') THEN 'epub' END WHEN name = 'a.TXT' THEN 'txt' END AS format FROM f""")
def s2(s, d):
    i = F.col("doc_id")
    content = F.encode(F.concat(_head(i), F.when(i % 6 == 5, "").otherwise(F.col("text"))), "UTF-8")
    return table(s, d, "documents").select("doc_id", extract.sniff_format(content, F.when(i % 4 < 2, "a.TXT").otherwise("a.exe")).alias("format"))


_MARKS = ("\\*\\*(.+?)\\*\\*", "__(.+?)__", "\\*(.+?)\\*", "_(.+?)_", "`(.+?)`")


def markdown_sql(x: str) -> str:
    x = sub(x, "(?m)^```[\\s\\S]*?```")
    x = sub(x, f"(?m)^#{{1,6}}[{WS}]+")
    x = sub(x, "!?\\[([^\\]]*)\\]\\([^)]*\\)", "\\1")
    x = sub(x, "|".join(_MARKS), "\\1\\2\\3\\4\\5")
    x = sub(x, f"(?m)^[{WS}]*[-*+][{WS}]+")
    return sub(x, f"(?m)^[{WS}]*>[{WS}]?")


@query("s3_clean_markdown", f"SELECT doc_id, {normalise_sql(markdown_sql('''replace(text, chr(13) || chr(10), chr(10))'''))} AS text FROM documents")
def s3(s, d):
    return clean_markdown(table(s, d, "documents").select("doc_id", "text"))


_NAME = "url || ['.PDF', '.md', '.exe', '.docx', ''][1 + CAST(page_id % 5 AS INT)]"


def _named(s: SparkSession, d: str) -> DataFrame:
    ends = F.array(*[F.lit(x) for x in (".PDF", ".md", ".exe", ".docx", "")])
    return table(s, d, "pages").select("page_id", F.concat("url", F.get(ends, (F.col("page_id") % 5).cast("int"))).alias("name"), (F.length("html") * 4000).cast("long").alias("size"))


@query("s4_accept_uploads", f"""SELECT page_id, name, size FROM (SELECT page_id, {_NAME} AS name, length(html) * 4000 AS size FROM pages)
  WHERE regexp_matches(lower(name), '\\.(pdf|epub|docx|txt|md|markdown)$') AND size <= 20971520""")
def s4(s, d):
    return extract.accept_uploads(_named(s, d), "name", "size")


@query("s9_derive_title", f"SELECT page_id, left(regexp_replace({_NAME}, '\\.[^.]+$', ''), 200) AS title FROM pages")
def s9(s, d):
    return _named(s, d).select("page_id", fx.derive_title(F.col("name")).alias("title"))


# ---------------------------------------------------------------- extraction
@query("t1_markdown_to_text", f"SELECT doc_id, {markdown_sql('text')} AS text FROM documents")
def t1(s, d):
    return table(s, d, "documents").select("doc_id", fx.markdown_to_text(F.col("text")).alias("text"))


def entities_sql(x: str) -> str:
    for name in ("quot", "copy", "lt", "gt", "nbsp"):
        x = f"replace({x}, '&{name};', {sq(fx.ENTITIES[name])})"
    return f"replace({x}, '&amp;', '&')"


def html_sql(x: str) -> str:
    x = sub(x, "(?i)" + "|".join(f"<{t}[\\s\\S]*?</{t}\\s*>" for t in fx.UNREAD_TAGS))
    x = sub(sub(x, "<!--[\\s\\S]*?-->"), "(?i)<br\\s*/?>", "\n")
    x = sub(x, "</?([a-zA-Z][a-zA-Z0-9]*)[^>]*>", "\x01\\1\x02")
    x = sub(sub(x, f"(?i)\x01({fx.BLOCK_TAGS})\x02", "\n\n"), "\x01[^\x02]*\x02")
    return normalise_sql(entities_sql(x))


@query("t2_html_to_text", f"SELECT page_id, {html_sql('html')} AS text FROM pages")
def t2(s, d):
    return table(s, d, "pages").select("page_id", fx.html_to_text(F.col("html")).alias("text"))


@query("t3_decode_entities", f"SELECT page_id, {entities_sql('html')} AS html FROM pages")
def t3(s, d):
    return table(s, d, "pages").select("page_id", fx.decode_entities(F.col("html")).alias("html"))


@query("t4_normalise_paragraphs", oracle(f"SELECT doc_id, {normalise_sql('text')} AS text FROM paragraphs_v", "paragraphs_v"))
def t4(s, d):
    return view(s, d, "paragraphs_v").select("doc_id", fx.normalise_paragraphs(F.col("text")).alias("text"))


@query("t5_spine_order", """WITH m AS (SELECT page_id // 10 AS book_id, page_id, url AS content, [NULL, 'application/xhtml+xml', 'image/png', 'text/html'][1 + CAST(page_id % 4 AS INT)] AS media FROM pages)
  SELECT book_id, string_agg(content, chr(10) || chr(10) ORDER BY page_id DESC) AS text, count(*) AS chapters FROM m WHERE (media IS NULL OR media <> 'image/png') AND page_id % 7 <> 0 GROUP BY book_id""")
def t5(s, d):
    p = table(s, d, "pages").select(F.floor(F.col("page_id") / 10).cast("long").alias("book_id"), "page_id", "url", F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("path"))
    media = F.array(*[F.lit(x) for x in (None, "application/xhtml+xml", "image/png", "text/html")])
    spine = p.select("book_id", (-F.col("page_id")).alias("pos"), F.col("path").alias("idref"))
    manifest = p.select("book_id", F.col("path").alias("id"), F.col("path").alias("href"), F.get(media, (F.col("page_id") % 4).cast("int")).alias("media_type"))
    members = p.where("page_id % 7 <> 0").select("book_id", "path", F.concat(F.lit(" "), "url").alias("content"))
    return extract.spine_order(spine, manifest, members)


@query("t5_read_packages", f"""WITH m AS (SELECT page_id // 10 AS book_id, page_id, {html_sql('html')} AS text FROM pages WHERE page_id % 7 <> 0 AND page_id % 4 <> 2)
  SELECT book_id, string_agg(text, chr(10) || chr(10) ORDER BY page_id DESC) AS text, count(*) AS chapters FROM m WHERE text <> '' GROUP BY book_id""")
def t5_packages(s, d):
    """Ten pages a book, last first, as members with package XML: prefixes, encoded and relative paths, pictures, gaps."""
    n = F.col("page_id").cast("string")
    p = table(s, d, "pages").select(F.floor(F.col("page_id") / 10).cast("long").alias("book_id"), "page_id", F.concat(F.lit("text/page "), n, F.lit(".xhtml")).alias("path"), F.col("html").alias("content"))
    media = F.get(F.array(*[F.lit(x) for x in ("", ' media-type="application/xhtml+xml"', ' media-type="image/png"', ' media-type="text/html"')]), (F.col("page_id") % 4).cast("int"))
    href = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("../text/page%20"), n)).otherwise(F.concat(F.lit("./../text/page "), n))
    lines = p.groupBy("book_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("page_id")).alias("pos"), F.concat(F.lit('item id="p'), n, F.lit('" href="'), href, F.lit('.xhtml"'), media, F.lit("/>")).alias("item"), F.concat(F.lit('itemref idref="p'), n, F.lit('"/>')).alias("ref")))).alias("x")
    )
    prefix = F.when(F.col("book_id") % 2 == 0, F.lit("<opf:")).otherwise(F.lit("<"))

    def tags(part: str) -> Column:
        return F.array_join(F.transform("x", lambda e: F.concat(prefix, e[part])), "\n")

    close = F.replace(prefix, F.lit("<"), F.lit("</"))
    package = F.concat(
        F.lit("<?xml version='1.0'?>"), prefix, F.lit("package xmlns:opf='http://www.idpf.org/2007/opf'>"), prefix, F.lit("manifest>"), tags("item"), close, F.lit("manifest>"),
        prefix, F.lit("spine>"), tags("ref"), close, F.lit("spine>"), close, F.lit("package>"),
    )
    container = F.lit("<container><rootfiles><rootfile full-path='OEBPS/book.opf'/></rootfiles></container>")
    stored = p.where("page_id % 7 <> 0").drop("page_id")
    members = stored.unionByName(lines.select("book_id", F.lit("OEBPS/book.opf").alias("path"), package.alias("content"))).unionByName(lines.select("book_id", F.lit(packages.CONTAINER).alias("path"), container.alias("content")))
    return packages.read_books(members)


@query("t6_runs_to_paragraphs", oracle(f"""WITH r AS (SELECT document_id AS doc_id, paragraph_idx AS paragraph_no, idx, CASE WHEN status = 'failed' THEN ' ' ELSE ' ' || status || chr(9) || left(content_hash, 4) END AS t FROM chunks_v)
  SELECT doc_id, paragraph_no, paragraph FROM (SELECT doc_id, paragraph_no, {collapse_sql("string_agg(t, '' ORDER BY idx)")} AS paragraph FROM r GROUP BY doc_id, paragraph_no) WHERE paragraph <> ''""", "chunks_v"))
def t6(s, d):
    text = F.when(F.col("status") == "failed", " ").otherwise(F.concat(F.lit(" "), "status", F.lit("\t"), F.substring("content_hash", 1, 4)))
    return extract.runs_to_paragraphs(view(s, d, "chunks_v").select(F.col("document_id").alias("doc_id"), F.col("paragraph_idx").alias("paragraph_no"), F.col("idx").alias("run_no"), text.alias("text")))


@query("t7_fragments_to_lines", """WITH w AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents), f AS (SELECT doc_id, i - 1 AS n, ws[i] || ' ' AS str FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w))
  SELECT doc_id AS page_id, n // 10 AS line_no, string_agg(str, '' ORDER BY n) AS line, CAST(1000 - 12 * min(n // 10) AS DOUBLE) AS y FROM f GROUP BY doc_id, n // 10
  HAVING count(*) = 10 OR regexp_matches(string_agg(str, ''), '[^ \\t-\\r]')""")
def t7(s, d):
    frags = table(s, d, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", " ")).alias("frag_no", "w"))
    y = (F.lit(1000) - 12 * F.floor(F.col("frag_no") / 10)).cast("double")
    return extract.fragments_to_lines(frags.select("page_id", "frag_no", F.concat("w", F.lit(" ")).alias("str"), y.alias("y"), (F.col("frag_no") % 10 == 9).alias("has_eol")))


@query("t8_adaptive_breaks", """WITH g AS (SELECT event_id, user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
  o AS (SELECT user_id, list_sort(list(gap))[1 + CAST(floor(0.25 * count(*)) AS INT)] AS usual FROM g WHERE gap > 0 GROUP BY user_id)
  SELECT event_id, g.user_id, gap, usual AS usual_gap, coalesce(gap > usual * 1.5, false) AS is_break FROM g LEFT JOIN o ON g.user_id = o.user_id""")
def t8(s, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    before = F.lag(us).over(Window.partitionBy("user_id").orderBy("ts"))
    gaps = table(s, d, "events").select("event_id", "user_id", (us - before).alias("gap"))
    return extract.adaptive_breaks(gaps, "user_id", "gap").select("event_id", "user_id", "gap", "usual_gap", "is_break")


# ---------------------------------------------------------------- page cleaning
LINES = f"""SELECT book, page_no, i - 1 AS line_no, {sub('ls[i]', f'[{WS}]+\\z')} AS line FROM (SELECT book, page_no, ls, unnest(range(1, len(ls) + 1)) AS i FROM
  (SELECT book, page_no, string_split_regex(text, '\\r?\\n') AS ls FROM books_v))"""
KEY = collapse_sql(sub("lower(line)", "[0-9]+", "#"))
PAGE_NUMBER_SQL = "(" + " OR ".join(f"regexp_matches({trim_sql('line')}, {sq(p)})" for p in fx.PAGE_NUMBER) + ")"
FURNITURE = f"""SELECT book, key, count(*) AS n, max(pages) AS pages FROM (SELECT DISTINCT book, page_no, key, pages FROM (SELECT l.book, l.page_no, {KEY} AS key, pages,
  row_number() OVER (PARTITION BY l.book, page_no ORDER BY line_no) AS a, row_number() OVER (PARTITION BY l.book, page_no ORDER BY line_no DESC) AS b
  FROM ({LINES}) l JOIN (SELECT book, count(*) AS pages FROM books_v GROUP BY book) p ON l.book = p.book WHERE {trim_sql('line')} <> '') WHERE (a <= 3 OR b <= 3) AND key <> '')
  WHERE pages >= 3 GROUP BY book, key HAVING count(*) >= ceil(max(pages) * 0.1)"""
DROPPED = f"""SELECT l.book, l.page_no, l.line_no, l.line FROM ({LINES}) l LEFT JOIN (SELECT *, min(pos) OVER (PARTITION BY book, page_no, line) AS f, count(*) OVER (PARTITION BY book, page_no) AS n FROM
  (SELECT *, row_number() OVER (PARTITION BY book, page_no ORDER BY line_no) - 1 AS pos FROM ({LINES}) WHERE {trim_sql('line')} <> '')) c ON l.book = c.book AND l.page_no = c.page_no AND l.line_no = c.line_no
  LEFT JOIN ({FURNITURE}) k ON l.book = k.book AND k.key = {KEY.replace('line', 'l.line')}
  WHERE c.f IS NULL OR NOT ({PAGE_NUMBER_SQL.replace('(line,', '(l.line,')} OR ((f < 3 OR f >= c.n - 3) AND k.key IS NOT NULL))"""


def _book_lines(s: SparkSession, d: str) -> DataFrame:
    return pages.page_lines(view(s, d, "books_v"))


@query("c1_line_key", oracle(f"SELECT book, page_no, line_no, {KEY} AS key FROM ({LINES})", "books_v"))
def c1(s, d):
    return _book_lines(s, d).select("book", "page_no", "line_no", fx.line_key(F.col("line")).alias("key"))


@query("c2_is_page_number", oracle(f"SELECT book, page_no, line_no, {PAGE_NUMBER_SQL} AS is_number FROM ({LINES})", "books_v"))
def c2(s, d):
    return _book_lines(s, d).select("book", "page_no", "line_no", fx.is_page_number(F.col("line")).alias("is_number"))


@query("c3_find_furniture", oracle(FURNITURE, "books_v"))
def c3(s, d):
    return pages.find_furniture(_book_lines(s, d), threshold=0.1)


@query("c4_drop_furniture", oracle(DROPPED, "books_v"))
def c4(s, d):
    lines = written(_book_lines(s, d), "lines")  # read several times
    return pages.drop_furniture(lines, pages.find_furniture(lines, threshold=0.1))


MEDIAN = f"SELECT book, CAST(list_sort(list(w))[1 + CAST(floor(count(*) * 0.5) AS INT)] AS INT) AS stat FROM (SELECT book, length({trim_sql('line')}) AS w FROM (%s)) WHERE w > 0 GROUP BY book"


@query("c5_median_width", oracle(MEDIAN % LINES, "books_v"))
def c5(s, d):
    return pages.median_width(_book_lines(s, d))


def reflow_sql(lines: str) -> str:
    return f"""WITH l AS MATERIALIZED ({lines}), b AS (SELECT l.book, page_no, line_no, {trim_sql('line')} AS t, stat FROM l JOIN ({MEDIAN % 'SELECT * FROM l'}) m ON l.book = m.book),
  f AS (SELECT *, CASE WHEN t = '' OR (regexp_matches(t, '[.!?]["''”’)\\]]?$') AND length(t) < stat * 0.6) THEN 1 ELSE 0 END AS c FROM b),
  p AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY book ORDER BY page_no, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS para FROM f),
  n AS (SELECT *, lead(t) OVER (PARTITION BY book, para ORDER BY page_no, line_no) AS nx FROM p WHERE t <> ''),
  j AS (SELECT book, para, string_agg(CASE WHEN nx IS NULL THEN t WHEN ends_with(t, '-') AND regexp_matches(nx, '^[a-z]') THEN left(t, length(t) - 1) WHEN ends_with(t, '-') THEN t ELSE t || ' ' END, '' ORDER BY page_no, line_no) AS x FROM n GROUP BY book, para)
  SELECT book, row_number() OVER (PARTITION BY book ORDER BY para) - 1 AS paragraph_no, {collapse_sql('x')} AS paragraph FROM j WHERE {collapse_sql('x')} <> ''"""


@query("c6_reflow", oracle(reflow_sql(LINES), "books_v"))
def c6(s, d):
    return pages.reflow(written(_book_lines(s, d), "lines"))


@query("c7_clean_pages", oracle(reflow_sql(DROPPED), "books_v"))
def c7(s, d):
    return pages.clean_pages(view(s, d, "books_v"), threshold=0.1)


# ---------------------------------------------------------------- sentences and chunks
PARAS = f"""SELECT doc_id, i - 1 AS paragraph_idx, ps[i] AS paragraph FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id,
  list_filter(list_transform(string_split_regex(text, {sq(f'\n[{WS}]*\n')}), lambda p: {trim_sql('p')}), lambda p: p <> '') AS ps FROM paragraphs_v))"""
_END = "[.!?]+[\"''”’)\\]]*"
_ABBREVIATED = f"""(contains(word, '.') OR regexp_matches(word, '^[A-Z]$') OR lower(word) IN ({', '.join(f"'{a}'" for a in dict.fromkeys(fx.ABBREVIATIONS))}))"""
SENTENCES = f"""SELECT doc_id, paragraph_idx, row_number() OVER (PARTITION BY doc_id, paragraph_idx ORDER BY g) - 1 AS n, s AS sentence FROM (
  SELECT doc_id, paragraph_idx, g, {trim_sql("string_agg(piece || term, '' ORDER BY k)")} AS s FROM (
  SELECT *, coalesce(sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, paragraph_idx ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM (
  SELECT *, term <> '' AND regexp_matches(following, {sq(f"^[{WS}]+[\"'“‘(\\[A-Z0-9]")}) AND NOT (regexp_matches(term, '^[.][^.!?]*$') AND {_ABBREVIATED}) AS cut FROM (
  SELECT *, regexp_extract(coalesce(string_agg(piece || term, '') OVER (PARTITION BY doc_id, paragraph_idx ORDER BY k ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), '') || piece, '([A-Za-z][A-Za-z.]*)$', 1) AS word,
    coalesce(lead(piece || term) OVER (PARTITION BY doc_id, paragraph_idx ORDER BY k), '') AS following FROM (
  SELECT doc_id, paragraph_idx, k, pieces[k] AS piece, coalesce(terms[k], '') AS term FROM (SELECT *, unnest(range(1, len(pieces) + 1)) AS k FROM (
  SELECT doc_id, paragraph_idx, string_split_regex(paragraph, '{_END}') AS pieces, regexp_extract_all(paragraph, '{_END}') AS terms FROM ({PARAS})))))))
  GROUP BY doc_id, paragraph_idx, g) WHERE s <> ''"""


@query("k1_split_paragraphs", oracle(PARAS, "paragraphs_v"))
def k1(s, d):
    return chunks.split_paragraphs(view(s, d, "paragraphs_v"))


@query("k2_split_sentences", oracle(SENTENCES, "paragraphs_v"))
def k2(s, d):
    each = chunks.split_paragraphs(view(s, d, "paragraphs_v"))
    return each.select("doc_id", "paragraph_idx", F.posexplode(fx.split_sentences(F.col("paragraph"))).alias("n", "sentence"))


@query("k3_ends_with_abbreviation", f"""WITH t AS (SELECT DISTINCT rtrim(unnest(string_split(replace(text, chr(10), ' '), ' ')), '.') AS token FROM documents),
  w AS (SELECT token, regexp_extract(token, '([A-Za-z][A-Za-z.]*)$', 1) AS word FROM t) SELECT token, {_ABBREVIATED} AS abbreviated FROM w""")
def k3(s, d):
    tokens = table(s, d, "documents").select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("t"))
    return tokens.select(F.rtrim("t", F.lit(".")).alias("token")).distinct().select("token", fx.ends_with_abbreviation(F.col("token")).alias("abbreviated"))


#: Tokens of sentences over %(n)d characters are clauses, else words, else pieces, which stay alone.
TOKENS = f"""WITH RECURSIVE s AS MATERIALIZED ({SENTENCES}),
  m AS (SELECT *, length(sentence) > %(n)d AS long, coalesce(lag(length(sentence)) OVER (PARTITION BY doc_id, paragraph_idx ORDER BY n) > %(n)d, false) AS after_long FROM s),
  f AS (SELECT doc_id, paragraph_idx, n, i, fs[i] AS fragment FROM (SELECT *, unnest(range(1, len(fs) + 1)) AS i FROM (
    SELECT *, string_split({sub('sentence', f'([,;:])[{WS}]+', chr(92) + '1' + chr(1))}, chr(1)) AS fs FROM m WHERE long))),
  w AS (SELECT *, unnest(range(1, len(ws) + 1)) AS k FROM (SELECT *, string_split_regex(fragment, {sq(f'[{WS}]+')}) AS ws FROM f WHERE length(fragment) > %(n)d)),
  p AS (SELECT *, substring(ws[k], CAST(place AS INT), %(n)d) AS piece FROM (SELECT *, unnest(range(1, length(ws[k]) + 1, %(n)d)) AS place FROM w WHERE length(ws[k]) > %(n)d)),
  t AS (SELECT doc_id, paragraph_idx, row_number() OVER o - 1 AS n, text, fresh OR coalesce(lag(solo) OVER o, false) AS fresh FROM (
    SELECT doc_id, paragraph_idx, n, 0 AS i, 0 AS k, 0 AS place, sentence AS text, after_long AS fresh, false AS solo FROM m WHERE NOT long
    UNION ALL SELECT doc_id, paragraph_idx, n, i, 0, 0, fragment, i = 1, false FROM f WHERE length(fragment) <= %(n)d
    UNION ALL SELECT doc_id, paragraph_idx, n, i, k, 0, ws[k], k = 1, false FROM w WHERE length(ws[k]) <= %(n)d
    UNION ALL SELECT doc_id, paragraph_idx, n, i, k, place, piece, true, true FROM p) WINDOW o AS (PARTITION BY doc_id, paragraph_idx ORDER BY n, i, k, place))"""
PLAIN = f"""WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, paragraph_idx, n, sentence AS text, false AS fresh FROM ({SENTENCES}))"""
PACKED = """, r AS (SELECT doc_id, paragraph_idx, n, CAST(0 AS BIGINT) AS part, length(text) AS size, text AS now FROM t WHERE n = 0 UNION ALL
  SELECT t.doc_id, t.paragraph_idx, t.n, CASE WHEN fresh OR r.size + 1 + length(t.text) > %(n)d THEN r.part + 1 ELSE r.part END,
  CASE WHEN fresh OR r.size + 1 + length(t.text) > %(n)d THEN length(t.text) ELSE r.size + 1 + length(t.text) END, t.text
  FROM r JOIN t ON t.doc_id = r.doc_id AND t.paragraph_idx = r.paragraph_idx AND t.n = r.n + 1),
  c AS (SELECT doc_id, paragraph_idx, part, string_agg(now, ' ' ORDER BY n) AS text FROM r GROUP BY doc_id, paragraph_idx, part),
  chunked AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_idx, part) - 1 AS idx, text, length(text) AS char_count, paragraph_idx,
  lead(part) OVER (PARTITION BY doc_id, paragraph_idx ORDER BY part) IS NULL AS ends_paragraph FROM c)"""


def packed_sql(tokens: str, n: int, rest: str) -> str:
    # the text is filled in before the views are put in front, which hold no placeholders
    sql = tokens.replace("%(n)d", str(n)) + PACKED.replace("%(n)d", str(n)) + rest
    return oracle("WITH " + sql.removeprefix("WITH RECURSIVE "), "paragraphs_v").replace("WITH ", "WITH RECURSIVE ", 1)


#: As PACKED, by a fold over a paragraph's tokens: a walk by joins takes as many steps as the longest one has tokens.
FOLDED = """, l AS (SELECT doc_id, paragraph_idx, list({'text': text, 'size': length(text), 'fresh': fresh} ORDER BY n) AS ts FROM t GROUP BY doc_id, paragraph_idx),
  r AS (SELECT doc_id, paragraph_idx, list_reduce(ts, lambda a, x: {'text': a.text || CASE WHEN x.fresh OR a.size + 1 + x.size > %(n)d THEN chr(1) ELSE ' ' END || x.text,
    'size': CASE WHEN x.fresh OR a.size + 1 + x.size > %(n)d THEN x.size ELSE a.size + 1 + x.size END, 'fresh': x.fresh}) AS x FROM l),
  c AS (SELECT doc_id, paragraph_idx, unnest(string_split(x.text, chr(1))) AS text, generate_subscripts(string_split(x.text, chr(1)), 1) AS part FROM r),
  chunked AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_idx, part) - 1 AS idx, text, length(text) AS char_count, paragraph_idx,
  lead(part) OVER (PARTITION BY doc_id, paragraph_idx ORDER BY part) IS NULL AS ends_paragraph FROM c)"""


def folded_sql(n: int, rest: str, *views: str, source: str = "paragraphs_v", head: str = "") -> str:
    """Chunks of ``source``, a view or what ``head`` defines in front."""
    sql = TOKENS.replace("WITH RECURSIVE ", f"WITH {head}").replace("paragraphs_v", source) + FOLDED
    return oracle(sql.replace("%(n)d", str(n)) + rest, *views)


@query("k4_split_oversized", folded_sql(40, " SELECT * FROM chunked", "paragraphs_v"))
def k4(s, d):
    return chunks.chunk_text(view(s, d, "paragraphs_v"), 40)


@query("k5_pack_sentences", packed_sql(PLAIN, 600, " SELECT doc_id, paragraph_idx, part, text FROM c"))
def k5(s, d):
    each = chunks.split_paragraphs(view(s, d, "paragraphs_v"))
    plain = F.transform(fx.split_sentences(F.col("paragraph")), lambda t: F.struct(t.alias("text"), F.lit(False).alias("fresh"), F.lit(False).alias("solo")))
    return each.select("doc_id", "paragraph_idx", F.posexplode(chunks.pack(plain, 600)).alias("part", "text"))


@query("k6_number_chunks", packed_sql(TOKENS, 1000, " SELECT doc_id, idx, char_count, paragraph_idx, ends_paragraph FROM chunked"))
def k6(s, d):
    return chunks.chunk_text(view(s, d, "paragraphs_v"), 1000).drop("text")


@query("k7_chunk_text", packed_sql(TOKENS, 2000, " SELECT * FROM chunked"))
def k7(s, d):
    return chunks.chunk_text(view(s, d, "paragraphs_v"))


# ---------------------------------------------------------------- rewrite rules
ESCAPED = sub("pattern", "([.*+?^${}()|\\[\\]\\\\])", "\\\\\\1")


@query("r1_rule_regex", oracle(f"""SELECT user_id, pattern, CASE WHEN regexp_matches(pattern, '^[A-Za-z0-9_][A-Za-z0-9_.]*[A-Za-z0-9_]$|^[A-Za-z0-9_]$')
  THEN '(?<![A-Za-z0-9_])' || {ESCAPED} || '(?![A-Za-z0-9_])' ELSE {ESCAPED} END AS regex FROM (SELECT user_id, pattern FROM rules_v UNION ALL SELECT 9, left(text, 12) FROM documents)""", "rules_v"))
def r1(s, d):
    more = table(s, d, "documents").select(F.lit(9).cast("long").alias("user_id"), F.substring("text", 1, 12).alias("pattern"))
    return view(s, d, "rules_v").select("user_id", "pattern").unionByName(more).select("user_id", "pattern", fx.rule_regex(F.col("pattern")).alias("regex"))


_RULED = """CASE user_id WHEN 0 THEN regexp_replace(regexp_replace(text, '\\bthe\\b', 'THE', 'g'), '\\bof\\b', 'OF', 'g')
  WHEN 1 THEN regexp_replace(regexp_replace(text, '\\bque\\b', 'k', 'g'), '\\bde\\b', 'D', 'g')
  WHEN 2 THEN regexp_replace(regexp_replace(text, '\\bder\\b', 'D.E.R', 'g'), '\\bund\\b', '$1 & und', 'g')
  ELSE regexp_replace(replace(text, ' la ', 'LA'), '\\blos\\b', '', 'g') END"""


@query("r2_apply_rules", oracle(f"SELECT doc_id, user_id, {_RULED} AS text FROM docs_v", "docs_v"))
def r2(s, d):
    return rules.apply_rules(view(s, d, "docs_v"), view(s, d, "rules_v")).select("doc_id", "user_id", "text")


@query("r3_upsert_rules", oracle("SELECT user_id, pattern, replacement, created_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id, pattern ORDER BY created_at DESC, replacement DESC) AS r FROM told_rules_v) WHERE r = 1", "told_rules_v"))
def r3(s, d):
    return rules.upsert_rules(view(s, d, "told_rules_v"))


CANDIDATES = "SELECT doc_id AS user_id, left(text, CAST(doc_id % 140 AS INT)) AS pattern, right(text, CAST(doc_id % 290 AS INT)) AS replacement FROM documents"


@query("r4_validate_rules", f"""SELECT user_id, {trim_sql('pattern')} AS pattern, replacement, CASE WHEN {trim_sql('pattern')} = '' THEN 'pattern is empty' WHEN length({trim_sql('pattern')}) > 100 THEN 'pattern is over 100 characters'
  WHEN length(replacement) > 200 THEN 'replacement is over 200 characters' END AS reason FROM ({CANDIDATES})""")
def r4(s, d):
    cut = table(s, d, "documents").select(
        F.col("doc_id").alias("user_id"), F.expr("left(text, CAST(doc_id % 140 AS INT))").alias("pattern"), F.expr("right(text, CAST(doc_id % 290 AS INT))").alias("replacement")
    )
    return rules.validate_rules(cut)


@query("r5_list_rules", oracle("SELECT user_id, pattern, replacement, created_at FROM told_rules_v", "told_rules_v"))
def r5(s, d):
    return rules.list_rules(view(s, d, "told_rules_v"))


# ---------------------------------------------------------------- titles, formats, feeds
TITLE = """CASE WHEN length(f) <= 60 THEN f ELSE trim(CASE WHEN length(regexp_extract(left(f, 60), '(?s)^(.*) [^ ]*$', 1)) > 20 THEN regexp_extract(left(f, 60), '(?s)^(.*) [^ ]*$', 1) ELSE left(f, 60) END) || '…' END"""


@query("l4_chapter_title", f"SELECT doc_id, {TITLE} AS title FROM (SELECT doc_id, {collapse_sql('text')} AS f FROM documents)")
def l4(s, d):
    return table(s, d, "documents").select("doc_id", fx.chapter_title(F.col("text")).alias("title"))


# three lines make a paragraph, and each line is spoken at 60 ms a character
@query("l4_titled_chapters", f"""WITH lines AS (SELECT doc_id AS document_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS idx, unnest(string_split(text, chr(10))) AS text FROM documents),
  timed AS (SELECT *, CAST(coalesce(sum(length(text) * 60 + CASE WHEN idx % 3 = 2 THEN 750 ELSE 350 END) OVER (PARTITION BY document_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM lines)
  SELECT document_id, idx // 3 AS chapter_no, idx, idx // 3 AS paragraph_idx, start_ms, {TITLE} AS title FROM (SELECT *, {collapse_sql('text')} AS f FROM timed WHERE idx % 3 = 0)""")
def l4_chapters(s, d):
    lines = table(s, d, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    spoken = lines.withColumns({"paragraph_idx": F.expr("idx div 3").cast("int"), "duration_ms": F.length("text") * 60, "ends_paragraph": F.col("idx") % 3 == 2})
    return timeline.titled(timeline.chapters(timeline.timeline(spoken)), lines)


@query("l14_formats", oracle("""SELECT document_id, idx, (duration_ms // 1000) // 60 || ':' || lpad(CAST((duration_ms // 1000) % 60 AS VARCHAR), 2, '0') AS length,
  CASE WHEN char_count >= 1000 THEN ((char_count + 50) // 100) // 10 || '.' || ((char_count + 50) // 100) % 10 || 'k chars' ELSE char_count || ' chars' END AS size FROM chunks_v""", "chunks_v"))
def l14(s, d):
    return view(s, d, "chunks_v").select("document_id", "idx", fx.format_time(F.col("duration_ms") / 1000).alias("length"), fx.format_chars(F.col("char_count")).alias("size"))


XML = "replace(replace(replace(replace(replace(%s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
ITEMS = """SELECT a.user_id, a.document_id, a.created_at, 'https://x/?p=' || a.path || '&t=1' AS url, coalesce(t.title, 'Untitled') AS title, CAST(floor(a.duration_ms / 1000 + 0.5) AS BIGINT) AS seconds,
  a.byte_size AS length, 'docflow-' || a.document_id AS guid FROM assets_v a LEFT JOIN titles_v t ON a.user_id = t.user_id AND a.document_id = t.document_id WHERE a.id % 13 <> 0"""


def _items(s: SparkSession, d: str) -> DataFrame:
    assets = view(s, d, "assets_v")
    links = assets.where("id % 13 <> 0").select("path", F.concat(F.lit("https://x/?p="), "path", F.lit("&t=1")).alias("url"))
    return feeds.feed_items(assets, view(s, d, "titles_v"), links)


@query("f1_feed_items", oracle(ITEMS, "assets_v", "titles_v"))
def f1(s, d):
    return _items(s, d)


@query("f2_escape_xml", f"SELECT doc_id, {XML % 'text'} AS xml FROM documents")
def f2(s, d):
    return table(s, d, "documents").select("doc_id", fx.escape_xml(F.col("text")).alias("xml"))


@query("f3_http_date", "SELECT o_orderkey, strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S GMT') AS date FROM orders")
def f3(s, d):
    return table(s, d, "orders").select("o_orderkey", fx.http_date(F.col("o_orderdate")).alias("date"))


RENDERED = f"""'<item><title>' || {XML % 'title'} || '</title><guid isPermaLink="false">' || guid || '</guid><pubDate>' || strftime(created_at, '%a, %d %b %Y %H:%M:%S GMT') || '</pubDate><enclosure url="' || {XML % 'url'} || '" length="' || length
  || '" type="audio/mpeg"/><itunes:duration>' || seconds || '</itunes:duration></item>'"""


@query("f4_render_feeds", oracle(f"""WITH i AS ({ITEMS}), b AS (SELECT user_id, string_agg({RENDERED}, chr(10) ORDER BY created_at DESC, document_id, {RENDERED}) AS x FROM i GROUP BY user_id)
  SELECT c_custkey AS user_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<rss version="2.0" xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd"><channel><title>Library</title>' || chr(10)
  || coalesce(x, '') || chr(10) || '</channel></rss>' AS xml FROM customer LEFT JOIN b ON c_custkey = b.user_id""", "assets_v", "titles_v"))
def f4(s, d):
    return feeds.render_feeds(table(s, d, "customer").select(F.col("c_custkey").alias("user_id")), _items(s, d))


@query("f5_resolve_tokens", "SELECT event_id, 't' || (user_id * 7) AS token, user_id * 7 // 3 AS user_id FROM events JOIN customer ON user_id * 7 = c_custkey * 3")
def f5(s, d):
    tokens = table(s, d, "customer").select(F.concat(F.lit("t"), (F.col("c_custkey") * 3).cast("string")).alias("token"), F.col("c_custkey").alias("user_id"))
    requests = table(s, d, "events").select("event_id", F.concat(F.lit("t"), (F.col("user_id") * 7).cast("string")).alias("token"))
    return feeds.resolve_tokens(requests, tokens)


# ---------------------------------------------------------------- flagship
#: When the flagship asks for what users have spent.
PLAN_NOW = "2024-01-30 18:00:00"
_RULED_DOCS = f"""ruled_v AS (SELECT doc_id, user_id, {_RULED} AS text FROM (SELECT doc_id, user_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM docs_v)), """
_PLANNED = f""", h AS (SELECT d.doc_id AS document_id, user_id, char_count, sha256('voice-a:model-a:' || c.text) AS content_hash FROM docs_v d LEFT JOIN chunked c ON d.doc_id = c.doc_id),
  su AS (SELECT document_id, user_id, count(content_hash) AS chunks, count(*) FILTER (WHERE content_hash < '5') AS cached_count,
    CAST(coalesce(sum(char_count) FILTER (WHERE content_hash >= '5'), 0) AS BIGINT) AS billable_chars, CAST(coalesce(sum(char_count), 0) AS BIGINT) AS total_chars FROM h GROUP BY ALL),
  u AS (SELECT user_id, CAST(sum(chars) AS BIGINT) AS used FROM usage_v WHERE ts BETWEEN TIMESTAMP '{PLAN_NOW}' - INTERVAL 24 HOUR AND TIMESTAMP '{PLAN_NOW}' GROUP BY user_id),
  j AS (SELECT su.*, coalesce(used, 0) AS used, billable_chars AS want, coalesce(used, 0) + billable_chars <= 10000 AS ok, greatest(0, 10000 - coalesce(used, 0)) AS remaining FROM su LEFT JOIN u USING (user_id))
  SELECT *, CASE WHEN chunks = 0 THEN 'no words' WHEN NOT ok THEN 'over quota' END AS problem FROM j"""


@query("k7_plan_from_text", folded_sql(2000, _PLANNED, "docs_v", "usage_v", source="ruled_v", head=_RULED_DOCS))
def plan_from_text(s, d):
    """Documents to rules, chunks, hashes, cache probe, and what each document would cost its user.

    Hashes that start below 5 stand for what users have narrated before.
    """
    docs = view(s, d, "docs_v").select(F.col("doc_id").alias("document_id"), "user_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    made = planning.plan_chunks(docs, view(s, d, "rules_v"), "voice-a", "model-a")
    cache = made.where("content_hash < '5'").select("user_id", "content_hash", F.col("content_hash").alias("path"))
    used = usage.chars_used(view(s, d, "usage_v"), F.expr(f"TIMESTAMP_NTZ '{PLAN_NOW}'"))
    return planning.submit_plan(made, cache, used)
