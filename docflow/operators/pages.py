"""Page cleaning: furniture that repeats across pages, page numbers, reflow of wrapped lines.

Defined cases, for all of it: a null book is a book, a null page number a page of it before the
others; a null text has one empty line; repeated rows are lines each; lines of one number stand in
any order; an empty table gives no rows; texts and lines are read whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from docflow.functions.text import collapse, is_page_number, line_key, rtrim, trim
from docflow.sources.shared import written


#: Rows of a table (a row a book, or a book's few furniture keys) up to which it is broadcast.
BROADCAST_ROWS = 100_000


def _told(left: DataFrame, facts: DataFrame, on: list[str], how: str, label: str) -> DataFrame:
    """``left`` joined with ``facts`` on columns of one name, in which null equals null.

    Facts are short rows, few a book, and a book has very many lines: dealt out by book its lines
    would all be in one task. So facts are written, counted and broadcast; only more than
    ``BROADCAST_ROWS``, of very many books, are joined by sort.
    """
    known = written(facts, label).select(*[F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in facts.columns])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on])
    sent = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known.hint("merge")
    return left.join(sent, same, how).drop(*[f"_{c}" for c in on])


def page_lines(pages: DataFrame, book: str = "book", page: str = "page_no", text: str = "text") -> DataFrame:
    """book, page_no, line_no from 0, line without white space at its end."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\\r?\\n"), rtrim)
    return pages.select(F.col(book).alias("book"), F.col(page).alias("page_no"), F.posexplode(lines).alias("line_no", "line"))


def _placed(lines: DataFrame, edge: int) -> DataFrame:
    """``lines`` with near_edge: whether a line with a word stands near an edge of its page.

    The position of a line that occurs again on the page is that of its first occurrence. One
    exchange by page serves all windows; a page is what one task holds, not a book.
    """
    worded = F.coalesce(trim(F.col("line")) != "", F.lit(False))
    page = Window.partitionBy("book", "page_no")
    upto = page.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    ranked = lines.withColumn("pos", F.when(worded, F.count_if(worded).over(upto) - 1)).withColumn("n", F.count_if(worded).over(page))
    first = ranked.withColumn("pos", F.min("pos").over(Window.partitionBy("book", "page_no", "line")))
    near = (F.col("pos") < edge) | (F.col("pos") >= F.col("n") - edge)
    return first.withColumn("near_edge", F.coalesce(near, F.lit(False))).drop("pos", "n")


def find_furniture(lines: DataFrame, edge: int = 3, threshold: float = 0.5, min_pages: int = 3) -> DataFrame:
    """book, key: line keys at the edges of at least ``threshold`` of a book's pages."""
    page = Window.partitionBy("book", "page_no")
    kept = lines.where(trim(F.col("line")) != "")
    ranked = kept.withColumn("top", F.row_number().over(page.orderBy("line_no"))).withColumn("n", F.count(F.lit(1)).over(page))
    edges = ranked.where((F.col("top") <= edge) | (F.col("top") > F.col("n") - edge))
    keys = edges.select("book", "page_no", line_key(F.col("line")).alias("key")).where("key <> ''").distinct()
    pages = lines.select("book", "page_no").distinct().groupBy("book").agg(F.count(F.lit(1)).alias("pages"))
    found = _told(keys.groupBy("book", "key").agg(F.count(F.lit(1)).alias("n")), pages, ["book"], "inner", "pages-of-books")
    return found.where((F.col("pages") >= min_pages) & (F.col("n") >= F.ceil(F.col("pages") * threshold))).select("book", "key", "n", "pages")


def drop_furniture(lines: DataFrame, furniture: DataFrame, edge: int = 3) -> DataFrame:
    """Lines without page numbers, and without furniture near an edge; blank lines stay."""
    known = furniture.select("book", "key").distinct().withColumn("is_known", F.lit(True))
    # keys count near an edge only; elsewhere they are null, and what a null key meets is not asked
    marked = _told(_placed(lines, edge).withColumn("key", F.when(F.col("near_edge"), line_key(F.col("line")))), known, ["book", "key"], "left", "furniture")
    blank = trim(F.col("line")) == ""
    gone = is_page_number(F.col("line")) | (F.col("near_edge") & F.coalesce("is_known", F.lit(False)))
    return marked.where(blank | ~gone).select("book", "page_no", "line_no", "line")


def order_statistic(df: DataFrame, key: str, value: str, quantile: float) -> DataFrame:
    """key, stat: the value at 0-based place floor(quantile * n) of the sorted values, exactly.

    Values are counted before they are sorted, so a key with many rows brings its distinct values
    only into one task; nulls come first, as in a sort.
    """
    counted = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy(key)
    upto = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("upto", F.sum("c").over(upto)).withColumn("place", F.floor(F.sum("c").over(whole) * quantile))
    return ranked.where((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("c") <= F.col("place"))).select(key, F.col(value).alias("stat"))


def median_width(lines: DataFrame) -> DataFrame:
    """book, stat: upper median of the widths of lines with a word."""
    widths = lines.select("book", F.length(trim(F.col("line"))).alias("width")).where("width > 0")
    return order_statistic(widths, "book", "width", 0.5)


def reflow(lines: DataFrame, short_ratio: float = 0.6) -> DataFrame:
    """book, paragraph_no, paragraph: wrapped lines joined, pages run on.

    A paragraph ends at a blank line, at the last line, and at a short line that ends a sentence.
    A hyphen at a line's end goes if the next line starts in lower case, else stays without a space.
    """
    bare = _told(lines.select("book", "page_no", "line_no", trim(F.col("line")).alias("t")), median_width(lines), ["book"], "inner", "medians")
    ends = (F.length("t") < F.col("stat") * short_ratio) & F.col("t").rlike("[.!?][\"'”’)\\]]?$")
    closing = bare.select("book", "page_no", "line_no", "t", ((F.col("t") == "") | ends).cast("int").alias("closes"))
    # a page is one key, in which nulls are equal, so windows and the join share one exchange
    paged = closing.withColumn("page", F.struct("book", "page_no"))
    order = Window.partitionBy("page").orderBy("line_no")
    said = F.when(F.col("t") != "", F.col("within"))
    last = F.last(said, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    # nth: which paragraph of its page a line with a word is in, from 0
    steps = paged.withColumn("within", _sum_before("closes", order)).withColumn("step", F.coalesce(said != last, F.lit(False)).cast("int"))
    placed = steps.withColumn("nth", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    firsts = _first_paragraphs(
        placed.groupBy("page").agg(F.sum("closes").alias("closes"), F.min(said).alias("first"), F.max(said).alias("last"), F.max("nth").alias("most"))
    )
    words = placed.where("t <> ''").join(firsts.hint("merge"), "page").select("book", (F.col("no") + F.col("nth")).alias("paragraph_no"), "page_no", "line_no", "t")

    def piece(x: Column, i: Column) -> Column:
        t, following = x["t"], F.get("ls", i + 1)["t"]
        hyphen = t.endswith("-") & following.isNotNull()
        cut = F.substring(t, F.lit(1), F.length(t) - 1)
        return F.when(hyphen & following.rlike("^[a-z]"), cut).when(hyphen | following.isNull(), t).otherwise(F.concat(t, F.lit(" ")))

    joined = words.groupBy("book", "paragraph_no").agg(F.array_sort(F.collect_list(F.struct("page_no", "line_no", "t"))).alias("ls"))
    return joined.select("book", "paragraph_no", collapse(F.array_join(F.transform("ls", piece), "")).alias("paragraph"))


def _first_paragraphs(pages: DataFrame) -> DataFrame:
    """page, no: the number in its book of the first paragraph with a word on each page with one.

    ``pages`` (page, closes, first, last, most) is a short row a page: how many lines on it close a
    paragraph, how many before its first and last line with a word (null if it has none), and how
    many paragraphs begin on it after the first. A page whose first words come without a close
    after the last ones before them goes on with their paragraph.
    """
    book = Window.partitionBy("page.book").orderBy("page.page_no")
    counted = pages.withColumn("earlier", _sum_before("closes", book))
    before = F.last(F.col("earlier") + F.col("last"), ignorenulls=True).over(book.rowsBetween(Window.unboundedPreceding, -1))
    goes_on = F.coalesce(F.col("earlier") + F.col("first") == before, F.lit(False)).cast("int")
    fresh = F.when(F.col("first").isNotNull(), F.col("most") + 1 - F.col("goes_on")).otherwise(F.lit(0))
    some = counted.withColumn("goes_on", goes_on).withColumn("fresh", fresh)
    return some.select("page", (_sum_before("fresh", book) - F.col("goes_on")).alias("no"))


def _sum_before(value: str, order: WindowSpec) -> Column:
    return F.coalesce(F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def clean_pages(pages: DataFrame, edge: int = 3, threshold: float = 0.5, min_pages: int = 3) -> DataFrame:
    """book, paragraph_no, paragraph of whole books: furniture and page numbers gone, reflowed.

    Lines are parsed once, and the kept ones are written once, as reflowing reads them several times.
    """
    lines = written(page_lines(pages), "lines")
    return reflow(written(drop_furniture(lines, find_furniture(lines, edge, threshold, min_pages), edge), "kept-lines"))
