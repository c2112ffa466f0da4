"""Books that come as packages of members: a container names the package file, that the members in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.text import html_to_text, trim
from docflow.operators.extract import MARKUP_TYPES, spine_order
from docflow.sources.shared import written

CONTAINER = "META-INF/container.xml"
_CONTAINER_ROWS = "rootfiles struct<rootfile: array<struct<`_full-path`: string>>>"
_PACKAGE_ROWS = "manifest struct<item: array<struct<_id: string, _href: string, `_media-type`: string>>>, spine struct<itemref: array<struct<_idref: string>>>"


def _xml(text: Column, schema: str) -> Column:
    """Elements as fields whatever their prefix; null fields where the XML is broken."""
    return F.from_xml(trim(text), schema, {"ignoreNamespace": "true", "attributePrefix": "_", "mode": "PERMISSIVE"})


def percent_decoded(href: Column) -> Column:
    """A reference without its query and fragment, its bytes decoded; one that can't be decoded stays."""
    plain = F.split(href, "[?#]")[0]
    return F.coalesce(F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))), plain)


def resolved(folder: Column, href: Column) -> Column:
    """The member that ``href`` means in ``folder``: dots folded, one kind of slash, none in front.

    What climbs above the top keeps its dots, so no member has its name.
    """

    def step(path: Column, part: Column) -> Column:
        above = (F.size(path) == 1) | (F.element_at(path, -1) == "..")
        up = F.when(above, F.concat(path, F.array(part))).otherwise(F.slice(path, 1, F.size(path) - 1))
        return F.when(part.isin("", "."), path).when(part == "..", up).otherwise(F.concat(path, F.array(part)))

    parts = F.split(F.replace(F.concat_ws("/", folder, href), F.lit("\\"), F.lit("/")), "/")
    # the fold starts from one segment of no meaning, so that there is a last one at each step
    return F.array_join(F.slice(F.aggregate(parts, F.array(F.lit(" ")), lambda p, x: step(p, x)), 2, 1_000_000), "/")


def package_files(members: DataFrame) -> DataFrame:
    """book_id, folder, package: the package file that the container names first, parsed."""
    names = members.where(F.col("path") == CONTAINER).select("book_id", F.col("content").alias("_xml"))
    listed = F.filter(_xml(F.col("_xml"), _CONTAINER_ROWS)["rootfiles"]["rootfile"]["_full-path"], lambda p: trim(p) != "")
    named = names.groupBy("book_id").agg(F.max(resolved(F.lit(""), F.get(listed, 0))).alias("path")).where("path IS NOT NULL")
    found = members.select("book_id", "path", "content").join(named.hint("merge"), ["book_id", "path"])
    folder = F.regexp_replace("path", "/?[^/]*\\z", "")
    return found.select("book_id", folder.alias("folder"), _xml(F.col("content"), _PACKAGE_ROWS).alias("package"))


def manifest_rows(packages: DataFrame, members: DataFrame) -> DataFrame:
    """book_id, id, href, media_type: the items whose member is there.

    Of items with one id the last counts. An href stands for the member of just that name, else for
    the one of its decoded name.
    """
    items = packages.select("book_id", "folder", F.posexplode("package.manifest.item").alias("pos", "item")).where("item._id IS NOT NULL")
    last = items.groupBy("book_id", F.col("item._id").alias("id")).agg(F.max_by(F.struct("folder", "item"), "pos").alias("x"))
    href = F.when(trim(F.col("x.item._href")) != "", F.col("x.item._href"))
    names = F.array_distinct(F.transform(F.array(href, percent_decoded(href)), lambda h: resolved(F.col("x.folder"), h)))
    tried = last.where(href.isNotNull()).select("book_id", "id", F.nullif(trim(F.col("x.item").getField("_media-type")), F.lit("")).alias("media_type"), F.posexplode(names).alias("_try", "path"))
    there = members.select("book_id", "path").distinct()
    met = tried.join(there.hint("merge"), ["book_id", "path"])
    return met.groupBy("book_id", "id", "media_type").agg(F.min_by("path", "_try").alias("href")).select("book_id", "id", "href", "media_type")


def spine_rows(packages: DataFrame) -> DataFrame:
    """book_id, pos, idref: the reading order; references without an id go."""
    refs = packages.select("book_id", F.posexplode("package.spine.itemref._idref").alias("pos", "idref"))
    return refs.where("idref IS NOT NULL")


def read_books(members: DataFrame) -> DataFrame:
    """book_id, text, chapters of ``members`` (book_id, path, content): the prose in reading order.

    A book gives no row if its container or package file is missing, null or broken, or if no member
    in its spine has text. Members with a null book_id belong to no book, further columns are ignored;
    a member that the spine names twice is read twice. Of members with one path the largest counts.
    """
    known = members.where("book_id IS NOT NULL AND path IS NOT NULL").groupBy("book_id", "path").agg(F.max("content").alias("content"))
    packages = written(package_files(known), "packages")
    items = written(manifest_rows(packages, known), "manifests")
    # only members that a manifest names as markup are read; filters on the prose would make it once more
    markup = items.where(F.col("media_type").isNull() | F.col("media_type").rlike(MARKUP_TYPES)).select("book_id", F.col("href").alias("path")).distinct()
    read = known.join(markup.hint("merge"), ["book_id", "path"], "left_semi")
    texts = written(read.select("book_id", "path", html_to_text(F.col("content")).alias("content")), "prose")
    return spine_order(spine_rows(packages), items, texts)
