"""Readers and writers of guides, page catalogues and index versions.

Bulk data goes through Spark's readers and writers only, so paths may be in any store. What lists or renames folders
(version discovery, the swap of an index) is done by the driver through the session's own file system API.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graticule.functions.html import page_of, paths_of
from graticule.functions.text import slugify
from graticule.operators.index import small
from graticule.sources.files import fs_of as _fs
from graticule.sources.files import read_text

#: A line of a page catalogue.
PAGE_RECORD = (
    "version string, doc_id string, doc_title string, page_id string, page_title string, heading_path array<string>, source_path string, "
    "anchor string, images array<struct<original:string,url:string,alt:string>>, markdown_path string"
)


def read_texts(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, text) of the files below a folder whose name fits the pattern."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", _lenient(F.col("content")).alias("text"))


def _lenient(content: Column) -> Column:
    # the decoder refuses malformed bytes, so it is asked only where they are well-formed
    return F.when(F.is_valid_utf8(content.cast("string")), F.regexp_replace(content.cast("string"), r"^\x{feff}", "")).otherwise(
        F.replace(F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"^\x{feff}", ""), F.lit("�"), F.lit(""))
    )


def _contents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_title, text) of the guides' contents pages. Spark's readers pass over names that begin with an underscore, so
    the driver reads these, one small file for each guide, through the file system API."""
    fs, root = _fs(spark, path)
    found = []
    for folder in fs.listStatus(root):
        page = _fs(spark, f"{folder.getPath().toString()}/__tableofcontents.html")[1]
        if folder.isDirectory() and fs.exists(page):
            found.append((folder.getPath().getName(), read_text(spark, page.toString()).lstrip("\ufeff")))
    return spark.createDataFrame(found, "doc_title string, text string")


def _below(spark: SparkSession, root: str, path: Column) -> Column:
    """A file's path below a folder, null for one that isn't there."""
    fs, place = _fs(spark, root)
    plain = lambda c: F.regexp_replace(c, "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
    inside = F.concat(plain(F.lit(fs.makeQualified(place).toString().rstrip("/"))), F.lit("/"))
    return F.when(plain(path).startswith(inside), F.substring(plain(path), F.length(inside) + 1, F.length(plain(path))))


def resolved(guide: Column, reference: Column) -> Column:
    """Where a reference in a guide's folder leads, as a path below the folder of all guides; null if that isn't in the guide.

    The path is a stack of names: `.` and empty names leave it as it is, `..` takes the last name off. Beyond the folder of all
    guides there is no way back.
    """
    step = lambda stack, name: (
        F.when(name.isin("", "."), stack)
        .when((name == "..") & (F.size(stack) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), stack), -1) != ".."), F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0))))
        .otherwise(F.concat(stack, F.array(name)))
    )
    stack = F.aggregate(F.split(reference, "/", -1), F.array(guide), step)
    inside = ~reference.startswith("/") & (F.size(stack) > 1) & (F.get(stack, F.lit(0)) == guide)
    return F.when(inside, F.array_join(stack, "/"))


def resolve_images(references: DataFrame, assets: DataFrame) -> DataFrame:
    """References (guide, original) with the file that each leads to (`asset`, null where the listing has none).

    assets: (asset), paths below the folder of all guides. Only names travel; a short listing is broadcast, a long one joined.
    """
    known = small(assets.select("asset").distinct())
    return references.withColumn("_to", resolved(F.col("guide"), F.col("original"))).join(known, F.col("_to") == F.col("asset"), "left").drop("_to")


def list_assets(spark: SparkSession, path: str) -> DataFrame:
    """(asset): every file below a folder of guides, by name alone. Spark passes over names that begin with a dot or `_`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(_below(spark, path, F.col("path")).alias("asset"))


def read_guides(spark: SparkSession, path: str, version: str = "") -> DataFrame:
    """Pages of HTML guides, one folder each, as records of a catalogue with `markdown` and `place`.

    The contents page, where there is one, names a guide's pages and their order; without it every page in the folder itself
    counts whose name doesn't begin with two underscores, by name. A page's title is its `#pagetitle`, else its name.
    Images that lead to a file in the guide get the address `/assets/<version>/<doc_id>/<reference>`, others keep theirs.
    """
    files = read_texts(spark, path, "*.html").select(_below(spark, path, F.col("path")).alias("_rel"), "text")
    files = files.select(F.substring_index("_rel", "/", 1).alias("doc_title"), F.regexp_extract("_rel", "^[^/]+/(.+)$", 1).alias("file"), "text").where("file <> ''")
    toc = _contents(spark, path).select("doc_title", paths_of("text", "doc_title").alias("paths"))
    listed = toc.select("doc_title", F.posexplode(F.map_entries("paths")).alias("place", "_e")).select("doc_title", "place", F.col("_e.key").alias("file"), F.col("_e.value").alias("heading_path"))
    pages = files.where(~F.col("file").startswith("__"))
    with_toc = pages.join(small(listed), ["doc_title", "file"])
    without = pages.where(~F.contains("file", F.lit("/"))).join(small(toc.where(F.size("paths") > 0).select("doc_title")), "doc_title", "left_anti")
    order = Window.partitionBy("doc_title").orderBy("file")
    named = without.select("doc_title", "file").withColumn("place", F.row_number().over(order) - 1)
    without = without.join(small(named), ["doc_title", "file"]).withColumn("heading_path", F.lit(None).cast("array<string>"))
    columns = ["doc_title", "file", "text", "place", "heading_path"]
    every = with_toc.select(*columns).unionByName(without.select(*columns))
    stem = F.regexp_replace("file", r"^.*/|\.html$", "")
    parsed = every.select("doc_title", "file", "place", "heading_path", slugify(F.col("doc_title")).alias("doc_id"), slugify(stem).alias("page_id"), page_of("text", stem).alias("page"))

    # only addresses go through the join; the page's text stays in its row
    references = parsed.select("doc_title", "doc_id", "file", F.posexplode("page.images").alias("n", "_i")).select(F.col("doc_title").alias("guide"), "doc_id", "file", "n", "_i.original", "_i.alt")
    found = resolve_images(references, list_assets(spark, path))
    url = F.when(F.col("asset").isNotNull(), F.concat_ws("/", F.lit("/assets"), F.lit(version), "doc_id", "original")).otherwise(F.col("original"))
    found = found.groupBy(F.col("guide").alias("doc_title"), "file").agg(F.array_sort(F.collect_list(F.struct("n", "original", url.alias("url"), "alt", F.col("asset").isNotNull().alias("held")))).alias("_images"))
    placed = parsed.join(found, ["doc_title", "file"], "left")
    shown = F.transform(F.coalesce("_images", F.array().cast(found.schema["_images"].dataType)), lambda i: F.concat(F.lit("!["), i["alt"], F.lit("]("), i["url"], F.lit(")")))
    markdown = F.array_join(F.zip_with("page.parts", shown, lambda part, image: F.concat(part, F.coalesce(image, F.lit("")))), "")
    kept = F.transform(F.filter("_images", lambda i: i["held"]), lambda i: F.struct(i["original"].alias("original"), i["url"].alias("url"), i["alt"].alias("alt")))
    return placed.select(
        F.lit(version).alias("version"),
        "doc_id",
        "doc_title",
        "page_id",
        F.col("page.title").alias("page_title"),
        F.coalesce("heading_path", F.array("doc_title", "page.title")).alias("heading_path"),
        F.concat_ws("/", "doc_title", "file").alias("source_path"),
        F.lit("pagetitle").alias("anchor"),
        F.coalesce(kept, F.array().cast("array<struct<original:string,url:string,alt:string>>")).alias("images"),
        F.concat(F.lit("pages/"), "doc_id", F.lit("/"), "page_id", F.lit(".md")).alias("markdown_path"),
        markdown.alias("markdown"),
        "place",
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text): the lines of text files with their numbers from 1.

    Numbers come in two levels: a line's place within its block of the file, and the lines of the blocks before. A block is
    read by one task, in order; what is exchanged is one row for each block.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.col("value").alias("text"))
    rows = rows.withColumn("_id", F.monotonically_increasing_id())
    blocks = rows.groupBy("file", "_at").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "_at", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(small(blocks), ["file", "_at"]).select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line"), "text")


def read_catalog(spark: SparkSession, path: str, strict: bool = True, numbers: bool = False) -> DataFrame:
    """Page records of a catalogue, one object a line; blank lines are passed over. Strict: a line that isn't a record is an
    error that names its file and line; else such lines are skipped, as are records without doc and page. With `numbers`, also
    `file` and `line` of each record."""
    lines = numbered_lines(spark, path).where(F.trim(F.regexp_replace("text", r"[\t\r\x{feff}]", " ")) != "")
    record = F.from_json("text", f"{PAGE_RECORD}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    read = lines.select("file", "line", "text", record.alias("r"))
    broken = F.col("r").isNull() | F.col("r._broken").isNotNull()
    columns = [c.split(" ", 1)[0] for c in PAGE_RECORD.split(", ")]
    shown = [*(["file", "line"] if numbers else []), *[f"r.{c}" for c in columns]]
    if strict:
        said = F.format_string("%s, line %d isn't a page record: %s", "file", "line", F.substring("text", 1, 200))
        return read.withColumn("r", F.when(broken, F.raise_error(said).cast(read.schema["r"].dataType)).otherwise(F.col("r"))).select(*shown)
    return read.where(~broken).select(*shown).where("doc_id is not null and page_id is not null")


def read_datastore(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue records of a datastore with the Markdown of their pages; lenient: lines that are no records are skipped, as
    are records without their text. The texts are what `write_datastore` wrote, or files `pages/<doc_id>/<page_id>.md`."""
    found = read_catalog(spark, f"{path}/pages.jsonl", strict=False).where((F.trim("doc_id") != "") & (F.trim("page_id") != ""))
    fs, table = _fs(spark, f"{path}/markdown/_SUCCESS")
    if fs.exists(table):
        texts = spark.read.parquet(f"{path}/markdown")
    else:
        files = read_texts(spark, f"{path}/pages", "*.md")
        texts = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+\.md$", 1).alias("doc_id"), F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("page_id"), F.col("text").alias("markdown"))
    title, page = F.coalesce("doc_title", "doc_id"), F.coalesce("page_title", "page_id")
    return found.join(texts, ["doc_id", "page_id"]).withColumns({"doc_title": title, "page_title": page})


def write_datastore(pages: DataFrame, path: str) -> None:
    """Page records (`pages.jsonl`, one object a line) and their Markdown (`markdown`, one table rather than a small file for each
    page), as `read_datastore` and `versions` find them."""
    record = [c.split(" ", 1)[0] for c in PAGE_RECORD.split(", ")]
    pages.select("doc_id", "page_id", "markdown").write.mode("overwrite").parquet(f"{path}/markdown")
    pages.select(*[c for c in record if c in pages.columns]).write.mode("overwrite").json(f"{path}/pages.jsonl")


def doc_titles(catalog: DataFrame, order: str) -> DataFrame:
    """(doc_id, doc_title): the first title of each doc in the catalogue's order."""
    first = Window.partitionBy("doc_id").orderBy(order)
    return catalog.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("doc_id", "doc_title")


def page_lookup(catalog: DataFrame, order: str) -> DataFrame:
    """The last record of each page in the catalogue's order."""
    last = Window.partitionBy("doc_id", "page_id").orderBy(F.col(order).desc())
    return catalog.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def custom_pages(rows: DataFrame) -> DataFrame:
    """Custom pages with their heading path decoded; `[doc_title, page_title]` where it is missing or malformed."""
    path = F.from_json("heading_path_json", "array<string>")
    return rows.withColumn("heading_path", F.when(F.size(F.coalesce(path, F.array().cast("array<string>"))) > 0, path).otherwise(F.array("doc_title", "page_title"))).drop("heading_path_json")


def published(edits: DataFrame, version: str) -> DataFrame:
    """Published edits of a version that aren't blank."""
    return edits.where((F.col("version") == version) & (F.col("status") == "published") & (F.trim(F.coalesce("content_md", F.lit(""))) != ""))


def versions(spark: SparkSession, root: str, default: str | None = None) -> list[str]:
    """Names of the folders below a root that hold a page catalogue, the default first."""
    fs, place = _fs(spark, root)
    names = sorted(s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory() and not s.getPath().getName().startswith("."))
    found = [n for n in names if fs.exists(_fs(spark, f"{root}/{n}/pages.jsonl")[1])]
    return ([default] if default in found else []) + [n for n in found if n != default]


def swap(spark: SparkSession, build: str, live: str, keep: int = 8, carry: tuple[str, ...] = ("assets/user",)) -> None:
    """Put a built index in the live one's place: carry over what users added, keep the live one as a backup, and keep the
    newest backups only."""
    fs, new = _fs(spark, build)
    _, old = _fs(spark, live)
    path = lambda p: _fs(spark, p)[1]
    if fs.exists(old):
        for part in carry:
            if fs.exists(path(f"{live}/{part}")) and not fs.exists(path(f"{build}/{part}")):
                fs.mkdirs(path(f"{build}/{part}").getParent())
                jvm = spark.sparkContext._jvm
                jvm.org.apache.hadoop.fs.FileUtil.copy(fs, path(f"{live}/{part}"), fs, path(f"{build}/{part}"), False, spark.sparkContext._jsc.hadoopConfiguration())
        fs.rename(old, path(f"{live}.bak_{time.strftime('%Y%m%d_%H%M%S')}_{time.time_ns() % 10**9:09d}"))
    if not fs.rename(new, old):
        raise OSError(f"{build} could not be moved to {live}")
    name = old.getName()
    backups = sorted((s.getPath() for s in fs.listStatus(old.getParent()) if s.getPath().getName().startswith(f"{name}.bak_")), key=lambda p: p.getName(), reverse=True)
    for stale in backups[keep:]:
        fs.delete(stale, True)


def copy_assets(spark: SparkSession, source: str, target: str, pages: DataFrame | None = None) -> DataFrame:
    """Files below a folder as a table (asset, content, length) written to a target; with `pages` (of `read_guides`), only those
    that their images lead to, with the address of each image (url)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
    kept = files.select(_below(spark, source, F.col("path")).alias("asset"), "content", "length").where("asset is not null")
    if pages is not None:
        images = pages.select(F.col("doc_title"), F.explode("images").alias("i"))
        wanted = images.select(resolved(F.col("doc_title"), F.col("i.original")).alias("asset"), F.col("i.url").alias("url")).distinct()
        kept = kept.join(small(wanted), "asset")
    kept.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
