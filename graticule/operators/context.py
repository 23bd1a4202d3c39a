"""Context packs: neighbour expansion, citations, images and context text from ranked chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graticule.functions.text import strip
from graticule.operators.batches import bound_batches
from graticule.operators.index import small


#: What names a run of neighbouring chunks: page ids are unique within a doc only.
PLACE = ["doc_id", "page_id", "granularity"]


def expand_one(results: DataFrame, chunks: DataFrame, max_chars: int = 4200) -> DataFrame:
    """Results with the chunk before and after (same page and granularity) where they fit, by two joins on seq.

    The centre comes first, then the left neighbour, then the right; each costs its length and two characters. A centre
    over the budget is cut and stands alone.
    """
    image_of = F.col("images") if "images" in chunks.columns else F.array().cast("array<string>")
    side = lambda step, name: chunks.select(*PLACE, (F.col("seq") + step).alias("seq"), F.col("text").alias(name), image_of.alias(f"{name}_images"))
    both = results.join(side(1, "_left"), [*PLACE, "seq"], "left").join(side(-1, "_right"), [*PLACE, "seq"], "left")
    room = F.lit(max_chars) - F.length("text")
    cost = lambda name: F.length(name) + 2
    fits = lambda name, room: F.col(name).isNotNull() & ((cost(name) <= room) if max_chars > 0 else F.lit(True))
    has_left = fits("_left", room)
    has_right = fits("_right", room - F.when(has_left, cost("_left")).otherwise(F.lit(0)))
    kept = F.filter(F.transform(F.array(F.when(has_left, F.col("_left")), F.col("text"), F.when(has_right, F.col("_right"))), lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != "")
    joined = F.array_join(kept, "\n\n")
    own = F.col("images") if "images" in results.columns else F.array().cast("array<string>")
    seen = F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in (F.when(has_left, F.col("_left_images")), own, F.when(has_right, F.col("_right_images")))])
    alone = (room <= 0) if max_chars > 0 else F.lit(False)
    whole = both.withColumn("expanded", F.when(alone, F.substring("text", 1, max_chars)).otherwise(joined) if max_chars > 0 else joined)
    whole = whole.withColumn("expanded_images", F.array_distinct(F.when(alone, F.coalesce(own, F.array().cast("array<string>"))).otherwise(seen)))
    return whole.drop("_left", "_right", "_left_images", "_right_images")


def walk(centre: int, own: str, near: dict[int, str], reach: int, max_chars: int) -> tuple[str, list[int]]:
    """Text around a centre, and the places it is from: neighbours alternate left and right, one that doesn't fit is
    skipped and the walk goes on."""
    if max_chars > 0 and len(own) >= max_chars:
        return own[:max_chars], [centre]
    wanted = {s: t for s, t in near.items() if abs(s - centre) <= reach and s != centre}
    kept, room = {centre: own}, max_chars - len(own)
    for step in range(1, reach + 1):
        for s in (centre - step, centre + step):
            if s in wanted and (max_chars <= 0 or len(wanted[s]) + 2 <= room):
                kept[s] = wanted[s]
                room -= len(wanted[s]) + 2
    return "\n\n".join(t.strip() for _, t in sorted(kept.items()) if t.strip()), sorted(kept)


def expand(results: DataFrame, chunks: DataFrame, neighbors: int = 1, max_chars: int = 4200) -> DataFrame:
    """Results with up to `neighbors` chunks on each side of the same doc, page and granularity, within `max_chars`: the text
    as `expanded`, and the images of its chunks, each once, as `expanded_images`.

    Neighbours are found by a band join on seq; a result has at most 2 * neighbors of them, whatever the page's size.
    """
    none = F.array().cast("array<string>")
    image_of = lambda rows: F.coalesce("images", none) if "images" in rows.columns else none
    if neighbors <= 0:
        return results.withColumn("expanded", F.col("text")).withColumn("expanded_images", image_of(results))
    if neighbors == 1:
        return expand_one(results, chunks, max_chars)
    bound_batches(results.sparkSession)
    shifts = F.array(*[F.lit(s) for s in range(-neighbors, neighbors + 1) if s])
    wanted = results.select("qid", "chunk_id", *PLACE, F.explode(F.transform(shifts, lambda s: F.col("seq") + s)).alias("seq"))
    near = wanted.join(chunks.select(*PLACE, "seq", "text", image_of(chunks).alias("images")), [*PLACE, "seq"])
    held = near.groupBy("qid", "chunk_id").agg(F.collect_list(F.struct("seq", "text", "images")).alias("near"))

    @F.pandas_udf("struct<expanded:string,expanded_images:array<string>>")
    def pack(seq: pd.Series, text: pd.Series, images: pd.Series, around: pd.Series) -> pd.DataFrame:
        texts, urls = [], []
        for s, t, own, a in zip(seq, text, images, around, strict=True):
            near = {n["seq"]: n for n in (a if a is not None else [])}
            whole, places = walk(s, t, {k: n["text"] for k, n in near.items()}, neighbors, max_chars)
            texts.append(whole)
            urls.append(list(dict.fromkeys(u for p in places for u in (own if p == s else near[p]["images"]))))
        return pd.DataFrame({"expanded": texts, "expanded_images": urls})

    packed = results.join(held, ["qid", "chunk_id"], "left").withColumn("_p", pack("seq", F.coalesce("text", F.lit("")), image_of(results), "near"))
    return packed.withColumn("expanded", F.col("_p.expanded")).withColumn("expanded_images", F.col("_p.expanded_images")).drop("near", "_p")


def requested(results: DataFrame, k: int, doc_ids: list[str] | None = None, page_ids: list[str] | None = None) -> DataFrame:
    """The first k results of the docs and pages that a reply asked for (an empty list asks for nothing in particular)."""
    for column, names in (("doc_id", doc_ids), ("page_id", page_ids)):
        if names:
            results = results.where(F.col(column).cast("string").isin([str(n) for n in names]))
    return results.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("rank") <= k)


def citations(results: DataFrame, version: str, most: int = 8) -> DataFrame:
    """First result of each (doc, page) of a query, in rank order: its title and link. At least one is given."""
    same = Window.partitionBy("qid", "doc_id", "page_id").orderBy("rank")
    first = results.withColumn("_n", F.row_number().over(same)).where("_n = 1")
    order = Window.partitionBy("qid").orderBy("rank")
    named = first.withColumn("citation", F.row_number().over(order)).where(F.col("citation") <= max(most, 1))
    blank = strip(F.coalesce("source_path", F.lit(""))) == ""
    own = F.coalesce("source_path", F.lit("")).startswith("custom/")
    page = F.concat(F.lit("/docs/page/"), F.col("doc_id").cast("string"), F.lit("/"), F.col("page_id").cast("string"), F.lit(f"?version={version}"))
    link = F.when(blank | own, page).otherwise(F.concat(F.lit(f"/rawdocs/{version}/"), F.col("source_path")))
    title = F.coalesce(F.element_at(F.when(F.size("heading_path") > 0, F.col("heading_path")), -1), F.col("page_id").cast("string"))
    return named.select("qid", "citation", "doc_id", "page_id", title.alias("title"), link.alias("link"))


def images(results: DataFrame, most: int = 6) -> DataFrame:
    """First occurrence of each image address of a query, in rank and list order, with the heading it stands near."""
    each = results.select("qid", "rank", "heading_path", F.posexplode("images").alias("pos", "url"))
    first = each.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "url").orderBy("rank", "pos"))).where("_n = 1")
    order = Window.partitionBy("qid").orderBy("rank", "pos")
    near = F.element_at(F.when(F.size("heading_path") > 0, F.col("heading_path")), -1)
    return first.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= max(most, 1)).select("qid", "nth", "url", near.alias("near_heading"))


def context_text(results: DataFrame, web: DataFrame | None = None, text: str = "expanded") -> DataFrame:
    """(qid, context): the results' texts with numbered headers, then the web blocks (qid, block); results are top-k."""
    seam = "\n\n---\n\n"
    header = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("doc_id").cast("string"), F.lit("/"), F.col("page_id").cast("string"), F.lit(" | "), F.array_join("heading_path", " > "))
    blocks = results.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(header, F.lit("\n"), F.col(text)).alias("block")))).alias("_b"))
    out = blocks.select("qid", F.array_join(F.transform("_b", lambda b: b["block"]), seam).alias("context"))
    if web is not None:
        gathered = web.groupBy("qid").agg(F.array_join(F.collect_list("block"), seam).alias("_web"))
        out = out.join(gathered, "qid", "full_outer").select("qid", F.concat_ws(seam, "context", "_web").alias("context"))
    return out.withColumn("context", F.when(strip("context") == "", "(no matches)").otherwise(F.col("context")))


# Fixed value: the first line of a reply that asks for more context.
NEED_MORE = "REQUEST_MORE_CONTEXT"
REQUEST = "struct<query:string,k:string,reason:string,doc_ids:string,page_ids:string>"


def context_request(answer: Column, default_k: int = 8) -> Column:
    """The request in a reply whose first line asks for more context, fenced or bare JSON; null without a query.

    A number of results that is missing, not whole or below 1 becomes the default; others are held within 1 to 25. A
    filter may be one string or a list.
    """
    body = strip(F.coalesce(answer, F.lit("")))
    asks = F.regexp_extract(body, r"^([^\r\n]*)", 1) == NEED_MORE
    inner = F.regexp_extract(F.regexp_replace(body, r"```(?:json)?", ""), r"(?s)(\{.*\})", 1)
    found = F.from_json(inner, REQUEST)
    number = F.when(found["k"].rlike(r"^-?\d{1,9}$"), found["k"].cast("int")).otherwise(F.lit(0))
    k = F.when(number <= 0, F.lit(default_k)).otherwise(F.least(number, F.lit(25)))
    many = lambda x: F.when(x.startswith("["), F.from_json(x, "array<string>")).when(strip(x) != "", F.array(x))
    query = F.nullif(strip(found["query"]), F.lit(""))
    return F.when(asks & query.isNotNull(), F.struct(query.alias("query"), k.alias("k"), found["reason"].alias("reason"), many(found["doc_ids"]).alias("doc_ids"), many(found["page_ids"]).alias("page_ids")))


def excluded(results: DataFrame, exclusions: DataFrame, k: int, by: str = "doc_id") -> DataFrame:
    """Results without excluded docs, cut to the first k that are left (exclusion follows the ranking)."""
    kept = results.join(small(exclusions.select(by).distinct()), by, "left_anti")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("rank") <= k)


def oversample(k: int) -> int:
    """Results that are fetched so that k are left after exclusions."""
    return min(max(5 * k, k + 10), 200)
