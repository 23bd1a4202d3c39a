"""Registered queries: index, ranking, fusion, selection."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graticule.functions.text import tokens
from graticule.operators import impacts, index, lineage, retrieval, selection, store
from graticule.plans.registry import register
from graticule.sources.tables import table

TOK = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9ıſ]+')"

#: The chunks of these queries are whole documents: a guide is a source, a page a document.
CHUNKS = f"d as (select doc_id, source, lang, text, {TOK.format('text')} toks from documents), dl as (select *, len(toks) as dl from d where len(toks) > 0)"
STATS = CHUNKS + ", st as (select count(*) n, round(sum(dl) / count(*), 6) avgdl from dl)"
POSTED = STATS + ", po as (select doc_id, term, count(*) tf from (select doc_id, unnest(toks) term from dl) group by all), df as (select term, count(*) df from po group by term)"
QUERIES = f"q as (select distinct item_id qid, unnest({TOK.format('text')}) term from benchmark)"
SCORED = f"""{POSTED}, {QUERIES}, sc as (
  select q.qid, po.doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) score
  from q join po using (term) join df using (term) join dl using (doc_id) cross join st group by all)"""
RANKED = "{0} as (select *, row_number() over (partition by qid order by round(score, 9) desc, doc_id) rank from {1})"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), F.col("doc_id").alias("page_id"), "lang", "text")


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def shown(ranked: DataFrame, *more: str) -> DataFrame:
    return ranked.select("qid", F.col("rank").cast("long").alias("rank"), F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), *more)


@register("tokens_len", f"with {CHUNKS} select doc_id, dl::bigint as length from dl")
def tokens_len(spark, sf_dir):
    return index.lengths(chunks(spark, sf_dir)).select(F.col("chunk_id").alias("doc_id"), "length")


@register("term_freq", f"with {POSTED} select doc_id, term, tf::bigint as tf from po")
def term_freq(spark, sf_dir):
    return index.postings(chunks(spark, sf_dir)).select(F.col("chunk_id").alias("doc_id"), "term", "tf")


@register("doc_freq", f"with {POSTED} select term, df::bigint as df from df")
def doc_freq(spark, sf_dir):
    return index.document_frequency(index.postings(chunks(spark, sf_dir)))


@register("idf_weights", f"with {POSTED} select term, round(ln((n - df + 0.5) / (df + 0.5) + 1), 9) as idf from df cross join st")
def idf_weights(spark, sf_dir):
    rows = chunks(spark, sf_dir)
    stats = index.corpus_stats(rows).select("n_chunks")
    return index.document_frequency(index.postings(rows)).crossJoin(F.broadcast(stats)).select("term", F.round(index.idf(F.col("n_chunks"), F.col("df")), 9).alias("idf"))  # stats: one row


@register("corpus_stats", f"with {STATS} select n::bigint as n_chunks, (select sum(dl) from dl)::bigint as total_tokens, avgdl from st")
def corpus_stats(spark, sf_dir):
    return index.corpus_stats(chunks(spark, sf_dir))


@register("docs_per_source", "select source, count(*)::bigint as n_docs, count(distinct lang)::bigint as n_langs from documents group by source")
def docs_per_source(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.countDistinct("lang").alias("n_langs"))


@register("distinct_sources", "select count(distinct source)::bigint as n_sources from documents")
def distinct_sources(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.countDistinct("source").alias("n_sources"))


@register("bm25_topk", f"with {SCORED}, {RANKED.format('r', 'sc')} select qid, rank::bigint as rank, doc_id, round(score, 6) as score from r where rank <= 8")
def bm25_topk(spark, sf_dir):
    return shown(retrieval.bm25(batch(spark, sf_dir), chunks(spark, sf_dir), 8))


@register(
    "bm25_page_filter",
    f"with {SCORED}, al as (select sc.* from sc semi join (select doc_id from documents where lang = 'en') e using (doc_id)), {RANKED.format('r', 'al')} select qid, rank::bigint as rank, doc_id, round(score, 6) as score from r where rank <= 8",
)
def bm25_page_filter(spark, sf_dir):
    rows = chunks(spark, sf_dir)
    return shown(retrieval.bm25(batch(spark, sf_dir), rows, 8, rows.where("lang = 'en'")))


# The summary of a page is its first line.
SUMMARY = f"""sd as (select doc_id, source, {TOK.format("regexp_extract(text, '^[^\\n]*')")} toks from documents),
  sl as (select *, len(toks) dl from sd where len(toks) > 0), ss as (select count(*) n, round(sum(dl) / count(*), 6) avgdl from sl),
  sp as (select doc_id, term, count(*) tf from (select doc_id, unnest(toks) term from sl) group by all), sf as (select term, count(*) df from sp group by term),
  su as (select q.qid, sp.doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) score
    from q join sp using (term) join sf using (term) join sl using (doc_id) cross join ss group by all)"""


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).withColumn("text", F.regexp_extract(F.coalesce("text", F.lit("")), r"^[^\n]*", 0))


@register("summary_bm25", f"with {QUERIES}, {SUMMARY}, {RANKED.format('r', 'su')} select qid, rank::bigint as rank, doc_id, round(score, 6) as score from r where rank <= 12")
def summary_bm25(spark, sf_dir):
    return shown(retrieval.bm25(batch(spark, sf_dir), summaries(spark, sf_dir).select("chunk_id", "text"), 12))


@register(
    "summary_routed_bm25",
    f"""with {SCORED}, {SUMMARY}, {RANKED.format('sr', 'su')},
  rt as (select qid, doc_id from sr where rank <= 12),
  inn as (select sc.* from sc semi join rt on sc.qid = rt.qid and sc.doc_id = rt.doc_id union all select * from sc where qid not in (select qid from rt)),
  {RANKED.format('r', 'inn')} select qid, rank::bigint as rank, doc_id, round(score, 6) as score from r where rank <= 8""",
)
def summary_routed_bm25(spark, sf_dir):
    queries = batch(spark, sf_dir)
    routes = retrieval.routed_pages(queries, summaries(spark, sf_dir), 12, 20)
    return shown(retrieval.routed_bm25(queries, chunks(spark, sf_dir), routes, 8))


VECTORS = """v as (select vec_id, embedding::double[] e from embeddings), vs as (select a.vec_id qid, b.vec_id doc_id, list_inner_product(a.e, b.e) score from v a join v b on {0}), """


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


@register("vector_topk", f"with {VECTORS.format('a.vec_id % 50 = 0')} {RANKED.format('r', 'vs')} select qid, rank::bigint as rank, doc_id, round(score, 6) as score from r where rank <= 8")
def vector_topk(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return shown(retrieval.vector_rank(rows.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "qid"), rows, 8))


@register(
    "l2_normalize",
    "with v as (select vec_id, embedding::double[] e from embeddings) select vec_id, round((e[1] / case when n = 0 then 1 else n end)::float::double, 6) as first, round(list_sum(list_transform(e, lambda x: (x / case when n = 0 then 1 else n end) ** 2)), 5) as total from (select *, sqrt(list_inner_product(e, e)) n from v)",
)
def l2_normalize(spark, sf_dir):
    unit = table(spark, sf_dir, "embeddings").select("vec_id", index.l2_normalize(F.col("embedding")).alias("u"))
    total = F.aggregate("u", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return unit.select("vec_id", F.round(F.get("u", F.lit(0)).cast("double"), 6).alias("first"), F.round(total, 5).alias("total"))


# Query vectors: the embedding whose id is the query's.
HYBRID = f"""{SCORED}, {RANKED.format('br', 'sc')}, {VECTORS.format('a.vec_id in (select item_id from benchmark)')} {RANKED.format('er', 'vs')},
  fu as (select coalesce(b.qid, e.qid) qid, coalesce(b.doc_id, e.doc_id) doc_id, coalesce(1.0::double / (60.0::double + b.rank), 0) + coalesce(0.6::double / (60.0::double + e.rank), 0) score
    from (select * from br where rank <= 120) b full outer join (select * from er where rank <= 120) e on b.qid = e.qid and b.doc_id = e.doc_id)"""


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, rows = batch(spark, sf_dir), vectors(spark, sf_dir)
    asked = rows.join(queries.select(F.col("qid").alias("chunk_id")), "chunk_id", "left_semi").withColumnRenamed("chunk_id", "qid")
    return retrieval.rrf(retrieval.bm25(queries, chunks(spark, sf_dir), 120), retrieval.vector_rank(asked, rows, 120), 60, 1.0, 0.6)


@register("rrf_hybrid", f"with {HYBRID}, {RANKED.format('r', 'fu')} select qid, rank::bigint as rank, doc_id, round(score, 9) as score from r where rank <= 8")
def rrf_hybrid(spark, sf_dir):
    return retrieval.top_k(fused(spark, sf_dir), 8).select("qid", F.col("rank").cast("long").alias("rank"), F.col("chunk_id").alias("doc_id"), F.round("score", 9).alias("score"))


PRIORITY = [f"src{i}" for i in range(6)]
# Headings: the source and the first line. Granularity: by language.
FACTORS = f"""fa as (select b.item_id qid, d.doc_id,
    case when len(w) = 0 then 1.0 else 1.0 + 0.5 * len(list_intersect(w, {TOK.format("d.source || ' ' || regexp_extract(d.text, '^[^\\n]*')")})) / len(w) end hf,
    case when list_position({PRIORITY!r}, d.source) is null or list_position({PRIORITY!r}, d.source) = 0 then 1.0 else 1.0 + 0.2 * (1.0 - (list_position({PRIORITY!r}, d.source) - 1) / 5.0) end pf,
    case d.lang when 'en' then 1.05 when 'fr' then 1.0 when 'de' then 0.9 else 1.0 end gf
  from (select item_id, list_filter(list_distinct({TOK.format('text')}), lambda x: not list_contains({retrieval.STOPWORDS!r}, x)) w from benchmark) b
  join (select qid, doc_id from {{0}}) k on k.qid = b.item_id join documents d on d.doc_id = k.doc_id)"""


def factors(ranked: DataFrame, spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[Column]]:
    """Ranked rows with what the factors need, and the factors."""
    rows = ranked.join(chunks(spark, sf_dir), "chunk_id").join(batch(spark, sf_dir).withColumnRenamed("text", "query"), "qid")
    heading = F.concat_ws(" ", "doc_id", F.regexp_extract("text", r"^[^\n]*", 0))
    kind = F.when(F.col("lang") == "en", "p").when(F.col("lang") == "fr", "s").when(F.col("lang") == "de", "t").otherwise("x")
    return rows, [retrieval.heading_factor(F.col("query"), heading, 0.5), retrieval.priority_factor(F.col("doc_id"), PRIORITY, 0.2), retrieval.granularity_factor(kind)]


@register(
    "adjusted_score",
    f"""with {SCORED}, {RANKED.format('br', 'sc')}, b40 as (select * from br where rank <= 40), {FACTORS.format('b40')},
  ad as (select b.qid, b.doc_id, b.score * hf * pf * gf score, hf, pf, gf from b40 b join fa using (qid, doc_id)), {RANKED.format('r', 'ad')}
  select qid, rank::bigint as rank, doc_id, round(score, 6) as score, round(hf, 6) as heading, round(pf, 6) as priority, round(gf, 6)::double as granularity from r""",
)
def adjusted_score(spark, sf_dir):
    ranked, by = factors(retrieval.bm25(batch(spark, sf_dir), chunks(spark, sf_dir), 40), spark, sf_dir)
    rows = retrieval.adjusted(ranked, by)
    return shown(rows, *[F.round(f, 6).alias(n) for f, n in zip(by, ("heading", "priority", "granularity"), strict=True)])


CAPPED = """c1 as (select *, row_number() over (partition by qid, page order by round(score, 9) desc, doc_id) pn from {0}),
  c2 as (select *, row_number() over (partition by qid, source order by round(score, 9) desc, doc_id) dn from c1 where pn <= {1}),
  c3 as (select *, row_number() over (partition by qid order by round(score, 9) desc, doc_id) rank from c2 where dn <= {2})"""


@register(
    "dedupe_caps",
    f"""with {SCORED}, {RANKED.format('br', 'sc')}, b as (select br.*, source, source || '/' || lang page from br join documents using (doc_id) where rank <= 120), {CAPPED.format('(select * exclude rank from b)', 3, 12)}
  select qid, rank::bigint as rank, doc_id, round(score, 6) as score from c3 where rank <= 40""",
)
def dedupe_caps(spark, sf_dir):
    ranked = retrieval.bm25(batch(spark, sf_dir), chunks(spark, sf_dir), 120)
    rows = ranked.join(chunks(spark, sf_dir).withColumn("page_id", F.concat_ws("/", "doc_id", "lang")), "chunk_id").drop("rank")
    return shown(selection.capped_top_k(rows, 40, 3, 12))


@register(
    "hybrid_full",
    f"""with {HYBRID}, {FACTORS.format('fu')}, ad as (select f.qid, f.doc_id, f.score * hf * pf * gf score from fu f join fa using (qid, doc_id)),
  b as (select ad.*, source, source || '/' || lang page from ad join documents using (doc_id)), {CAPPED.format('b', 3, 12)}
  select qid, rank::bigint as rank, doc_id, round(score, 9) as score from c3 where rank <= 8""",
)
def hybrid_full(spark, sf_dir):
    ranked, by = factors(fused(spark, sf_dir), spark, sf_dir)
    rows = retrieval.adjusted(ranked, by).withColumn("page_id", F.concat_ws("/", "doc_id", "lang")).drop("rank")
    out = selection.capped_top_k(rows, 8, 3, 12)
    return out.select("qid", F.col("rank").cast("long").alias("rank"), F.col("chunk_id").alias("doc_id"), F.round("score", 9).alias("score"))


@register(
    "minmax_relevance",
    f"""with {SCORED}, {RANKED.format('br', 'sc')}, b as (select * from br where rank <= 80), m as (select *, min(score) over (partition by qid) lo, max(score) over (partition by qid) hi from b)
  select qid, doc_id, round(case when hi > lo then (score - lo) / (hi - lo) else 1.0 end, 6) as relevance from m""",
)
def minmax_relevance(spark, sf_dir):
    ranked = retrieval.bm25(batch(spark, sf_dir), chunks(spark, sf_dir), 80)
    return ranked.select("qid", F.col("chunk_id").alias("doc_id"), F.round(selection.relevance(F.col("score")), 6).alias("relevance"))


@register(
    "word_overlap",
    f"""with {SCORED}, {RANKED.format('br', 'sc')}, w as (select doc_id, list_distinct({TOK.format('text')}[1:256]) w from documents), bw as (select item_id qid, list_distinct({TOK.format('text')}[1:256]) w from benchmark)
  select b.qid, b.doc_id, round(case when len(w.w) = 0 or len(bw.w) = 0 then 0.0 else len(list_intersect(w.w, bw.w)) / len(list_distinct(list_concat(w.w, bw.w)))::double end, 6) as jaccard
  from br b join w using (doc_id) join bw on b.qid = bw.qid where rank <= 8""",
)
def word_overlap(spark, sf_dir):
    ranked = retrieval.bm25(batch(spark, sf_dir), chunks(spark, sf_dir), 8).join(chunks(spark, sf_dir), "chunk_id").join(batch(spark, sf_dir).withColumnRenamed("text", "query"), "qid")
    same = selection.jaccard(selection.overlap_words(F.col("text")), selection.overlap_words(F.col("query")))
    return ranked.select("qid", F.col("chunk_id").alias("doc_id"), F.round(same, 6).alias("jaccard"))


@register(
    "vector_clamped",
    f"with {VECTORS.format('a.vec_id % 50 = 0')} {RANKED.format('r', 'vs')} select qid, doc_id, round(greatest(0.0, least(1.0, score)), 6) as similarity from r where rank <= 80",
)
def vector_clamped(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    asked = rows.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("qid"), "vector")
    hits = retrieval.vector_rank(asked, rows, 80).join(rows, "chunk_id").join(asked.withColumnRenamed("vector", "own"), "qid")
    return hits.select("qid", F.col("chunk_id").alias("doc_id"), F.round(selection.clamped_dot(F.col("own"), F.col("vector")), 6).alias("similarity"))


def _mmr(spark: SparkSession, sf_dir: str, use_vectors: bool) -> DataFrame:
    ranked = retrieval.bm25(batch(spark, sf_dir), chunks(spark, sf_dir), 80).join(chunks(spark, sf_dir), "chunk_id")
    with_vectors = ranked.join(vectors(spark, sf_dir), "chunk_id", "left")
    out = selection.mmr(with_vectors, 8, 0.8, 80, 3, 12, use_vectors)
    return out.select("qid", F.col("place").cast("long").alias("place"), F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), F.round("value", 6).alias("value"))


def _mmr_sql(use_vectors: bool, k: int = 8) -> str:
    """One pair of tables for each place: the row chosen there, and what is left with its greatest likeness to the chosen.

    The caps can't bite here: a page is one document, and 8 places are fewer than 12 of a source.
    """
    words = "case when len(a.w) = 0 or len(b.w) = 0 then 0 else len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) end"
    alike = f"case when a.e is not null and b.e is not null then greatest(0, least(1, list_inner_product(a.e, b.e))) else {words} end" if use_vectors else words
    steps = [f"""{SCORED}, {RANKED.format('r', 'sc')},
  l0 as materialized (select r.qid, r.doc_id, r.rank, r.score, list_distinct(dl.toks[1:256]) w, m.embedding::double[] e, 0::double near,
    case when max(r.score) over o > min(r.score) over o then (r.score - min(r.score) over o) / (max(r.score) over o - min(r.score) over o) else 1 end rel
    from r join dl using (doc_id) left join embeddings m on m.vec_id = r.doc_id where r.rank <= 80 window o as (partition by r.qid))"""]
    for place in range(1, k + 1):
        value = "round(rel, 9)" if place == 1 else "round(0.8::double * rel - (1 - 0.8::double) * near, 9)"
        steps.append(f"p{place} as materialized (select * from (select *, {value} v, row_number() over (partition by qid order by {value} desc, rank) first from l{place - 1}) where first = 1)")
        steps.append(f"l{place} as materialized (select b.* replace (greatest(b.near, {alike}) as near) from l{place - 1} b join p{place} a on a.qid = b.qid and a.doc_id <> b.doc_id)")
    chosen = " union all ".join(f"select qid, {place}::bigint as place, doc_id, round(score, 6) as score, round(v, 6) as value from p{place}" for place in range(1, k + 1))
    return f"with {', '.join(steps)} {chosen}"


@register("mmr_words", _mmr_sql(False))
def mmr_words(spark, sf_dir):
    return _mmr(spark, sf_dir, False)


@register("mmr_mixed", _mmr_sql(True))
def mmr_mixed(spark, sf_dir):
    return _mmr(spark, sf_dir, True)


@register(
    "multi_pass_merge",
    f"""with {SCORED}, {RANKED.format('br', 'sc')}, {QUERIES.replace('q as', 'q_unused as')}, {SUMMARY}, {RANKED.format('sr', 'su')},
  a as (select qid, doc_id, score, 0 pass, rank from br where rank <= 8 union all select qid, doc_id, score, 1 pass, rank from sr where rank <= 8),
  f as (select *, row_number() over (partition by qid, doc_id order by pass, rank) k from a)
  select qid, doc_id, round(score, 6) as score, (row_number() over (partition by qid order by pass, rank))::bigint as place from f where k = 1""",
)
def multi_pass_merge(spark, sf_dir):
    queries = batch(spark, sf_dir)
    passes = [retrieval.bm25(queries, chunks(spark, sf_dir), 8), retrieval.bm25(queries, summaries(spark, sf_dir), 8)]
    return retrieval.multi_pass_merge(passes).select("qid", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@register("query_terms", f"with {QUERIES} select qid, term from q")
def query_terms(spark, sf_dir):
    return retrieval.query_terms(batch(spark, sf_dir))


@register(
    "exclusion_filter",
    f"""with {SCORED}, {RANKED.format('br', 'sc')}, k as (select * exclude rank, rank old from br where rank <= 40 and doc_id not in (select doc_id from labels where toxic = 1)),
  r as (select *, row_number() over (partition by qid order by old) rank from k) select qid, rank::bigint as rank, doc_id, round(score, 6) as score from r where rank <= 8""",
)
def exclusion_filter(spark, sf_dir):
    from graticule.operators.context import excluded, oversample

    ranked = retrieval.bm25(batch(spark, sf_dir), chunks(spark, sf_dir), oversample(8))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("chunk_id"))
    return shown(excluded(ranked, toxic, 8, "chunk_id"))


# An index under changes: all documents come in; then every tenth is rewritten, and every seventh deleted; then late and repeated
# changes of lower versions come, which nothing follows.
@register(
    "live_index_df",
    f"""with now as (select doc_id, case when doc_id % 10 = 0 then 'rewritten ' || source || ' ' || coalesce(text, '') else text end as text from documents where doc_id % 7 <> 0),
  dt as (select doc_id, unnest(list_distinct({TOK.format('text')})) as term from now)
  select term, count(*)::bigint as df from dt group by term""",
)
def live_index_df(spark, sf_dir):
    docs = chunks(spark, sf_dir).select("chunk_id", F.col("doc_id").alias("source"), "text")
    live = store.LiveIndex(spark, f"{lineage.shared_folder(spark)}/live-{uuid.uuid4().hex}")
    live.apply(docs.select("chunk_id", F.lit(1).cast("long").alias("version"), "text"))
    rewritten = docs.where("chunk_id % 10 = 0").select("chunk_id", F.lit(3).cast("long").alias("version"), F.concat(F.lit("rewritten "), "source", F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))
    gone = docs.where("chunk_id % 7 = 0").select("chunk_id", F.lit(4).cast("long").alias("version"), F.lit(None).cast("string").alias("text"))
    live.apply(rewritten.unionByName(gone))
    live.apply(docs.where("chunk_id % 35 = 0").select("chunk_id", F.lit(2).cast("long").alias("version"), F.lit("late").alias("text")))
    live.compact()
    return live.read().terms


@register("bm25_blocks", f"with {SCORED}, {RANKED.format('r', 'sc')} select qid, rank::bigint as rank, doc_id, round(score, 6) as score from r where rank <= 8")
def bm25_blocks(spark, sf_dir):
    built = impacts.ImpactIndex.build(chunks(spark, sf_dir).select("chunk_id", "text"), f"{lineage.shared_folder(spark)}/blocks-{uuid.uuid4().hex}")
    return shown(built.search(batch(spark, sf_dir), 8).results)
