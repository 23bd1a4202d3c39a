"""Registered queries: whole searches with the default settings and in the other modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from graticule.engine import SearchConfig, converse, search
from graticule.operators.context import NEED_MORE
from graticule.operators.retrieval import STOPWORDS, bm25
from graticule.plans.q_search import RANKED, SCORED, STATS, SUMMARY, TOK, batch, chunks, summaries, vectors
from graticule.plans.q_text import STRIP
from graticule.plans.registry import register


def _searched(spark, sf_dir, config: SearchConfig):
    kind = F.when(F.col("lang") == "en", "p").when(F.col("lang") == "fr", "s").otherwise("t")
    path = F.array("doc_id", F.regexp_extract("text", r"^[^\n]*", 0))
    rows = chunks(spark, sf_dir).select("chunk_id", "doc_id", F.concat_ws("/", "doc_id", "lang").alias("page_id"), kind.alias("granularity"), F.col("page_id").alias("seq"), path.alias("heading_path"), "text", F.array().cast("array<string>").alias("images"))
    units = summaries(spark, sf_dir).select("chunk_id", "doc_id", F.concat_ws("/", "doc_id", "lang").alias("page_id"), "text")
    gone = chunks(spark, sf_dir).where("doc_id = 'src1'").select("doc_id").distinct()  # an excluded guide
    queries = batch(spark, sf_dir)
    asked = vectors(spark, sf_dir).join(queries.select(F.col("qid").alias("chunk_id")), "chunk_id", "left_semi").withColumnRenamed("chunk_id", "qid")
    found = search(queries, rows, config, vectors(spark, sf_dir), asked, units, gone)
    return found.select("qid", F.col("rank").cast("long").alias("rank"), F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), F.length("expanded").cast("long").alias("chars"))


@register("search_default")
def search_default(spark, sf_dir):
    return _searched(spark, sf_dir, SearchConfig())


# Both sides within the routed pages, fused, weighted by heading and kind, capped, without the excluded guide, with the
# documents before and after on the same page as neighbours.
HYBRID_SEARCH = f"""{SCORED}, {SUMMARY}, {RANKED.format('sr', 'su')},
  ch as (select doc_id, source, concat_ws('/', source, lang) page, case lang when 'en' then 'p' when 'fr' then 's' else 't' end kind, text, regexp_extract(text, '^[^\\n]*') line from documents),
  rp as (select qid, source, page, min(rank) first from sr join ch using (doc_id) where rank <= 12 group by all),
  rt as (select qid, source, page from (select *, row_number() over (partition by qid order by first, source, page) nth from rp) where nth <= 20),
  inside as (select qid, doc_id from rt join ch on rt.source = ch.source and rt.page = ch.page),
  ls as (select sc.* from sc where qid not in (select qid from rt) or (qid, doc_id) in (select (qid, doc_id) from inside)), {RANKED.format('br', 'ls')},
  v as (select vec_id, embedding::double[] e from embeddings),
  vs as (select a.vec_id qid, b.vec_id doc_id, list_inner_product(a.e, b.e) score from v a join v b on a.vec_id in (select item_id from benchmark) join ch on ch.doc_id = b.vec_id
    where a.vec_id not in (select qid from rt) or (a.vec_id, b.vec_id) in (select (qid, doc_id) from inside)), {RANKED.format('er', 'vs')},
  fu as (select coalesce(b.qid, e.qid) qid, coalesce(b.doc_id, e.doc_id) doc_id, coalesce(1.0::double / (60.0::double + b.rank), 0) + coalesce(0.6::double / (60.0::double + e.rank), 0) score
    from (select * from br where rank <= 120) b full outer join (select * from er where rank <= 120) e on b.qid = e.qid and b.doc_id = e.doc_id),
  bw as (select item_id qid, list_filter(list_distinct({TOK.format('text')}), lambda x: not list_contains({STOPWORDS!r}, x)) w from benchmark),
  ad as (select fu.qid, ch.*, fu.score * case when len(w) = 0 then 1.0 else 1.0 + 0.5 * len(list_intersect(w, {TOK.format("concat_ws(' ', source, line)")})) / len(w) end * case kind when 'p' then 1.05 when 's' then 1.0 else 0.9 end score
    from fu join ch using (doc_id) join bw on bw.qid = fu.qid),
  c1 as (select *, row_number() over (partition by qid, source, page order by round(score, 9) desc, doc_id) n from ad),
  c2 as (select *, row_number() over (partition by qid, source order by round(score, 9) desc, doc_id) m from c1 where n <= 3),
  c3 as (select *, row_number() over (partition by qid order by round(score, 9) desc, doc_id) k from c2 where m <= 12),
  c4 as (select *, row_number() over (partition by qid order by k) rank from c3 where k <= 40 and source <> 'src1'),
  nb as (select c4.*, l.text lt, r.text rt, 4200 - length(c4.text) room from c4
    left join ch l on l.doc_id = c4.doc_id - 1 and l.source = c4.source and l.page = c4.page and l.kind = c4.kind
    left join ch r on r.doc_id = c4.doc_id + 1 and r.source = c4.source and r.page = c4.page and r.kind = c4.kind where rank <= 8),
  n1 as (select *, case when length(lt) + 2 <= room then lt end lk from nb),
  n2 as (select *, case when length(rt) + 2 <= room - case when lk is null then 0 else length(lk) + 2 end then rt end rk from n1),
  pt as (select *, list_filter([length({STRIP.format("coalesce(lk, '')")}), length({STRIP.format("coalesce(text, '')")}), length({STRIP.format("coalesce(rk, '')")})], lambda x: x > 0) parts from n2)"""


@register("search_hybrid", f"with {HYBRID_SEARCH} select qid, rank::bigint as rank, doc_id, round(score, 6) as score, (case when room <= 0 then 4200 else coalesce(list_sum(parts), 0) + 2 * greatest(len(parts) - 1, 0) end)::bigint as chars from pt")
def search_hybrid(spark, sf_dir):
    return _searched(spark, sf_dir, SearchConfig(mode="hybrid", mmr_enabled=False, heading_boost=0.5))


@register("search_embedding")
def search_embedding(spark, sf_dir):
    return _searched(spark, sf_dir, SearchConfig(mode="embedding", summary_enabled=False, expand_neighbors=2))


def scripted(still, found, number):
    """Answers of a loop: a query asks as often as its id modulo 4 says, for the beginning of its text, then for the end of it in
    one guide, then for the beginning once more."""
    part = F.substring("text", 1, 40) if number != 2 else F.substring("text", -40, 40)
    docs = F.array(F.lit("src1")) if number == 2 else F.lit(None).cast("array<string>")
    request = F.to_json(F.struct(part.alias("query"), F.lit({1: 5, 2: 3}.get(number, 4)).alias("k"), docs.alias("doc_ids")))
    return still.select("qid", F.when(F.col("qid") % 4 >= number, F.concat(F.lit(f"{NEED_MORE}\n"), request)).otherwise(F.lit("done")).alias("answer"))


LOOP = f"""{STATS}, po as (select doc_id, term, count(*) tf from (select doc_id, unnest(toks) term from dl) group by all), df as (select term, count(*) df from po group by term),
  asked as (select 1 pass, 8 k, item_id qid, text from benchmark union all select 2, 5, item_id, left(text, 40) from benchmark where item_id % 4 >= 1 union all select 3, 3, item_id, right(text, 40) from benchmark where item_id % 4 >= 2),
  q as (select distinct pass, qid, unnest({TOK.format('text')}) term from asked),
  sc as (select pass, qid, po.doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) score
    from q join po using (term) join df using (term) join dl using (doc_id) cross join st group by all),
  r as (select sc.*, dl.source, row_number() over (partition by pass, qid order by round(score, 9) desc, sc.doc_id) rank from sc join dl using (doc_id)),
  f as (select *, row_number() over (partition by pass, qid order by rank) n from r where rank <= 125 and (pass < 3 or source = 'src1')),
  t as (select *, row_number() over (partition by f.qid, doc_id order by pass) first from f where n <= case pass when 1 then 8 when 2 then 5 else 3 end)"""


@register("retrieval_loop", f"with {LOOP} select qid, doc_id, round(score, 6) as score, pass::bigint as pass, (row_number() over (partition by qid order by pass, rank))::bigint as place from t where first = 1")
def retrieval_loop(spark, sf_dir):
    rows = chunks(spark, sf_dir)
    names = rows.select("chunk_id", "doc_id", F.col("page_id").cast("string").alias("page_id"))
    run = lambda asked, k: bm25(asked, rows, k).join(names, "chunk_id")
    found = converse(run, scripted, batch(spark, sf_dir), 8, 3).results
    return found.select("qid", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("pass").cast("long").alias("pass"), F.col("place").cast("long").alias("place"))


@register("retrieval_loop_outcomes", "select item_id as qid, case when item_id % 4 = 3 then 'limit' else 'answered' end as state, (item_id % 4 + 1 - (item_id % 4 = 3)::int)::bigint as passes from benchmark")
def retrieval_loop_outcomes(spark, sf_dir):
    rows = chunks(spark, sf_dir)
    names = rows.select("chunk_id", "doc_id", F.col("page_id").cast("string").alias("page_id"))
    ended = converse(lambda asked, k: bm25(asked, rows, k).join(names, "chunk_id"), scripted, batch(spark, sf_dir), 8, 3).outcomes
    return ended.select("qid", "state", F.col("passes").cast("long").alias("passes"))
