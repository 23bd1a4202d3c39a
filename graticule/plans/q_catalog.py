"""Registered queries: context packs, catalogue, publishing, sessions, access and job logs.

The tables stand in for the application's own: documents are pages of guides (their sources), `labels` marks published
edits (quality 1) and exclusions (toxic 1), orders and line items are sessions and messages, customers are users, and
events are a log.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graticule.operators import catalog, context, keyed, lineage
from graticule.operators.index import small
from graticule.plans.q_search import RANKED, SCORED, batch, chunks
from graticule.plans.registry import register
from graticule.sources import guides
from graticule.sources.tables import table
from graticule.streaming import jobs, stateful


def turns(spark, sf_dir) -> DataFrame:
    """Every turn of a conversation as a chunk: the conversation is a page, whose id another conversation's page shares in
    another doc. A turn's image is its role's."""
    rows = table(spark, sf_dir, "conversations")
    image = F.array(F.concat(F.lit("/assets/"), "role", F.lit(".png")))
    return rows.select((F.col("conv_id") % 2).alias("doc_id"), F.floor(F.col("conv_id") / 2).alias("page_id"), F.lit("p").alias("granularity"), F.col("turn").alias("seq"), "text", image.alias("images"))


TURNS = "t as (select conv_id % 2 doc_id, conv_id // 2 page_id, turn seq, text, '/assets/' || role || '.png' image from conversations)"
NEAR = "{0}.doc_id = t.doc_id and {0}.page_id = t.page_id and {0}.seq = t.seq"
ONCE = "array_to_string(list_filter(u, lambda x, i: list_position(u, x) = i), ' ')"


def results(spark, sf_dir) -> DataFrame:
    rows = turns(spark, sf_dir)
    qid = 2 * F.col("page_id") + F.col("doc_id")
    return rows.select(qid.alias("qid"), (qid * 1000 + F.col("seq")).alias("chunk_id"), "doc_id", "page_id", "granularity", "seq", "text", "images")


def expanded(spark, sf_dir, neighbors: int, most: int) -> DataFrame:
    out = context.expand(results(spark, sf_dir), turns(spark, sf_dir), neighbors, most)
    return out.select("doc_id", "page_id", "seq", "expanded", F.array_join("expanded_images", " ").alias("images"))


@register(
    "neighbors_1",
    f"""with {TURNS}, b as (select t.*, l.text lt, r.text rt, l.image li, r.image ri, 300 - length(t.text) room from t left join t l on {NEAR.format('l')} - 1 left join t r on {NEAR.format('r')} + 1),
  c as (select *, case when length(lt) + 2 <= room then lt end lk from b), e as (select *, case when length(rt) + 2 <= room - coalesce(length(lk) + 2, 0) then rt end rk from c),
  i as (select *, case when room <= 0 then [image] else list_filter([case when lk is not null then li end, image, case when rk is not null then ri end], lambda x: x is not null) end u from e)
  select doc_id, page_id, seq, case when room <= 0 then substring(text, 1, 300) else array_to_string(list_filter([trim(coalesce(lk, '')), trim(text), trim(coalesce(rk, ''))], lambda x: x <> ''), chr(10) || chr(10)) end as expanded, {ONCE} as images from i""",
)
def neighbors_1(spark, sf_dir):
    return expanded(spark, sf_dir, 1, 300)


@register(
    "neighbors_2",
    f"""with {TURNS}, b as (select t.*, 900 - length(t.text) room, l1.text l1, r1.text r1, l2.text l2, r2.text r2, l1.image i1, r1.image j1, l2.image i2, r2.image j2 from t
    left join t l1 on {NEAR.format('l1')} - 1 left join t r1 on {NEAR.format('r1')} + 1 left join t l2 on {NEAR.format('l2')} - 2 left join t r2 on {NEAR.format('r2')} + 2),
  c1 as (select *, case when length(l1) + 2 <= room then length(l1) + 2 else 0 end a from b), c2 as (select *, case when length(r1) + 2 <= room - a then length(r1) + 2 else 0 end e from c1),
  c3 as (select *, case when length(l2) + 2 <= room - a - e then length(l2) + 2 else 0 end i from c2), c4 as (select *, case when length(r2) + 2 <= room - a - e - i then length(r2) + 2 else 0 end o from c3),
  c5 as (select *, case when room <= 0 then [image] else list_filter([case when i > 0 then i2 end, case when a > 0 then i1 end, image, case when e > 0 then j1 end, case when o > 0 then j2 end], lambda x: x is not null) end u from c4)
  select doc_id, page_id, seq, case when room <= 0 then substring(text, 1, 900) else array_to_string(list_filter([case when i > 0 then trim(l2) else '' end, case when a > 0 then trim(l1) else '' end, trim(text), case when e > 0 then trim(r1) else '' end, case when o > 0 then trim(r2) else '' end], lambda x: x <> ''), chr(10) || chr(10)) end as expanded, {ONCE} as images from c5""",
)
def neighbors_2(spark, sf_dir):
    return expanded(spark, sf_dir, 2, 900)


def found(spark, sf_dir) -> DataFrame:
    """BM25 results as a context pack gets them; the page is the guide's language part."""
    from graticule.operators.retrieval import bm25

    ranked = bm25(batch(spark, sf_dir), chunks(spark, sf_dir), 40).join(chunks(spark, sf_dir), "chunk_id")
    path = F.array(F.col("doc_id"), F.col("lang"))
    images = F.array(F.concat(F.lit("/assets/"), "doc_id", F.lit(".png")), F.concat(F.lit("/assets/"), "lang", F.lit(".png")))
    source = F.when(F.col("lang") == "fr", F.lit("custom/x")).when(F.col("lang") == "de", F.lit(None)).otherwise(F.concat_ws("/", "doc_id", "lang"))
    return ranked.select("qid", "rank", "chunk_id", "doc_id", F.col("lang").alias("page_id"), path.alias("heading_path"), images.alias("images"), source.alias("source_path"), "text")


FOUND = f"""{SCORED}, {RANKED.format('br', 'sc')}, fo as (select qid, rank, doc_id chunk, source doc_id, lang page_id, case lang when 'fr' then 'custom/x' when 'de' then null else source || '/' || lang end sp, text from br join documents using (doc_id) where rank <= 40)"""


@register(
    "citations",
    f"""with {FOUND}, f as (select *, row_number() over (partition by qid, doc_id, page_id order by rank) k from fo), c as (select *, row_number() over (partition by qid order by rank) citation from f where k = 1)
  select qid, citation::bigint as citation, doc_id, page_id, page_id as title, case when sp is null or sp like 'custom/%' then '/docs/page/' || doc_id || '/' || page_id || '?version=v1' else '/rawdocs/v1/' || sp end as link from c where citation <= 8""",
)
def citations(spark, sf_dir):
    return context.citations(found(spark, sf_dir), "v1", 8).withColumn("citation", F.col("citation").cast("long"))


@register(
    "images_dedupe",
    f"""with {FOUND}, e as (select qid, rank, 0 pos, '/assets/' || doc_id || '.png' url, page_id near from fo union all select qid, rank, 1, '/assets/' || page_id || '.png', page_id from fo),
  f as (select *, row_number() over (partition by qid, url order by rank, pos) k from e), n as (select *, row_number() over (partition by qid order by rank, pos) nth from f where k = 1)
  select qid, nth::bigint as nth, url, near as near_heading from n where nth <= 6""",
)
def images_dedupe(spark, sf_dir):
    return context.images(found(spark, sf_dir), 6).withColumn("nth", F.col("nth").cast("long"))


@register("context_text", f"with {FOUND} select qid, string_agg('[' || rank || '] ' || doc_id || '/' || page_id || ' | ' || doc_id || ' > ' || page_id || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) as context from fo where rank <= 8 group by qid")
def context_text(spark, sf_dir):
    return context.context_text(found(spark, sf_dir).where("rank <= 8"), text="text")


@register("context_request", "select conv_id, turn, trim(replace(replace(text, '\"', ''''), chr(92), '')) as query, case when turn <= 0 then 8 when turn > 25 then 25 else turn end::bigint as k, role as doc_id from conversations where trim(text) <> ''")
def context_request(spark, sf_dir):
    plain = F.replace(F.replace(F.col("text"), F.lit('"'), F.lit("'")), F.lit("\\"), F.lit(""))
    body = F.to_json(F.struct(plain.alias("query"), F.col("turn").cast("string").alias("k"), F.array("role").alias("doc_ids")))
    answer = F.concat(F.lit("REQUEST_MORE_CONTEXT\n```json\n"), body, F.lit("\n```"))
    asked = table(spark, sf_dir, "conversations").select("conv_id", "turn", context.context_request(answer).alias("r")).where("r is not null")
    return asked.select("conv_id", "turn", "r.query", F.col("r.k").cast("long").alias("k"), F.get("r.doc_ids", F.lit(0)).alias("doc_id"))


def page_table(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_id"), "text", "lang")


def edits(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    status = F.when(F.col("quality") == 1, "published").otherwise("draft")
    return rows.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_id"), status.alias("status"), F.concat(F.lit("edited "), F.col("doc_id").cast("string")).alias("content_md"), F.lit("v1").alias("version"))


@register("effective_markdown", "select d.source as doc_id, d.doc_id as page_id, coalesce('edited ' || l.doc_id, d.text) as markdown, l.doc_id is not null as edited from documents d left join labels l on l.doc_id = d.doc_id and l.quality = 1")
def effective_markdown(spark, sf_dir):
    return catalog.effective_markdown(page_table(spark, sf_dir), edits(spark, sf_dir), ["doc_id", "page_id"])


@register("page_overrides", "select d.doc_id as page_id, coalesce('edited ' || l.doc_id, d.text) as text from documents d left join labels l on l.doc_id = d.doc_id and l.quality = 1")
def page_overrides(spark, sf_dir):
    from graticule.operators.chunking import with_overrides

    return with_overrides(page_table(spark, sf_dir), guides.published(edits(spark, sf_dir), "v1"), ["doc_id", "page_id"], "text").select("page_id", "text")


def custom(spark, sf_dir) -> DataFrame:
    """Custom pages: one per web page, in two guides of its own, and one per edit."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("web"), (F.col("page_id") % 2).cast("string")).alias("doc_id"), (F.col("page_id") + 10_000_000_000).alias("page_id"), F.col("url").alias("text"))
    return pages.unionByName(edits(spark, sf_dir).select("doc_id", "page_id", F.col("content_md").alias("text")))


CUSTOM = "cu as (select 'web' || (page_id % 2) doc_id, page_id + 10000000000 page_id, url as text from pages union all select d.source, d.doc_id, 'edited ' || d.doc_id from labels join documents d using (doc_id))"


@register(
    "catalog_counts",
    f"""with {CUSTOM}, o as (select source doc_id, count(*) n from documents group by source), m as (select doc_id, count(*) n from cu group by doc_id), x as (select distinct source doc_id from documents join labels using (doc_id) where toxic = 1)
  select coalesce(o.doc_id, m.doc_id) as doc_id, (coalesce(o.n, 0) + coalesce(m.n, 0))::bigint as n_pages, case when o.doc_id is null then 'custom' else 'ingested' end as origin, coalesce(o.doc_id, m.doc_id) in (select doc_id from x) as excluded from o full outer join m on o.doc_id = m.doc_id""",
)
def catalog_counts(spark, sf_dir):
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").join(table(spark, sf_dir, "documents"), "doc_id").select(F.col("source").alias("doc_id"))
    return catalog.catalog_counts(page_table(spark, sf_dir), custom(spark, sf_dir), toxic)


@register("catalog_detail", f"with {CUSTOM} select source as doc_id, doc_id as page_id, text, 'ingested' as origin from documents union all select cu.doc_id, cu.page_id, cu.text, 'custom' from cu where not exists (select 1 from documents d where d.source = cu.doc_id and d.doc_id = cu.page_id)")
def catalog_detail(spark, sf_dir):
    return catalog.catalog_detail(page_table(spark, sf_dir), custom(spark, sf_dir), ["doc_id", "page_id"]).select("doc_id", "page_id", "text", "origin")


@register("resolve_page", f"with {CUSTOM} select coalesce(d.source, cu.doc_id) as doc_id, coalesce(d.doc_id, cu.page_id) as page_id, case when d.doc_id is not null then d.text else cu.text end as text, case when d.doc_id is not null then 'ingested' else 'custom' end as origin from documents d full outer join cu on cu.doc_id = d.source and cu.page_id = d.doc_id")
def resolve_page(spark, sf_dir):
    return catalog.resolve_page(page_table(spark, sf_dir), custom(spark, sf_dir), ["doc_id", "page_id"], ["text"])


@register("admitted_pages", f"with {CUSTOM} select cu.doc_id, cu.page_id from cu where cu.doc_id like 'web%' and false union all select d.source, d.doc_id from documents d join labels l using (doc_id) where l.quality = 1 and d.lang <> 'en'")
def admitted_pages(spark, sf_dir):
    from graticule.operators.chunking import admitted

    ingested = page_table(spark, sf_dir).where("lang = 'en'")
    return admitted(custom(spark, sf_dir), ingested, edits(spark, sf_dir), ["doc_id", "page_id"]).select("doc_id", "page_id")


@register("guide_assembly", "select source, string_agg('[[DOC_SECTION: ' || doc_id || ']]' || chr(10) || text, chr(10) order by doc_id) as markdown from documents group by source")
def guide_assembly(spark, sf_dir):
    return catalog.guide(table(spark, sf_dir, "documents"), "source", "doc_id", "doc_id", "text")


@register("acl_filter", "select doc_id, case when doc_id % 2 = 0 then 'admin' else 'client' end as role from documents where doc_id % 2 = 0 or source not in ('src1', 'src3')")
def acl_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("role", F.when(F.col("doc_id") % 2 == 0, "admin").otherwise("client"))
    return catalog.allowed_docs(rows, F.col("role"), ["src1", "src3"], "source").select("doc_id", "role")


SESSIONS = "s as (select o_orderkey session_id, o_custkey owner_id, o_orderdate created_at from orders), m as (select l_orderkey session_id, max(l_shipdate) last_message_at from lineitem group by all)"


def sessions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").cast("string").alias("owner_id"), F.col("o_orderdate").alias("created_at"))


def messages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_shipdate").alias("created_at"), F.col("l_linenumber").alias("nth"))


@register("session_list", f"with {SESSIONS} select session_id, owner_id::varchar as owner_id, created_at, last_message_at, coalesce(last_message_at, created_at) as recency from s left join m using (session_id)")
def session_list(spark, sf_dir):
    return catalog.session_list(sessions(spark, sf_dir), messages(spark, sf_dir)).select("session_id", "owner_id", "created_at", "last_message_at", "recency")


@register("visible_sessions", "select o_orderkey as session_id from orders where o_custkey = 7")
def visible_sessions(spark, sf_dir):
    return catalog.visible_sessions(sessions(spark, sf_dir), "7", "client").select("session_id")


@register(
    "message_history_reference",
    "with n as (select *, row_number() over (partition by conv_id order by turn) k from conversations), c as (select *, count(*) over (partition by conv_id) a from n where k <= 20) select conv_id, turn, role, text from c where k > a - 10",
)
def message_history_reference(spark, sf_dir):
    return catalog.history(table(spark, sf_dir, "conversations"), "conv_id", ["turn"]).select("conv_id", "turn", "role", "text")


@register("message_history_latest", "with n as (select *, row_number() over (partition by conv_id order by turn desc) k from conversations) select conv_id, turn, role, text from n where k <= 10")
def message_history_latest(spark, sf_dir):
    return catalog.history(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], mode="latest").select("conv_id", "turn", "role", "text")


@register(
    "upsert_latest",
    "with e as (select user_id, event_type, value, ts, event_id from events), r as (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) k, min(ts) over (partition by user_id, event_type) c from e) select user_id, event_type, value, ts as updated_at, c as created_at from r where k = 1",
)
def upsert_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.col("ts").alias("updated_at"), F.col("ts").alias("created_at"), "event_id")
    first = F.min("created_at").over(catalog.Window.partitionBy("user_id", "event_type"))
    merged = catalog.latest(rows.withColumn("_c", first), ["user_id", "event_type"], [F.col("updated_at").desc(), F.col("event_id").desc()])
    return merged.select("user_id", "event_type", "value", "updated_at", F.col("_c").alias("created_at"))


@register("partial_update", "select c_custkey, case when c_acctbal < 0 then null else c_mktsegment end as c_mktsegment, c_acctbal from customer")
def partial_update(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    changes = rows.where("c_acctbal < 0").select("c_custkey", F.lit(None).cast("string").alias("c_mktsegment"), F.lit(True).alias("set_c_mktsegment"))
    return catalog.partial_update(rows, changes, ["c_custkey"], ["c_mktsegment"]).select("c_custkey", "c_mktsegment", "c_acctbal")


@register("cascade_delete", "select 'order' as kind, count(*)::bigint as n from orders where o_orderstatus <> 'F' union all select 'line', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')")
def cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("session_id"))
    parents, children = catalog.cascade(sessions(spark, sf_dir), messages(spark, sf_dir), gone, "session_id")
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return count(parents, "order").union(count(children, "line"))


def requests(spark, sf_dir) -> DataFrame:
    """Publish requests: every labelled document, pending where it is good."""
    rows = table(spark, sf_dir, "labels")
    return rows.select(
        F.lit("v1").alias("version"),
        "doc_id",
        F.when(F.col("quality") == 1, "pending").otherwise("rejected").alias("status"),
        (F.col("doc_id") % 100 + 1).alias("author_id"),
        F.lit(None).cast("long").alias("reviewed_by"),
        F.lit(None).cast("string").alias("reviewed_at"),
        F.lit(None).cast("string").alias("review_note"),
    )


@register("publish_review", "select doc_id, case when quality = 1 then 'approved' else 'rejected' end as status, case when quality = 1 then 5::bigint else 0 end as reviewed_by, quality = 0 as conflict from labels")
def publish_review(spark, sf_dir):
    rows = requests(spark, sf_dir)
    decisions = rows.select("version", "doc_id", F.lit("approved").alias("status"), F.lit(5).cast("long").alias("reviewed_by"), F.lit("2026-01-01").alias("reviewed_at"), F.lit("ok").alias("review_note"))
    return catalog.review(rows, decisions, ["version", "doc_id"]).select("doc_id", "status", F.coalesce("reviewed_by", F.lit(0)).alias("reviewed_by"), "conflict")


@register("publish_queue", "select l.doc_id, c.c_name as author from labels l left join customer c on c.c_custkey = l.doc_id % 100 + 1 where l.quality = 1")
def publish_queue(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"))
    return catalog.publish_queue(requests(spark, sf_dir), users, "v1", "pending").select("doc_id", F.col("author_id_name").alias("author"))


def users(spark, sf_dir) -> DataFrame:
    role = F.when(F.col("c_mktsegment").startswith("A"), "admin").when(F.col("c_mktsegment").startswith("B"), "redactor").otherwise("client")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), F.concat("c_name", F.lit("@x.org")).alias("email"), role.alias("role"), F.when(F.col("c_acctbal") < 0, "2026-01-01").alias("disabled_at"))


@register("active_admins", "select count(*)::bigint as n from customer where c_mktsegment like 'A%' and not c_acctbal < 0")
def active_admins(spark, sf_dir):
    return catalog.active_admins(users(spark, sf_dir))


@register("default_permissions", "select c_custkey as user_id, (c_mktsegment like 'A%' or c_mktsegment like 'B%')::int as docs_edit, (c_mktsegment like 'A%')::int as docs_publish from customer")
def default_permissions(spark, sf_dir):
    return users(spark, sf_dir).select("user_id", catalog.default_permissions(F.col("role")).alias("p")).select("user_id", "p.docs_edit", "p.docs_publish")


@register("user_migration", "select c_custkey as user_id, lower(c_name || '@x.org') as email, case when c_mktsegment like 'A%' then 'admin' when c_mktsegment like 'B%' then 'redactor' else 'client' end as role, case when c_acctbal < 0 then 1 else (c_mktsegment like 'A%' or c_mktsegment like 'B%')::int end as docs_edit from customer")
def user_migration(spark, sf_dir):
    old = users(spark, sf_dir).withColumn("role", F.concat(F.lit(" "), F.upper("role"), F.lit("\n"))).withColumn("docs_edit", F.when(F.col("disabled_at").isNotNull(), 1)).withColumn("docs_publish", F.lit(None).cast("int"))
    return catalog.migrated_users(old).select("user_id", "email", "role", "docs_edit")


@register("login_lookup", "select c_custkey as user_id from customer where c_name = (select min(c_name) from customer)")
def login_lookup(spark, sf_dir):
    rows = users(spark, sf_dir)
    login = F.concat(F.lit(" "), F.lit(rows.agg(F.min("email")).first()[0]))
    return catalog.find_user(rows, login).select("user_id")


@register("settings_overlay", "select event_id, 'stored' as mode, '8' as k, event_type as extra from events")
def settings_overlay(spark, sf_dir):
    default = F.create_map(F.lit("mode"), F.lit("bm25"), F.lit("k"), F.lit("8"))
    stored = F.create_map(F.lit("mode"), F.lit("stored"), F.lit("extra"), F.col("event_type"))
    merged = table(spark, sf_dir, "events").select("event_id", catalog.overlay(default, stored).alias("m"))
    return merged.select("event_id", *[F.col("m")[k].alias(k) for k in ("mode", "k", "extra")])


@register("props_json", "select event_id, json_extract_string(props, '$.k')::bigint as k from events")
def props_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@register("unique_names", "select distinct r_name as name, r_name || '-2' as unique from region union all select 'free', 'free'")
def unique_names(spark, sf_dir):
    names = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))
    taken = names.union(names.select(F.concat("name", F.lit("-1")))).union(names.select(F.concat("name", F.lit("-3"))))
    return catalog.free_suffix(names.union(names.limit(1).select(F.lit("free"))), taken)


# What an event says in a job's log, by its kind.
LINE = "case event_type {} else '  Done: x' end"


SAID = ["Ingesting doc: a", "Indexing 5 chunks", "Computing embeddings 7", "ERROR: bad", "  Done: x"]


def log(spark, sf_dir) -> DataFrame:
    line = F.get(F.array(*[F.lit(k) for k in SAID]), F.col("event_id").cast("int") % 5)
    return table(spark, sf_dir, "events").select("user_id", "event_id", line.alias("line"))


@register(
    "job_progress",
    """with l as (select user_id, event_id, ['converting_html_to_md', 'indexing_bm25', 'computing_embeddings', 'failed', null][event_id % 5 + 1] p, (event_id % 5 = 4)::int d from events)
  select user_id, event_id, coalesce(last_value(p ignore nulls) over w, 'queued') as phase, (sum(d) over w)::bigint as doc_done from l window w as (partition by user_id order by event_id rows between unbounded preceding and current row)""",
)
def job_progress(spark, sf_dir):
    return jobs.job_progress(log(spark, sf_dir), "user_id", "event_id", "line")


@register("log_tail", "with r as (select user_id, event_id, row_number() over (partition by user_id order by event_id desc) k from events) select user_id, event_id from r where k <= 220")
def log_tail(spark, sf_dir):
    return jobs.log_tail(log(spark, sf_dir), "user_id", "event_id").select("user_id", "event_id")


@register(
    "job_stream_states",
    """with l as (select user_id, event_id, ['converting_html_to_md', 'indexing_bm25', 'computing_embeddings', 'failed', null][event_id % 5 + 1] p, (event_id % 5 = 4)::int d from events)
  select user_id::varchar as job, coalesce(arg_max(p, event_id) filter (where p is not null), 'queued') as phase, sum(d)::bigint as doc_done, max(event_id) as last_line, least(count(*), 220)::bigint as tail_lines from l where user_id is not null group by user_id""",
)
def job_stream_states(spark, sf_dir):
    """The events' log as a stream into keyed state, and the last state of each job."""
    events = table(spark, sf_dir, "events")
    folder = f"{lineage.shared_folder(spark)}/jobs-{uuid.uuid4().hex}"
    kinds = F.array(*[F.lit(k) for k in SAID])
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern: the table may be one file or a folder
    stream = stream.select("user_id", "event_id", F.get(kinds, F.col("event_id").cast("int") % 5).alias("line"))
    stateful.into_table(stateful.job_stream(stream, "user_id", "event_id", "line"), f"{folder}/out", f"{folder}/state", "job").awaitTermination()
    found = stateful.latest(spark, f"{folder}/out", "job")
    return found.select("job", "phase", "doc_done", "last_line", F.size("tail").cast("long").alias("tail_lines"))


@register("session_touch", "select user_id, max(ts) as last_seen_at from events group by user_id")
def session_touch(spark, sf_dir):
    return jobs.last_seen(table(spark, sf_dir, "events"), "user_id", "ts")


@register("ttl_expired", "with s as (select user_id, max(ts) last_seen_at from events group by user_id) select user_id, last_seen_at from s where last_seen_at < (select max(ts) from events) - interval 1 days")
def ttl_expired(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    return jobs.expired(jobs.last_seen(events, "user_id", "ts"), now, 1)


@register("activity_windows", "select date_trunc('hour', ts)::timestamp as window_start, event_type, count(*)::bigint as n from events group by all")
def activity_windows(spark, sf_dir):
    return jobs.activity_windows(table(spark, sf_dir, "events"), "ts", "event_type").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@register("page_lookup", "with n as (select source, doc_id, lang, row_number() over (partition by source, lang order by doc_id desc) k from documents) select source as doc_id, lang as page_id, doc_id as nth from n where k = 1")
def page_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("lang").alias("page_id"), F.col("doc_id").alias("nth"))
    return guides.page_lookup(rows, "nth").select("doc_id", "page_id", "nth")


@register("first_titles", "select source as doc_id, arg_min(lang, doc_id) as doc_title from documents group by source")
def first_titles(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("lang").alias("doc_title"), F.col("doc_id").alias("nth"))
    return guides.doc_titles(rows, "nth")


@register("custom_paths", "select doc_id, case when doc_id % 3 = 0 then source || ' > ' || lang else source || ' > page' end as path from documents")
def custom_paths(spark, sf_dir):
    stored = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.array("source", "lang"))).when(F.col("doc_id") % 3 == 1, F.lit("[]")).otherwise(F.lit("{broken"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("doc_title"), F.lit("page").alias("page_title"), stored.alias("heading_path_json"))
    return guides.custom_pages(rows).select("doc_id", F.array_join("heading_path", " > ").alias("path"))


@register("catalog_lines", "select source as doc_id, doc_id::varchar as page_id, row_number() over (partition by source order by doc_id) as line from documents where source is not null")
def catalog_lines(spark, sf_dir):
    """A catalogue in files by guide and page, written and read back; lines are counted on over the files of a guide."""
    docs = table(spark, sf_dir, "documents").where("source is not null")
    folder = f"{lineage.shared_folder(spark)}/catalog-{uuid.uuid4().hex}"
    record = F.to_json(F.struct(F.col("source").alias("doc_id"), F.col("doc_id").cast("string").alias("page_id"), F.substring("text", 1, 30).alias("page_title")))
    lines = docs.select(F.col("source").alias("guide"), "doc_id", record.alias("value")).repartitionByRange("guide", "doc_id").sortWithinPartitions("guide", "doc_id")
    lines.select("guide", "value").write.partitionBy("guide").text(folder)
    read = guides.read_catalog(spark, folder, numbers=True)
    files = read.groupBy("doc_id", "file").agg(F.max("line").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("doc_id").orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("doc_id", "file", F.coalesce(before, F.lit(0)).alias("_before"))
    return read.join(small(files), ["doc_id", "file"]).select("doc_id", "page_id", (F.col("_before") + F.col("line")).alias("line"))


@register("keyed_in_place", "select c_custkey, case when c_acctbal < 0 then null else c_mktsegment end as c_mktsegment, c_acctbal from customer where c_custkey % 11 <> 0")
def keyed_in_place(spark, sf_dir):
    """A table dealt in buckets by its key, updated and deleted from in place."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    held = keyed.KeyedTable.create(rows, f"{lineage.shared_folder(spark)}/keyed-{uuid.uuid4().hex}", ["c_custkey"], 16)
    held.update(rows.where("c_acctbal < 0").select("c_custkey", F.lit(None).cast("string").alias("c_mktsegment"), F.lit(True).alias("set_c_mktsegment")), ["c_mktsegment"])
    held.delete(rows.where("c_custkey % 11 = 0"))
    return held.read()
