"""Registered queries: text, web, HTML and chunking operators over documents, pages, parts and conversations.

Where the tables hold no Markdown (headings, images, tables, front matter), it is put around the texts in the query, in
the same way on both sides.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.functions import html as kernels
from graticule.functions import inline
from graticule.functions import text as T
from graticule.functions import web
from graticule.operators import chunking
from graticule.plans.registry import register
from graticule.sources import guides
from graticule.sources.tables import table

BLANK = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
STRIP = "regexp_replace({0}, '^" + BLANK.replace("{", "{{").replace("}", "}}") + "+|" + BLANK.replace("{", "{{").replace("}", "}}") + "+$', '', 'g')"


def docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


@register("slugify_names", "select p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(p_name || ' ' || p_type)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'untitled') as slug from part")
def slugify_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.slugify(F.concat_ws(" ", "p_name", "p_type")).alias("slug"))


@register("safe_slug", "select c_custkey, coalesce(nullif(regexp_replace(regexp_replace(trim(c_name || '#' || c_mktsegment), '[^a-zA-Z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'item') as slug from customer")
def safe_slug(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.safe_slug(F.concat_ws("#", "c_name", "c_mktsegment")).alias("slug"))


@register("token_count", "select conv_id, turn, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9ıſ]+'))::bigint as n_tokens from conversations")
def token_count(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.token_count(F.col("text")).alias("n_tokens"))


def _tags(html: str) -> str:
    out = f"coalesce({html}, '')"
    for name in ("script", "style", "noscript"):
        out = rf"regexp_replace({out}, '(?is)<{name}\b[^>]*>.*?</{name}>', '', 'g')"
    out = rf"regexp_replace({out}, '(?i)<br\s*/?>', chr(10), 'g')"
    out = rf"regexp_replace({out}, '(?i)</(p|div|li|tr|h[1-6])\s*>', chr(10), 'g')"
    out = rf"regexp_replace(regexp_replace({out}, '(?i)<li\b[^>]*>', '- ', 'g'), '<[^>]+>', '', 'g')"
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
        out = f"replace({out}, '{a}', '{b}')"
    return STRIP.format(rf"regexp_replace(regexp_replace({out}, '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


@register("html_to_text", f"select page_id, {_tags('html')} as text from pages")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@register("html_title", rf"select page_id, nullif({_tags(chr(39).join(['regexp_extract(html, ', '(?is)<title[^>]*>(.*?)</title>', ', 1)']))}, '') as title from pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


@register("html_to_markdown")
def html_to_markdown(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", kernels.markdown_of("html", "url").alias("markdown"))


ADDRESS = rf"""case when u = '' then null when lower(u) like 'http://%' or lower(u) like 'https://%' then u when lower(u) like 'www.%' then 'https://' || u
  when contains(u, '.') and regexp_full_match(regexp_extract(u, '^([^/?#:]*)', 1), '[A-Za-z0-9.-]+')
   and lower(regexp_extract(regexp_extract(u, '^([^/?#:]*)', 1), '([^.]*)$', 1)) in ({', '.join(repr(t) for t in web.TOP_LEVEL)}) then 'https://' || u end"""
TRIM = r"""regexp_replace(regexp_replace({0}, '^[()\[\]{{}}<>"'']+|[()\[\]{{}}<>"'']+$', '', 'g'), '[.,);\]}}>"''?!]+$', '')"""


@register("normalize_url", f"select page_id, {ADDRESS} as address from (select page_id, {TRIM.format('regexp_replace(url, ' + chr(39) + '^https?://' + chr(39) + ', ' + chr(39) * 2 + ')')} as u from pages)")
def normalize_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", web.normalize_url(F.regexp_replace("url", "^https?://", "")).alias("address"))


@register(
    "extract_urls",
    f"""with w as (select doc_id, list_concat(regexp_extract_all(text, '(?i)https?://[^\\s)<>"]+'), regexp_split_to_array({STRIP.format('text')}, '{BLANK}+')) ws from documents),
  c as (select doc_id, i, {TRIM.format('ws[i]')} u from w, unnest(generate_series(1, len(ws))) t(i)),
  n as (select doc_id, i, {ADDRESS} as a from c),
  f as (select doc_id, a, min(i) i from n where a is not null group by all)
  select d.doc_id, coalesce(array_to_string(list(a order by i)[1:2], ' '), '') as urls from documents d left join f using (doc_id) group by d.doc_id""",
)
def extract_urls(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(web.extract_urls(F.col("text"), 2), " ").alias("urls"))


@register("search_prefix", r"select conv_id, turn, nullif(regexp_extract('web: ' || text, '(?is)^\s*(?:web|ddg|search)\s*:\s*(.+?)\s*$', 1), '') as query from conversations")
def search_prefix(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", web.search_prefix(F.concat(F.lit("web: "), "text")).alias("query"))


@register("search_results", "select page_id, url as address, url as title, url as snippet from pages")
def search_results(spark, sf_dir):
    # a result page with the row's address behind a redirect, twice
    one = F.concat(F.lit('<div><a rel="nofollow" class="result__a" href="//duck.example/l/?uddg='), F.url_encode("url"), F.lit('&amp;rut=1"><b>'), "url", F.lit('</b></a><a class="result__snippet">'), "url", F.lit("</a></div>"))
    found = web.search_results(F.concat(one, one), 5)
    each = table(spark, sf_dir, "pages").select("page_id", F.explode(found).alias("r"))
    return each.select("page_id", F.col("r.url").alias("address"), F.col("r.title").alias("title"), F.col("r.snippet").alias("snippet"))


@register("front_matter", "select doc_id, 'title: \"' || source || '\"' || chr(10) || 'lang: ' || lang as front, length(ltrim(text, chr(10)))::bigint as body_chars, source as title, lang from documents")
def front_matter(spark, sf_dir):
    page = F.concat(F.lit('---\ntitle: "'), "source", F.lit('"\nlang: '), "lang", F.lit("\n---\n"), "text")
    parts = docs(spark, sf_dir).select("doc_id", T.front_matter(page).alias("p"))
    fields = T.front_matter_fields(F.col("p.front"))
    return parts.select("doc_id", F.col("p.front").alias("front"), F.length("p.body").cast("long").alias("body_chars"), fields["title"].alias("title"), fields["lang"].alias("lang"))


@register("inline_strip", "select doc_id, source || ' (' || lang || ') bold ' || lang || ' code ' || text as plain from (select doc_id, source, lang, replace(replace(replace(text, '*', ''), '_', ''), '`', '') as text from documents)")
def inline_strip(spark, sf_dir):
    bare = F.regexp_replace("text", "[*_`]", "")
    marked = F.concat(F.lit("["), "source", F.lit("]("), "lang", F.lit(") **bold** *"), "lang", F.lit("* `code` "), bare)
    safe = T.strip_inline_markup(marked)
    return docs(spark, sf_dir).select("doc_id", safe.alias("plain"))


@register("long_token_split", r"select doc_id, length(text)::bigint + coalesce(list_sum(list_transform(regexp_extract_all(text, '\S+'), lambda w: (length(w) - 1) // 12)), 0)::bigint as chars from documents")
def long_token_split(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.length(T.split_long_tokens(F.col("text"), 12)).cast("long").alias("chars"))


@register("code_wrap", "select doc_id, greatest(1, ceil(length(text) / 90.0))::bigint as n_lines, substring(text, greatest(1, ceil(length(text) / 90.0))::bigint * 90 - 89) as last_line from documents")
def code_wrap(spark, sf_dir):
    pieces = T.wrap_code(F.col("text"), 90)
    return docs(spark, sf_dir).select("doc_id", F.size(pieces).cast("long").alias("n_lines"), F.element_at(pieces, -1).alias("last_line"))


def _replaced(text: str, table_of: dict[str, str]) -> str:
    for a, b in table_of.items():
        text = f"replace({text}, '{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}')"
    return text


ARROWED = "replace(replace(text, '. ', ' => '), ', ', ' <-> ')"


@register("symbol_map", f"select doc_id, {_replaced(ARROWED, T.ARROWS)} as text, {_replaced(_replaced(ARROWED, T.ARROWS), T.ASCII_FORMS)} as plain from documents")
def symbol_map(spark, sf_dir):
    typed = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(" => ")), F.lit(", "), F.lit(" <-> "))
    return docs(spark, sf_dir).select("doc_id", T.arrows(typed).alias("text"), T.ascii_forms(T.arrows(typed)).alias("plain"))


@register("text_runs", f"with t as (select doc_id, {_replaced(ARROWED, T.ARROWS)} x from documents) select doc_id, len(regexp_extract_all(x, '[←→↔⇐⇒⇔•]'))::bigint as symbols, len(regexp_extract_all(x, '[^←→↔⇐⇒⇔•]+'))::bigint as plain from t")
def text_runs(spark, sf_dir):
    typed = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(" => ")), F.lit(", "), F.lit(" <-> "))
    runs = T.text_runs(typed)
    count = lambda kind: F.size(F.filter(runs, lambda r: r["kind"] == kind)).cast("long")
    return docs(spark, sf_dir).select("doc_id", count("symbol").alias("symbols"), count("plain").alias("plain"))


@register("latin1_safe", f"select doc_id, regexp_replace({_replaced('text', T.ASCII_FORMS)}, '[^\\x{{00}}-\\x{{ff}}]', '?', 'g') as text, regexp_matches(text, '[^\\x{{00}}-\\x{{ff}}]') as wide from documents")
def latin1_safe(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.latin1_safe(F.col("text")).alias("text"), T.needs_unicode(F.col("text")).alias("wide"))


@register("table_flatten", "select doc_id, lang || ' - ' || source || chr(10) || 'a - b' || chr(10) || 'end' as text from documents")
def table_flatten(spark, sf_dir):
    rows = F.concat(F.lit("| "), "lang", F.lit(" | **"), "source", F.lit("** |\n|:---|---|\n| a |  |  b |\n||\nend"))
    return docs(spark, sf_dir).select("doc_id", T.flatten_tables(rows).alias("text"))


#: Prepared texts (doc_id, p) of the documents, before they are cut.
PREPARED = f"""l as (select doc_id, string_split({_replaced("replace(replace(text, chr(0), ' '), chr(160), ' ')", T.EMBED_FORMS)}, chr(10)) ls from documents),
  f as (select doc_id, i, l.ls[i] x, list_filter(list_transform(string_split(regexp_replace({STRIP.format('l.ls[i]')}, '^\\|+|\\|+$', '', 'g'), '|'), lambda c: {STRIP.format(f"regexp_replace(replace(c, '**', ''), '{BLANK}+', ' ', 'g')")}), lambda c: c <> '') cs,
      string_split(regexp_replace({STRIP.format('l.ls[i]')}, '^\\|+|\\|+$', '', 'g'), '|') raw from l, unnest(generate_series(1, len(ls))) t(i)),
  k as (select doc_id, i, case when not contains(x, '|') then x when len(cs) = 0 or len(list_filter(raw, lambda c: not regexp_full_match({STRIP.format('c')}, '[-:]*'))) = 0 then null else array_to_string(cs, ' - ') end y from f),
  j as (select doc_id, string_agg(y, chr(10) order by i) t from k where y is not null group by doc_id),
  pr as (select d.doc_id, coalesce({STRIP.format("regexp_replace(replace(t, '*', ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', ' ', 'g')")}, '') p from documents d left join j using (doc_id))"""


@register("embed_prepare", f"with {PREPARED} select doc_id, substring(p, 1, 448) as text from pr")
def embed_prepare(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.prepare_for_embedding(F.col("text"), 448, kernels.nfkc).alias("text"))


# fixed values: truncation lengths
CUTS = "[1280, 1200, 1100, 1024, 896, 832, 768, 704, 640, 576, 512, 448, 384, 320, 256]"


@register(
    "embed_variants",
    f"""with {PREPARED},
  m as (select doc_id, p, regexp_replace(p, '[^\\x00-\\x7F]', '', 'g') safe, {STRIP.format(f"regexp_replace(p, '{BLANK}+', ' ', 'g')")} flat,
    array_to_string(list_filter(string_split(regexp_replace(p, '\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), chr(10)), lambda x: length({STRIP.format('x')}) >= 12), chr(10)) long_lines,
    regexp_extract_all(p, '[A-Za-z0-9]+') ws from pr),
  w as (select doc_id, i, ws[i] w, lower(ws[i]) lw from m, unnest(generate_series(1, len(ws))) t(i)),
  o as (select doc_id, min(i) i, arg_min(w, i) w from w group by doc_id, lw),
  s as (select *, sum(length(w) + 1) over (partition by doc_id order by i) - length(w) - 2 before from o)
  select doc_id, 'base' as name, length(p)::bigint as chars from m
  union all select doc_id, 'ascii_safe', length(safe) from m where safe <> p
  union all select doc_id, 'collapsed_ws', length(flat) from m where flat <> '' and flat <> p
  union all select doc_id, 'truncate_' || n, n from m, unnest({CUTS}) c(n) where length(p) > n
  union all select doc_id, 'drop_short_lines', length(long_lines) from m where long_lines <> ''
  union all select doc_id, 'bag_of_words', length(string_agg(w, ' ' order by i)) from s where before < 420 group by doc_id""",
)
def embed_variants(spark, sf_dir):
    variants = T.embedding_fallbacks(T.prepare_for_embedding(F.col("text"), 0))
    return docs(spark, sf_dir).select("doc_id", F.explode(variants).alias("v")).select("doc_id", F.col("v.name").alias("name"), F.length("v.text").cast("long").alias("chars"))


@register(
    "bag_of_words",
    """with w as (select doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') ws from documents),
  e as (select doc_id, i, ws[i] w, lower(ws[i]) lw from w, unnest(generate_series(1, len(ws))) t(i)),
  f as (select doc_id, min(i) i, arg_min(w, i) w from e group by doc_id, lw),
  s as (select *, sum(length(w) + 1) over (partition by doc_id order by i) - length(w) - 2 before from f)
  select d.doc_id, coalesce(string_agg(w, ' ' order by i) filter (before < 420), '') as bag from documents d left join s using (doc_id) group by d.doc_id""",
)
def bag_of_words(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.bag_of_words(F.col("text")).alias("bag"))


@register("citation_markers", "select doc_id, '1,' || (10 + length(lang))::varchar as cited from documents")
def citation_markers(spark, sf_dir):
    answer = F.concat(F.regexp_replace("text", r"\[\d+\]", ""), F.lit(" [1] and ["), (F.length("lang") + 10).cast("string"), F.lit("] and [1]"))
    return docs(spark, sf_dir).select("doc_id", F.array_join(F.transform(T.citation_markers(answer), lambda x: x.cast("string")), ",").alias("cited"))


@register("note_kinds", "select p_partkey, case when contains(lower(p_name), 'caution') then 'Caution' when contains(lower(p_name), 'warning') then 'Warning' when contains(lower(p_name), 'tip') then 'Tip' else 'Note' end as kind from part")
def note_kinds(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.note_kind(F.col("p_name")).alias("kind"))


@register("template_render", "select doc_id, 'Answer from ' || source || ' in ' || lang || ': ' || text as prompt from documents")
def template_render(spark, sf_dir):
    values = {"source": F.col("source"), "lang": F.col("lang"), "context": F.col("text")}
    return docs(spark, sf_dir).select("doc_id", T.render_template("Answer from {{source}} in {{lang}}: {{context}}", values, ("context",)).alias("prompt"))


@register("image_width", "select doc_id, '/assets/' || source || '.png' as address, length(text)::double as width, '%' as unit from documents")
def image_width(spark, sf_dir):
    spec = F.concat(F.lit("/assets/"), "source", F.lit(".png|width="), F.length("text").cast("string"), F.lit("%"))
    return docs(spark, sf_dir).select("doc_id", T.image_width(spec).alias("w")).select("doc_id", "w.address", "w.width", "w.unit")


@register("section_marker", "select doc_id, source as section from documents")
def section_marker(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.section_marker(F.concat("text", F.lit("\n[[ doc_section: "), "source", F.lit(" ]]"))).alias("section"))


@register("markdown_images", "select doc_id, lang as alt, '/assets/' || source || '.png' as url from documents")
def markdown_images(spark, sf_dir):
    marked = F.concat(F.regexp_replace("text", r"!\[", "["), F.lit("\n![ "), "lang", F.lit(" ](/assets/"), "source", F.lit(".png)\n"))
    each = docs(spark, sf_dir).select("doc_id", F.explode(T.markdown_images(marked)).alias("i"))
    return each.select("doc_id", "i.alt", "i.url")


@register("drop_image_lines", "select doc_id, case when text like '%' || chr(10) then left(text, length(text) - 1) else text end as text from documents")
def drop_image_lines(spark, sf_dir):
    marked = F.concat(F.lit("![a](b)\n"), "text")
    return docs(spark, sf_dir).select("doc_id", T.drop_image_lines(marked).alias("text"))


@register("same_heading", "select doc_id, source as heading, true as same from documents")
def same_heading(spark, sf_dir):
    first = T.first_heading(F.concat(F.lit("\n \n##  "), "source", F.lit("\n"), "text"))
    return docs(spark, sf_dir).select("doc_id", first.alias("heading"), T.same_heading(first, F.concat(F.lit(" "), F.upper("source"))).alias("same"))


def pages(spark, sf_dir) -> DataFrame:
    """A page of three headings and an image around each text."""
    body = F.concat(F.lit("# "), "source", F.lit("\n\n  ## "), "lang", F.lit("\n\n"), "text", F.lit("\n\n![i](/assets/a.png)\n\n### end\n\nlast"))
    title = F.concat(F.lit("page "), F.col("doc_id").cast("string"))
    return docs(spark, sf_dir).select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_id"), F.col("source").alias("doc_title"), title.alias("page_title"), body.alias("markdown"))


@register(
    "heading_paths",
    """with l as (select doc_id, source, lang, 4 + len(regexp_extract_all(text, '\\n')) + 4 as last from documents)
  select doc_id, 0::bigint as line, 1::bigint as level, source || ' > ' || source as path from l union all
  select doc_id, 2, 2, source || ' > ' || source || ' > ' || lang from l union all select doc_id, last, 3, source || ' > ' || source || ' > ' || lang || ' > end' from l""",
)
def heading_paths(spark, sf_dir):
    found = chunking.heading_paths(pages(spark, sf_dir), "page_id", "doc_title", "markdown")
    return found.select(F.col("page_id").alias("doc_id"), F.col("line").cast("long").alias("line"), F.col("level").cast("long").alias("level"), F.array_join("path", " > ").alias("path"))


def peeled(most: int, start: str) -> str:
    """SQL that peels blocks (doc_id, part, s) as split_long_block does; cuts(doc_id, part, n, piece)."""
    low = int(most * 0.6)
    window = f"substring(s, {low} + 1, {most - low})"
    at = f"case when contains({window}, chr(10)) then {most} - instr(reverse({window}), chr(10)) when contains({window}, ' ') then {most} - instr(reverse({window}), ' ') else {most} end"
    return f"""peel as (
    select doc_id, part, 0 n, null::varchar piece, s from {start}
    union all
    select doc_id, part, n + 1, case when length(s) <= {most} then s else {STRIP.format(f'left(s, {at})').replace('^' + BLANK + '+|', '')} end,
           case when length(s) <= {most} then '' else {STRIP.format(f'substring(s, {at} + 1)').replace('|' + BLANK + '+$', '')} end from peel where s <> ''),
  cuts as (select doc_id, part, n, piece from peel where piece <> '')"""


@register("split_long_block", f"with recursive b as (select doc_id, 1 part, {STRIP.format('text')} s from documents), {peeled(900, 'b')} select doc_id, n::bigint as n, piece from cuts")
def split_long_block(spark, sf_dir):
    pieces = docs(spark, sf_dir).select("doc_id", F.posexplode(chunking.long_block_pieces("text", F.lit(900))).alias("n", "piece"))
    return pieces.select("doc_id", (F.col("n") + 1).cast("long").alias("n"), "piece")


@register(
    "chunk_markdown",
    f"""with recursive p as (select doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) ps from documents),
  b as (select * from (select doc_id, part, {STRIP.format('ps[part]')} s from p, unnest(generate_series(1, len(ps))) t(part)) where s <> ''), {peeled(900, 'b')},
  o as (select doc_id, piece, length(piece) len, row_number() over (partition by doc_id order by part, n) k from cuts),
  w as (select doc_id, k, len size, 1 c from o where k = 1 union all
    select o.doc_id, o.k, case when w.size + 2 + o.len > 900 then o.len else w.size + 2 + o.len end, case when w.size + 2 + o.len > 900 then w.c + 1 else w.c end from w join o on o.doc_id = w.doc_id and o.k = w.k + 1)
  select doc_id, c::bigint as n, string_agg(piece, chr(10) || chr(10) order by k) as chunk from w join o using (doc_id, k) group by doc_id, c""",
)
def chunk_markdown(spark, sf_dir):
    text = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    each = docs(spark, sf_dir).select("doc_id", F.posexplode(chunking.packed_chunks(text, F.lit(900))).alias("n", "chunk"))
    return each.select("doc_id", (F.col("n") + 1).cast("long").alias("n"), "chunk")


@register("semantic_chunks")
def semantic_chunks(spark, sf_dir):
    return chunking.chunk_pages(pages(spark, sf_dir))


@register(
    "image_split",
    f"""select doc_id as page_id, 0::int as n, {STRIP.format("'# ' || source || chr(10) || chr(10) || '  ## ' || lang || chr(10) || chr(10) || text")} as text, ['/assets/a.png'] as images from documents
  union all select doc_id, 1, '### end' || chr(10) || chr(10) || 'last', [] from documents""",
)
def image_split(spark, sf_dir):
    blocks = chunking.image_blocks(F.col("markdown"), F.array("doc_title"))
    return pages(spark, sf_dir).select("page_id", F.posexplode(blocks).alias("n", "b")).select("page_id", "n", "b.text", "b.images")


@register("summary_units")
def summary_units(spark, sf_dir):
    each = pages(spark, sf_dir).select("page_id", F.posexplode(chunking.page_units("markdown", "doc_title", "page_title")).alias("n", "u"))
    return each.select("page_id", "n", F.col("u.heading_path").alias("heading_path"), chunking.lead_sentences(F.col("u.text")).alias("summary"))


@register("admonitions", "select doc_id, '::: tip ' || source || chr(10) || text || chr(10) || ':::' || chr(10) || 'end' as text from documents")
def admonitions(spark, sf_dir):
    noted = F.concat(F.lit("> [!TIP] "), "source", F.lit("\n> "), F.regexp_replace("text", "\n", "\n> "), F.lit("\nend"))
    return docs(spark, sf_dir).select("doc_id", kernels.admonitions_of(noted).alias("text"))


@register("nfkc_text")
def nfkc_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", kernels.nfkc("text").alias("text"))


# References of the shapes that pages have, and the files that there are, both by document: a plain name, a step that leads
# nowhere, a way out of the guide and back, a folder that is left again, two ways out, an absolute path, a double slash.
SHAPES = ["img/{}.png", "./img/./{}.png", "../{s}/img/{}.png", "sub/deep/../../img/{}.png", "../../{s}/img/{}.png", "/{s}/img/{}.png", "a/../../img/{}.png", "img//{}.png"]
_SHAPED = "case doc_id % 8 " + " ".join("when {} then {}".format(i, " || ".join(f"'{part}'" if k % 2 == 0 else {"s": "source", "": "doc_id"}[part] for k, part in enumerate(re.split("{(s?)}", shape)))) for i, shape in enumerate(SHAPES)) + " end"
_CLIMB = r"""regexp_replace({0}, '(^|/)[^/.][^/]*/\.\./', '\1')"""


@register(
    "resolved_images",
    f"""with r as (select doc_id, source, {_SHAPED} as original from documents where source is not null),
  w as (select *, case when original like '/%' then null else regexp_replace(regexp_replace(source || '/' || original, '/(\\./)+', '/', 'g'), '/+', '/', 'g') end as p from r),
  c as (select *, {_CLIMB.format(_CLIMB.format(_CLIMB.format('p')))} as q from w),
  a as (select distinct source || '/img/' || doc_id || '.png' as asset from documents where doc_id % 3 <> 0)
  select doc_id, original, asset from c left join a on c.q = a.asset and c.q like c.source || '/%'""",
)
def resolved_images(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("source is not null")
    references = docs.select("doc_id", F.col("source").alias("guide"), F.expr(_SHAPED).alias("original"))
    assets = docs.where("doc_id % 3 <> 0").select(F.format_string("%s/img/%d.png", "source", "doc_id").alias("asset"))
    return guides.resolve_images(references, assets).select("doc_id", "original", "asset")


# Marks around a document's own facts, of a kind that its number names; what is shown has the style's letters before each segment.
MARKED = ["**{0} {1}** {2}", "*{0} **{1}*** {2}", "`{0} *{1}*` [{2} **x**](u)", "**{0} {1} *{2}", "\\\\*{0}\\\\* ***{1}*** ![{2}](i.png)", "[*{0}*](a(b) 'c') _{1}_x {2}"]
STYLED = ["b:{0} {1}|: {2}", "i:{0} |bi:{1}|: {2}", "c:{0} *{1}*|: {2} |b:x|: (u)", ":**{0} {1} *{2}", ":*{0}* |bi:{1}|: ", "i:{0}|: (a(b)) _{1}_x {2}"]


def _by_kind(shapes: list[str], facts: list[str]) -> str:
    spelled = lambda shape: " || ".join(facts[int(p)] if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(re.split(r"\{([0-9])\}", shape)))
    return "case doc_id % 6 " + " ".join(f"when {i} then {spelled(shape)}" for i, shape in enumerate(shapes)) + " end"


_FACTS = ["source", "lang", "doc_id"]


@register("inline_segments", f"select doc_id, {_by_kind(STYLED, _FACTS)} as shown from documents where source is not null and lang is not null")
def inline_segments(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("source is not null and lang is not null")
    style = lambda s: F.concat(*[F.when(s[k], n).otherwise("") for k, n in (("bold", "b"), ("italic", "i"), ("code", "c"))], F.lit(":"), s["text"])
    found = inline.segments_of(F.expr(_by_kind(MARKED, _FACTS)))
    return rows.select("doc_id", F.array_join(F.transform(found, style), "|").alias("shown"))


PAGES_MARKED = ["# {0}\n\n{1}\nmore\n\n> - {2}\n>   in", "3. {0}\n4. {1}\n   - {2}\n5. end", "```\n- {0}\n\n{1}\n```\n{2}", "{0}\n===\n    {1}\n\n- \n- {2}", "> {0}\n{1}\n\n* * *\n{2}", "- {0}\n\n  {1}\n+ ![{2}](x)\n+ last"]
PAGES_SHOWN = ["{1} more|- {2} in", "3. {0}|4. {1}|- {2}|5. end", "- {0}|{1}|{2}", "{1}|- {2}", "{0} {1}|{2}", "- {0}|{1}|- last"]


@register("page_lines", f"select doc_id, {_by_kind(PAGES_SHOWN, _FACTS)} as shown from documents where source is not null and lang is not null")
def page_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("source is not null and lang is not null")
    return rows.select("doc_id", F.array_join(inline.lines_of(F.expr(_by_kind(PAGES_MARKED, _FACTS))), "|").alias("shown"))
