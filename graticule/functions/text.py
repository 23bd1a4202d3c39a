"""Text operators as Column expressions. Nothing here runs Python per row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a token. After lower-casing, the dotless i and the long s also fold to ASCII letters.
TOKEN = "[a-z0-9ıſ]+"

# Words that don't count when a query is compared with headings.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "do", "does", "for", "from", "how", "i", "in", "is", "it",
    "new", "of", "on", "or", "the", "to", "what", "when", "where", "which", "with", "you",
]

# Typographic characters and their ASCII forms.
ASCII_FORMS = {
    "\u00a0": " ",
    "\u2007": " ",
    "\u2009": " ",
    "\u200b": "",
    "\u2010": "-",
    "\u2011": "-",
    "\u2012": "-",
    "\u2013": "-",
    "\u2014": "--",
    "\u2015": "--",
    "\u2212": "-",
    "\u2026": "...",
    "\u2018": "'",
    "\u2019": "'",
    "\u201c": '"',
    "\u201d": '"',
    "\u00b7": "*",
    "\u2022": "*",
    "\u2190": "<-",
    "\u2192": "->",
    "\u2194": "<->",
    "\u21d0": "<=",
    "\u21d2": "=>",
    "\u21d4": "<=>",
}

# Typed arrows and their symbols, the longer ones first.
ARROWS = {"<=>": "⇔", "<->": "↔", "=>": "⇒", "<=": "⇐", "->": "→", "<-": "←"}

# Characters replaced before embedding.
EMBED_FORMS = {"’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "..."}

#: Words of a text that are put into a bag at a step.
WORDS = 48

#: White space that is stripped and split at: ASCII blanks, the information separators, and the wide ones.
BLANK = r"[\t\n\x0B\f\r\x1C-\x1F \x85\xA0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same characters, one by one.
BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Where a text breaks into lines.
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\x{2028}\x{2029}]"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then(value)`, with the value bound as a lambda's variable: it is computed once, however often `then` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-cased ASCII letter and digit runs, in order; an empty list for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    """Number of tokens, without building them."""
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN)).cast("long")


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.trim(text, F.lit(BLANKS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(text, f"{BLANK}{{2,}}|(?! ){BLANK}", " "))  # a single blank stays as it is


def lines(text: Column) -> Column:
    """Lines of a text; a final line break opens no further line, and an empty text has no lines."""
    whole = F.split(F.regexp_replace(text, LINE_BREAK, "\n"), "\n")
    return once(whole, lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def replace_each(text: Column, table: dict[str, str]) -> Column:
    """The replacements of a table, one after the other."""
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), table.items(), text)


def slugify(text: Column) -> Column:
    """Lower case with runs of other characters as single hyphens; `untitled` if nothing is left."""
    slug = F.regexp_replace(F.lower(strip(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(slug, "^-+|-+$", ""), F.lit("")), F.lit("untitled"))


def safe_slug(text: Column) -> Column:
    """Case-preserving identifier; `item` if nothing is left."""
    slug = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), "[^a-zA-Z0-9_-]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(slug, "^-+|-+$", ""), F.lit("")), F.lit("item"))


def table_cells(line: Column) -> Column:
    """Cells of a table row, stripped."""
    return F.transform(F.split(F.regexp_replace(strip(line), r"^\|+|\|+$", ""), r"\|"), strip)


def flatten_tables(text: Column) -> Column:
    """Table rows as plain lines: cells joined by ` - `, separator and empty rows dropped, other lines as they are."""

    def row(line: Column) -> Column:
        cells = table_cells(line)
        filled = F.filter(F.transform(cells, lambda c: squeeze(F.replace(c, F.lit("**"), F.lit("")))), lambda c: c != "")
        bare = strip(F.regexp_replace(strip(line), r"^\|+|\|+$", "")) == ""
        rule = F.forall(cells, lambda c: c.rlike("^[-:]*$"))
        joined = F.array_join(filled, " - ")
        return F.when(~F.contains(line, F.lit("|")), line).when(bare | rule | (F.size(filled) == 0), F.lit(None)).otherwise(joined)

    return F.array_join(F.filter(F.transform(lines(text), row), lambda x: x.isNotNull()), "\n")


def prepare_for_embedding(text: Column, max_chars: int = 448, normalise: Callable[[Column], Column] | None = None) -> Column:
    """Text as an embedding model gets it. `normalise` is the compatibility normalisation (functions.html.nfkc), for which
    there is no built-in function."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\u0000"), F.lit(" "))
    out = normalise(out) if normalise else out
    out = F.replace(F.replace(out, F.lit("\xa0"), F.lit(" ")), F.lit("\\*"), F.lit("*"))
    out = replace_each(out, EMBED_FORMS)
    out = F.regexp_replace(out, r"(?m)^([ \t]*)###([ \t]+)", "$1##$2")
    out = F.replace(flatten_tables(out), F.lit("*"), F.lit(""))
    out = strip(F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " "))
    return F.substring(out, 1, max_chars) if max_chars > 0 else out


def bag_of_words(text: Column, max_chars: int = 420) -> Column:
    """Distinct words in first-seen spelling and order, until their joined length reaches a bound."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))
    apart = lambda x: F.concat(F.lit(" "), F.lower(x), F.lit(" "))

    def add(bag: Column, word: Column) -> Column:
        # the bag is its own record of what was seen: it is bounded, and words hold no blank
        return F.when((F.length(bag) >= max_chars) | F.contains(apart(bag), apart(word)), bag).when(bag == "", word).otherwise(F.concat(bag, F.lit(" "), word))

    def some(bag: Column, first: Column, words: Column) -> Column:
        # once the bag is full, the words left are passed over in steps
        return F.when(F.length(bag) >= max_chars, bag).otherwise(F.aggregate(F.slice(words, first, WORDS), bag, add))

    steps = lambda words: F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(WORDS))
    return once(words, lambda words: F.aggregate(steps(words), F.lit(""), lambda bag, first: some(bag, first, words)))


def embedding_fallbacks(prepared: Column) -> Column:
    """Fallback variants of a prepared text, in the order in which they are tried, as (name, text) structs."""
    return once(prepared, lambda text: once(_forms(text), lambda forms: _fallbacks(text, forms)))


def _forms(prepared: Column) -> Column:
    ink = BLANK.replace("[", "[^", 1)
    long_lines = F.array_join(F.filter(lines(prepared), lambda x: x.rlike(f"(?s){ink}.{{10,}}{ink}")), "\n")  # 12 characters, stripped
    return F.struct(F.regexp_replace(prepared, r"[^\x00-\x7F]", "").alias("ascii_safe"), squeeze(prepared).alias("collapsed"), long_lines.alias("long_lines"))


def _fallbacks(prepared: Column, forms: Column) -> Column:
    ascii_safe, collapsed, long_lines = forms["ascii_safe"], forms["collapsed"], forms["long_lines"]
    # fixed values: truncation lengths
    cuts = [1280, 1200, 1100, 1024, 896, 832, 768, 704, 640, 576, 512, 448, 384, 320, 256]
    item = lambda name, text, when: F.when(when, F.struct(F.lit(name).alias("name"), text.alias("text")))
    variants = [
        item("base", prepared, F.lit(True)),
        item("ascii_safe", ascii_safe, ascii_safe != prepared),
        item("collapsed_ws", collapsed, (collapsed != "") & (collapsed != prepared)),
        *[item(f"truncate_{n}", F.substring(prepared, 1, n), F.length(prepared) > n) for n in cuts],
        item("drop_short_lines", long_lines, long_lines != ""),
        item("bag_of_words", bag_of_words(prepared), prepared.rlike("[A-Za-z0-9]")),
    ]
    return F.filter(F.array(*variants), lambda x: x.isNotNull())


def html_to_text(html: Column) -> Column:
    """Text of a page: scripts and styles dropped, block ends as line breaks, list items dashed, entities decoded."""
    out = F.coalesce(html, F.lit(""))
    for name in ("script", "style", "noscript"):
        out = F.regexp_replace(out, rf"(?is)<{name}\b[^>]*>.*?</{name}>", "")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?i)</(p|div|li|tr|h[1-6])\s*>", "\n")
    out = F.regexp_replace(out, r"(?i)<li\b[^>]*>", "- ")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    out = replace_each(out, {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'"})
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return strip(out)


def html_title(html: Column) -> Column:
    """Text of the title element, null if there is none or it is empty."""
    inner = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.nullif(html_to_text(inner), F.lit(""))


def strip_inline_markup(text: Column) -> Column:
    """Inline Markdown as plain text: links with their address, code, bold and italic without marks."""
    out = F.regexp_replace(text, r"\[([^\]]+)\]\(([^)]+)\)", "$1 ($2)")
    out = F.regexp_replace(out, r"`([^`]+)`", "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"\*\*(.+?)\*\*", "$1"), r"__(.+?)__", "$1")
    return F.regexp_replace(F.regexp_replace(out, r"\*([^*_]+?)\*", "$1"), r"_([^*_]+?)_", "$1")


def split_long_tokens(text: Column, most: int = 60) -> Column:
    """A blank after every `most` characters of a longer run without white space."""
    return F.regexp_replace(text, rf"(\S{{{most}}})(?=\S)", "$1 ")


def wrap_code(line: Column, most: int = 90) -> Column:
    """A line in pieces of at most `most` characters; an empty line is one piece."""
    n = F.greatest(F.ceil(F.length(line) / most), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(line, i * most + 1, F.lit(most)))


def arrows(text: Column) -> Column:
    """Typed arrows as symbols, the longest first."""
    return replace_each(text, ARROWS)


def ascii_forms(text: Column) -> Column:
    """Typographic characters in ASCII."""
    return replace_each(text, ASCII_FORMS)


def latin1_safe(text: Column) -> Column:
    """ASCII forms, and a question mark for what Latin-1 doesn't have."""
    return F.regexp_replace(ascii_forms(text), r"[^\u0000-ÿ]", "?")


def needs_unicode(text: Column) -> Column:
    """Whether a text has characters beyond Latin-1."""
    return F.coalesce(text, F.lit("")).rlike(r"[^\u0000-ÿ]")


def text_runs(text: Column) -> Column:
    """A text as runs: (text, kind), kind being plain, symbol (arrows and bullets, each by itself) or unicode."""
    found = F.regexp_extract_all(arrows(F.coalesce(text, F.lit(""))), F.lit(r"(?s)[←→↔⇐⇒⇔•]|[^\u0000-ÿ]|[\u0000-ÿ]+"), F.lit(0))
    symbol = r"^[←→↔⇐⇒⇔•]$"
    kind = lambda x: F.when(x.rlike(symbol), "symbol").when(x.rlike(r"^[^\u0000-ÿ]$"), "unicode").otherwise("plain")
    return F.transform(found, lambda x: F.struct(x.alias("text"), kind(x).alias("kind")))


def front_matter(text: Column) -> Column:
    """Struct of the block between leading `---` lines (null if there is none) and the body after it."""
    source = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\x{feff}+", "")
    block = r"(?s)^---[ \t]*\n(.*?)(?:(?<=\n)|(?<=^---\n))---[ \t]*(?:\n|$)"
    has = source.rlike(block)
    body = F.regexp_replace(F.regexp_replace(source, block, ""), r"^\n+", "")
    front = F.regexp_replace(F.regexp_extract(source, block, 1), r"\n$", "")
    return F.struct(F.when(has, front).alias("front"), F.when(has, body).otherwise(text).alias("body"))


def front_matter_fields(front: Column) -> Column:
    """Flat `key: value` lines as a map, quotes stripped; indented lines belong to the key above, as `key.child`."""
    pairs = F.filter(lines(F.coalesce(front, F.lit(""))), lambda x: x.rlike(r"^\s*[A-Za-z0-9_-]+:"))
    first = F.struct(F.lit("").alias("parent"), F.map_from_arrays(F.array(), F.array()).cast("map<string,string>").alias("found"))
    unquote = lambda v: F.regexp_replace(F.regexp_replace(v, r"""^"(.*)"$""", "$1"), r"^'(.*)'$", "$1")

    def add(state: Column, line: Column) -> Column:
        key = F.regexp_extract(line, r"^\s*([A-Za-z0-9_-]+):", 1)
        value = strip(F.regexp_extract(line, r"^\s*[A-Za-z0-9_-]+:\s*(.*)$", 1))
        child = line.rlike(r"^\s")
        name = F.when(child, F.concat(state["parent"], F.lit("."), key)).otherwise(key)
        skip = (child & (state["parent"] == "")) | (~child & (value == ""))
        parent = F.when(child, state["parent"]).when(value == "", key).otherwise(F.lit(""))
        kept = F.map_filter(state["found"], lambda k, v: k != name)
        return F.struct(parent.alias("parent"), F.when(skip, state["found"]).otherwise(F.map_concat(kept, F.create_map(name, strip(unquote(value))))).alias("found"))

    return F.aggregate(pairs, first, add, lambda s: s["found"])


# Settings of a page's front matter that name a part of the cover or of the header.
COVER_KEYS = {"guide_type": "type", "cover_type": "type", "cover_title": "title", "cover_image": "image", "cover_text": "text", "cover_version": "version", "cover_date": "date", "cover_copyright": "copyright"}
HEADER_KEYS = {"header_left": "left", "header_right": "right"}


def overrides(fields: Column, block: str, keys: dict[str, str]) -> Column:
    """Map of what the front matter sets: the entries of a block (`cover`, `headers`), then the single settings over them."""
    filled = F.map_filter(fields, lambda k, v: strip(F.coalesce(v, F.lit(""))) != "")
    inner = F.filter(F.map_entries(filled), lambda e: e["key"].startswith(f"{block}."))
    pairs = [F.transform(inner, lambda e: F.struct(F.substring(e["key"], len(block) + 2, 10_000).alias("key"), strip(e["value"]).alias("value")))]
    for name, part in keys.items():
        value = F.element_at(filled, F.lit(name))
        pairs.append(F.when(value.isNotNull(), F.array(F.struct(F.lit(part).alias("key"), strip(value).alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>")))
    every = F.concat(*pairs)
    last = F.filter(every, lambda e, i: ~F.exists(F.slice(every, i + 2, F.size(every)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def sse_event(event: Column, data: Column) -> Column:
    """One server-sent event; `data` is text or a JSON text."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.coalesce(data, F.lit("null")), F.lit("\n\n"))


def same_heading(one: Column, two: Column) -> Column:
    """Headings that differ only in case and white space; empty ones never match."""
    plain = lambda x: F.lower(squeeze(F.coalesce(x, F.lit(""))))
    return (plain(one) != "") & (plain(one) == plain(two))


def first_heading(markdown: Column) -> Column:
    """Title of the heading with which a text starts (blank lines aside), else null."""
    start = F.get(F.filter(F.transform(lines(F.coalesce(markdown, F.lit(""))), strip), lambda x: x != ""), F.lit(0))
    return F.when(start.rlike(r"^#{1,6}\s+"), strip(F.regexp_replace(start, r"^#{1,6}\s+", "")))


def is_table_rule(line: Column) -> Column:
    """Whether a line is a table's separator row."""
    return F.contains(line, F.lit("|")) & F.forall(table_cells(line), lambda c: c.rlike("^:?-{3,}:?$"))


def is_table_row(line: Column) -> Column:
    """Whether a line looks like a table row."""
    bare = strip(line)
    return bare.startswith("|") & F.contains(bare, F.lit("|")) | (bare.endswith("|")) | (F.regexp_count(bare, F.lit(r"\|")) >= 2)


def markdown_images(text: Column) -> Column:
    """Images of a text in order, as (alt, url) structs."""
    whole = r"!\[([^\]]*)\]\(([^)]+)\)"
    alts, urls = (F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(whole), F.lit(i)) for i in (1, 2))
    return F.zip_with(alts, urls, lambda a, u: F.struct(strip(a).alias("alt"), strip(u).alias("url")))


def drop_image_lines(text: Column) -> Column:
    """A text without the lines that hold an image."""
    return F.array_join(F.filter(lines(F.coalesce(text, F.lit(""))), lambda x: ~(F.contains(x, F.lit("![")) & F.contains(x, F.lit("](")))), "\n")


def image_width(source: Column) -> Column:
    """Struct of an image's address and the width given after `|`, in the query or in the fragment (unit px by default)."""
    piped = source.rlike(r"\|(?:width|w)=")
    address = F.when(piped, strip(F.regexp_extract(source, r"^([^|]*)", 1))).otherwise(strip(source))
    after = F.regexp_extract(source, r"(?i)\|\s*(?:width|w)=(.+)$", 1)
    inside = lambda part: F.coalesce(F.nullif(F.regexp_extract(part, r"(?:^|[?#&])width=([^&#]*)", 1), F.lit("")), F.regexp_extract(part, r"(?:^|[?#&])w=([^&#]*)", 1))
    query = inside(F.regexp_extract(address, r"(\?[^#]*)", 1))
    fragment = inside(F.regexp_extract(address, r"(#.*)$", 1))
    spec = strip(F.coalesce(F.nullif(F.when(piped, after).otherwise(F.lit("")), F.lit("")), F.nullif(query, F.lit("")), fragment))
    form = r"(?i)^(\d+(?:\.\d+)?)(%|px|mm|cm)?$"
    value = F.nullif(F.regexp_extract(spec, form, 1), F.lit("")).cast("double")
    unit = F.lower(F.coalesce(F.nullif(F.regexp_extract(spec, form, 2), F.lit("")), F.lit("px")))
    return F.struct(address.alias("address"), value.alias("width"), F.when(value.isNotNull(), unit).alias("unit"))


def section_marker(text: Column) -> Column:
    """Name in a `[[DOC_SECTION: name]]` marker, null without one."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)\[\[\s*DOC_SECTION\s*:\s*(.*?)\s*\]\]", 1), F.lit(""))


def render_template(template: str, values: dict[str, Column], required: tuple[str, ...] = ()) -> Column:
    """A template with `{{name}}` replaced; a required placeholder that the template lacks is an error."""
    missing = [name for name in required if f"{{{{{name}}}}}" not in template]
    if missing:
        raise ValueError(f"the template lacks {', '.join(missing)}")
    return reduce(lambda t, kv: F.replace(t, F.lit(f"{{{{{kv[0]}}}}}"), F.coalesce(kv[1].cast("string"), F.lit(""))), values.items(), F.lit(template))


def note_kind(icon: Column) -> Column:
    """Kind of a note box by its icon's name."""
    low = F.lower(F.coalesce(icon, F.lit("")))
    has = lambda word: F.contains(low, F.lit(word))
    return F.when(has("caution"), "Caution").when(has("warning"), "Warning").when(has("tip"), "Tip").otherwise("Note")


def citation_markers(answer: Column) -> Column:
    """Numbers cited as `[n]`, in order of first appearance."""
    found = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(\d+)\]"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: x.cast("long")))


def blank_to_null(text: Column) -> Column:
    """Stripped text, null if nothing is left."""
    return F.nullif(strip(F.coalesce(text, F.lit(""))), F.lit(""))
