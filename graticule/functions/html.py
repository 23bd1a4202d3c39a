"""HTML pages to Markdown, and tables of contents to heading paths, with the standard library's parser.

A parser is a state machine over a whole page, so this runs in a vectorised pandas function, a page at a time.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = {"p", "div", "table", "tr", "ul", "ol", "li", "section", "article", "header", "footer", "nav", "main", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "body"}


class Node:
    """An element: name, attributes and children (nodes or strings)."""

    def __init__(self, name: str, attrs: dict[str, str] | None = None):
        self.name, self.attrs, self.children = name, attrs or {}, []

    def walk(self):
        for child in self.children:
            if isinstance(child, Node):
                yield child
                yield from child.walk()

    def has_class(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()

    def text(self, seam: str = " ") -> str:
        """Stripped strings below this node, joined."""
        out: list[str] = []

        def add(node: Node) -> None:
            for child in node.children:
                if isinstance(child, Node):
                    add(child)
                elif child.strip():
                    out.append(child.strip())

        add(self)
        return seam.join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def note_kind(icon: str) -> str:
    """Kind of a note box by its icon's name; the more severe wins."""
    low = icon.lower()
    return next((k for k in ("Caution", "Warning", "Tip", "Note") if k.lower() in low), "Note")


def _shown(alt: str, source: str) -> str:
    return f"![{alt}]({source})"


def _image(node: Node, local: Callable[[str, str], str]) -> str:
    """An image: embedded ones as their description, those with an address as they are, others as `local` has them."""
    source, alt = node.attrs.get("src", "").strip(), node.attrs.get("alt", "").strip()
    if not source or source.startswith("data:"):
        return f"[Image: {alt}]" if source and alt else ""
    return _shown(alt, source) if source.startswith("http") else local(source.removeprefix("./"), alt)


def _render(node: Node, local: Callable[[str, str], str], depth: int = 0, ordered: bool = False) -> str:
    parts: list[str] = []
    number = 0
    for child in node.children:
        if isinstance(child, str):
            parts.append(re.sub(r"[ \t\r\n]+", " ", child))
            continue
        name = child.name
        if name in ("script", "style"):
            continue
        if name == "table" and child.has_class("hs-box"):
            icon = next((n.attrs.get("src", "") for n in child.walk() if n.name == "img"), "")
            content = next((n for n in child.walk() if n.name == "td" and n.has_class("hs-box-content")), child)
            parts.append(f"\n\n**{note_kind(icon)}:** {content.text()}\n\n")
        elif name == "img":
            parts.append(_image(child, local))
        elif name == "br":
            parts.append("  \n")
        elif re.fullmatch("h[1-6]", name):
            title = re.sub(r"\s+", " ", _render(child, local, depth)).strip()
            parts.append(f"\n\n{'#' * int(name[1])} {title}\n\n" if title else "")
        elif name in ("ul", "ol"):
            parts.append("\n\n" * (depth == 0) + _render(child, local, depth + 1, name == "ol") + "\n" * (depth == 0))
        elif name == "li":
            number += 1
            body = _render(child, local, depth).strip()
            body = re.sub(r"\n+", "\n", body)
            mark = f"{number}." if ordered else "*"
            parts.append(f"\n{'  ' * max(depth - 1, 0)}{mark} {body}")
        elif name in ("strong", "b", "em", "i", "code"):
            mark = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}[name]
            body = _render(child, local, depth).strip()
            parts.append(f"{mark}{body}{mark}" if body else "")
        elif name == "a":
            body, href = _render(child, local, depth).strip(), child.attrs.get("href", "")
            parts.append(f"[{body}]({href})" if href and body else body)
        elif name == "pre":
            parts.append(f"\n\n```\n{child.text(chr(10))}\n```\n\n")
        elif name == "tr":
            cells = [c for c in child.children if isinstance(c, Node) and c.name in ("td", "th")]
            parts.append("\n| " + " | ".join(re.sub(r"\s+", " ", _render(c, local, depth)).strip() for c in cells) + " |")
            if cells and all(c.name == "th" for c in cells):
                parts.append("\n|" + " --- |" * len(cells))
        elif name in _BLOCK:
            parts.append(f"\n\n{_render(child, local, depth).strip()}\n\n")
        else:
            parts.append(_render(child, local, depth))
    return "".join(parts)


def _markdown(root: Node, title: str, local: Callable[[str, str], str]) -> str:
    main = next((n for n in root.walk() if n.attrs.get("id") == "mainbody"), None) or next((n for n in root.walk() if n.name == "body"), None)
    body = _render(main or root, local).replace("\u00a0", " ")
    body = "\n".join(x.rstrip() if not x.endswith("  ") else x for x in body.split("\n"))
    return re.sub(r"\n{3,}", "\n\n", f"# {title}\n\n{body.strip()}".strip() + "\n")


def html_to_markdown(html: str, title: str) -> str:
    """A page's main part (`#mainbody`, else body, else all) as Markdown under its title.

    Scripts and styles are dropped, note boxes become paragraphs, embedded images their description; three and more line
    breaks become two.
    """
    return _markdown(parse(html), title, lambda source, alt: _shown(alt, source))


def html_page(html: str, name: str) -> tuple[str, list[str], list[tuple[str, str]]]:
    """Title (`#pagetitle`, else `name`), Markdown in parts, and the local images (address without a leading `./`, description)
    that stand between the parts, whose addresses aren't known yet."""
    root = parse(html.replace("\0", ""))
    named = next((n for n in root.walk() if n.attrs.get("id") == "pagetitle"), None)
    title = named.text() if named else name
    images: list[tuple[str, str]] = []

    def local(source: str, alt: str) -> str:
        images.append((source, alt))
        return f"\0{len(images) - 1}\0"

    pieces = re.split("\0([0-9]+)\0", _markdown(root, title, local))
    return title, pieces[::2], [images[int(i)] for i in pieces[1::2]]


def toc_paths(html: str, doc_title: str) -> dict[str, list[str]]:
    """Heading path by link target from a guide's contents page.

    An entry's level is the number of blank leading cells of width 10, plus one; it may be one deeper than the entry
    before at most.
    """
    out: dict[str, list[str]] = {}
    stack: list[str] = []
    for table in (n for n in parse(html).walk() if n.name == "table" and n.has_class("TableOfContents")):
        entry = next((n for n in table.walk() if n.name == "a" and n.has_class("__tocentry")), None)
        href = entry.attrs.get("href", "").split("#", 1)[0] if entry else ""
        name = entry.text() if entry else ""
        if not href or not name:
            continue
        level = 1
        for cell in (n for n in table.walk() if n.name == "td"):
            if cell.attrs.get("width") != "10" or cell.text(""):
                break
            level += 1
        del stack[min(level, len(stack) + 1) - 1 :]
        stack.append(name)
        out[href] = [doc_title, *stack]
    return out


@F.pandas_udf(StringType())
def markdown_of(html: pd.Series, title: pd.Series) -> pd.Series:
    """html_to_markdown as a column function."""
    return pd.Series([html_to_markdown(h or "", t or "") for h, t in zip(html, title, strict=True)])


PAGE = StructType().add("title", StringType()).add("parts", ArrayType(StringType())).add("images", ArrayType(StructType().add("original", StringType()).add("alt", StringType())))


@F.pandas_udf(PAGE)
def page_of(html: pd.Series, name: pd.Series) -> pd.DataFrame:
    """html_page as a column function."""
    made = [html_page(h or "", n or "") for h, n in zip(html, name, strict=True)]
    return pd.DataFrame({"title": [t for t, _, _ in made], "parts": [p for _, p, _ in made], "images": [[{"original": s, "alt": a} for s, a in i] for _, _, i in made]})


@F.pandas_udf(MapType(StringType(), ArrayType(StringType())))
def paths_of(html: pd.Series, title: pd.Series) -> pd.Series:
    """toc_paths as a column function."""
    return pd.Series([toc_paths(h or "", t or "") for h, t in zip(html, title, strict=True)])


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility normalisation, which has no built-in function."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def admonitions(markdown: str) -> str:
    """Quoted `[!KIND]` notes as fenced `::: kind` blocks; code fences are left alone."""
    out: list[str] = []
    code, note = False, False
    for line in markdown.splitlines():
        if note:
            quoted = re.match(r"\s*>\s?", line)
            if quoted:
                out.append(line[quoted.end() :])
                continue
            out.append(":::")
            note = False
        if line.strip().startswith("```"):
            code = not code
        found = None if code else re.match(r"\s*>\s*\[!(TIP|INFO|WARNING|NOTE)\]\s*(.*)$", line, re.IGNORECASE)
        if found:
            out.append(f"::: {found.group(1).lower()} {found.group(2).strip()}".rstrip())
            note = True
        else:
            out.append(line)
    return "\n".join([*out, ":::"] if note else out)


@F.pandas_udf(StringType())
def admonitions_of(markdown: pd.Series) -> pd.Series:
    """admonitions as a column function."""
    return markdown.map(lambda m: None if m is None else admonitions(m))
