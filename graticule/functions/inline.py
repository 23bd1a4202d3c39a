"""Inline segments of a Markdown paragraph, and the plain lines of a page.

Inline: a scan finds escapes, code spans, line breaks, brackets and runs of `*` and `_`. Runs go on a stack of delimiters; a
closing run takes the nearest opening run that fits it, by the rules of flanking and of three, and what it can't use stays
text. A closing bracket with an address makes a link of the nearest open bracket, and settles the runs inside it first.

Blocks: a stack of containers (quotes and list items) is matched line by line. What is kept of a page are the texts of its
paragraphs, with their mark where they begin a list item, and the lines of its code; headings, rules, tables of contents and
blocks of HTML that stand by themselves as headings do say nothing.

An address is taken as it's written, with one level of brackets in it; entities stay as they are. Both run a text at a time,
in time that follows its length but for runs and brackets that stay open.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"\\\n|\\[!-/:-@\[-`{-~]|`+|!\[|\[|\]|\*+|_+| *\n *|[^\\`!\[\]*_\n ]+|(?s:.)")
_ADDRESS = re.compile(r"""\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\<]|\\.|\((?:[^\s()\\]|\\.)*\))(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*)?)(?:\s+(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)""")
_ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")


@dataclass
class _Part:
    """A piece of a paragraph: text, code, a break, a run of delimiters, or a bracket that may become a link."""

    kind: str
    text: str = ""
    left: int = 0  # of a run: what is still text
    size: int = 0
    opens: bool = False
    closes: bool = False
    before: list[str] = field(default_factory=list)  # marks that end at a run, the inner ones first
    after: list[str] = field(default_factory=list)  # marks that begin at it, the inner ones first


def _flanks(char: str, before: str, after: str) -> tuple[bool, bool]:
    """Whether a run between two characters can open and close."""
    blank = lambda c: not c or c.isspace()
    mark = lambda c: bool(c) and not c.isalnum() and not c.isspace()
    left = not blank(after) and (not mark(after) or blank(before) or mark(before))
    right = not blank(before) and (not mark(before) or blank(after) or mark(after))
    if char == "*":
        return left, right
    return left and (not right or mark(before)), right and (not left or mark(after))


def _settle(runs: list[_Part]) -> None:
    """Pair closing runs with the nearest opening ones; the list is what is on the stack."""
    at = 0
    while at < len(runs):
        closer = runs[at]
        if not closer.closes or not closer.left:
            at += 1
            continue
        for back in range(at - 1, -1, -1):
            opener = runs[back]
            third = (opener.closes or closer.opens) and (opener.size + closer.size) % 3 == 0 and (opener.size % 3 or closer.size % 3)
            if opener.opens and opener.left and opener.text[0] == closer.text[0] and not third:
                many = 2 if opener.left >= 2 and closer.left >= 2 else 1
                opener.after.append("strong" if many == 2 else "em")
                closer.before.append("strong" if many == 2 else "em")
                opener.left -= many
                closer.left -= many
                del runs[back + 1 : at]  # what lies between can't pair any more
                at = back + 1
                break
        else:
            at += 1


def _parts(text: str) -> list[_Part]:
    parts: list[_Part] = []
    runs: list[_Part] = []
    brackets: list[tuple[int, int, bool]] = []  # place among the parts and on the stack of runs, and whether a link may begin there
    at = 0
    while at < len(text):
        found = _TOKEN.match(text, at).group()
        at += len(found)
        if found == "\\\n" or "\n" in found and found.startswith("  "):
            parts.append(_Part("hard"))
            at += len(text[at:]) - len(text[at:].lstrip(" ")) if found == "\\\n" else 0
        elif "\n" in found:
            parts.append(_Part("soft"))
        elif len(found) == 2 and found[0] == "\\":
            parts.append(_Part("text", found[1]))
        elif found[0] == "`":
            close = next((m for m in re.finditer("`+", text[at:]) if len(m.group()) == len(found)), None)
            if close:
                code = text[at : at + close.start()].replace("\n", " ")
                if len(code) > 2 and code[0] == code[-1] == " " and code.strip():
                    code = code[1:-1]
                parts.append(_Part("code", code))
                at += close.end()
            else:
                parts.append(_Part("text", found))
        elif found[0] in "*_":
            opens, closes = _flanks(found[0], text[at - len(found) - 1 : at - len(found)] if at > len(found) else "", text[at : at + 1])
            run = _Part("run", found, len(found), len(found), opens, closes)
            parts.append(run)
            runs.append(run)
        elif found in ("[", "!["):
            brackets.append((len(parts), len(runs), True))
            parts.append(_Part("text", found))
        elif found == "]" and brackets:
            place, depth, active = brackets.pop()
            address = _ADDRESS.match(text, at) if active else None
            if not address:
                parts.append(_Part("text", found))
                continue
            at = address.end()
            inside = runs[depth:]
            del runs[depth:]
            _settle(inside)
            if parts[place].text == "![":
                del parts[place:]
                continue
            parts[place] = _Part("link")
            parts.append(_Part("end", _ESCAPED.sub(r"\1", address.group(1) or address.group(2) or "")))
            brackets = [(p, d, parts[p].text == "![") for p, d, _ in brackets]  # no link in a link
        else:
            parts.append(_Part("text", found))
    _settle(runs)
    return parts


def inline_segments(text: str) -> list[dict[str, object]]:
    """Text with its style: (text, bold, italic, code), neighbours of one style joined. A link's address follows its text in
    brackets, images are left out, and a line break of either kind is a segment `\\n`."""
    out: list[dict[str, object]] = []
    style = {"strong": False, "em": False}

    def say(words: str, code: bool = False, plain: bool = False) -> None:
        now = {"bold": style["strong"] and not plain and not code, "italic": style["em"] and not plain and not code, "code": code}
        if words and out and words != "\n" != out[-1]["text"] and all(out[-1][k] == v for k, v in now.items()):
            out[-1]["text"] += words
        elif words:
            out.append({"text": words, **now})

    for part in _parts(text):
        if part.kind in ("soft", "hard"):
            say("\n")
        elif part.kind == "run":
            for name in part.before:
                style[name] = False
            say(part.text[0] * part.left)
            for name in part.after:
                style[name] = True
        elif part.kind == "end":
            say(f" ({part.text})" if part.text else "", plain=True)
        elif part.kind != "link":
            say(part.text, code=part.kind == "code")
    return out


def inline_text(text: str) -> str:
    """A paragraph's plain words: no marks, no addresses, no images; a soft break is a blank."""
    shown = {"soft": " ", "hard": "\n", "link": "", "end": ""}
    return "".join(p.text[0] * p.left if p.kind == "run" else shown.get(p.kind, p.text) for p in _parts(text))


_ITEM = re.compile(r"( {0,3})([-+*]|(\d{1,9})[.)])( {1,4}(?! )|(?= {5})| *$|\t)")
_RULE = re.compile(r" {0,3}(?:(?:\* *){3,}|(?:- *){3,}|(?:_ *){3,})$")
_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")


@dataclass
class _Container:
    """A quote, or a list item: where its contents begin, its list, and whether its mark is still to be shown."""

    indent: int = -1
    list: dict | None = None
    first: bool = True


def page_lines(markdown: str) -> list[str]:
    """The lines of a page's paragraphs and code, in order."""
    out: list[str] = []
    open_: list[_Container] = []
    words: list[str] = []
    fence, fenced_in = "", 0

    def close() -> None:
        said = inline_text("\n".join(words)).strip()
        words.clear()
        item = next((c for c in reversed(open_) if c.list), None)
        if said and item and item.first:
            item.first = False
            mark = "-" if item.list["index"] is None else f"{item.list['index']}."
            item.list["index"] = None if item.list["index"] is None else item.list["index"] + 1
            said = f"{mark} {said}"
        if said:
            out.append(said)

    for line in [x.expandtabs(4) for x in markdown.splitlines()]:
        rest, held = line, 0
        for container in open_:  # which of the open containers go on
            if container.list is None:
                found = re.match(r" {0,3}> ?", rest)
                if not found:
                    break
                rest = rest[found.end() :]
            elif not rest.strip():
                rest = ""
            elif len(rest) - len(rest.lstrip(" ")) >= container.indent:
                rest = rest[container.indent :]
            else:
                break
            held += 1
        if fence and held >= fenced_in:
            if re.fullmatch(rf" {{0,3}}{re.escape(fence[0])}{{{len(fence)},}} *", rest):
                fence = ""
            elif rest.strip():
                out.append(rest)
            continue
        fence = ""
        ended = open_[held:]
        last = ended[0].list if ended and ended[0].list else None
        fresh: list[_Container] = []
        while True:  # containers that begin on this line
            quote, item = re.match(r" {0,3}> ?", rest), _ITEM.match(rest)
            if quote:
                fresh.append(_Container())
                rest, last = rest[quote.end() :], None
            elif item and not _RULE.match(rest) and not (words and held == len(open_) and not fresh and (not rest[item.end() :].strip() or item.group(3) not in (None, "1"))):
                kind = item.group(2)[-1]
                same = last is not None and last["mark"] == kind
                listed = last if same else {"mark": kind, "index": int(item.group(3)) if item.group(3) else None}
                blank = not rest[item.end() :].strip() or not item.group(4).strip(" ") == "" or item.group(4) == ""
                fresh.append(_Container(item.end() + (1 if blank and item.group(4) == "" else 0), listed))
                rest, last = rest[item.end() :], None
            else:
                break
        bare = rest.strip()
        begins = bool(fresh) or _RULE.match(rest) or _FENCE.match(rest) or re.match(r" {0,3}#{1,6}(?: |$)", rest)
        if ended and words and bare and not begins:  # a paragraph goes on without its containers' marks
            words.append(bare)
            continue
        if ended or fresh or not bare:
            close()
        del open_[held:]
        open_ += fresh
        if not bare:
            continue
        if words and re.fullmatch(r" {0,3}(?:=+|-+) *", rest):  # the paragraph was a heading
            words.clear()
        elif _RULE.match(rest) or re.match(r" {0,3}#{1,6}(?: |$)", rest):
            close()
        elif found := _FENCE.match(rest):
            close()
            fence, fenced_in = found.group(1), len(open_)
        elif not words and rest.startswith("    "):
            out.append(rest[4:])
        else:
            words.append(bare if not rest.endswith("  ") else bare + "  ")
    close()
    return out


SEGMENTS = T.ArrayType(T.StructType().add("text", T.StringType()).add("bold", T.BooleanType()).add("italic", T.BooleanType()).add("code", T.BooleanType()))


@F.pandas_udf(SEGMENTS)
def segments_of(text: pd.Series) -> pd.Series:
    """inline_segments as a column function."""
    return text.map(lambda t: None if t is None else inline_segments(t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def lines_of(markdown: pd.Series) -> pd.Series:
    """page_lines as a column function."""
    return markdown.map(lambda t: None if t is None else page_lines(t))
