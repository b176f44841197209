"""Text of HTML and Markdown, and question-answer pairs of FAQ pages, with the standard library's parser over Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.text import col

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6".split())


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def all(self):
        for child in self.children:
            if isinstance(child, Node):
                yield child
                yield from child.all()

    def strings(self):
        for child in self.children:
            if isinstance(child, Node):
                yield from child.strings()
            else:
                yield child

    def find(self, tag: str, **attrs: str) -> Node | None:
        return next((n for n in self.all() if n.tag == tag and all(v in (n.attrs.get(k), *n.attrs.get(k, "").split()) for k, v in attrs.items())), None)

    def text(self, separator: str = "", strip: bool = False) -> str:
        found = [s.strip() if strip else s for s in self.strings()]
        return separator.join(s for s in found if s or not strip)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        if self.at.children and isinstance(self.at.children[-1], str):
            self.at.children[-1] += data
        else:
            self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def html_text(html: str | None) -> str:
    """Strings joined by newlines; a break is one, and one closes each block; runs of three become two."""
    if not isinstance(html, str):
        return ""
    root = parse(html)
    for node in root.all():
        if node.tag == "br":
            node.children = ["\n"]
        elif node.tag in _BLOCKS:
            node.children.append("\n")
    return re.sub("\n{3,}", "\n\n", root.text("\n")).strip()


_INLINE = [(r"!\[([^\]]*)\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", r"<a>\1</a>"), (r"(\*\*|__)(?=\S)(.+?)\1", r"<b>\2</b>"), (r"(?<!\w)[*_](?=\S)(.+?)[*_](?!\w)", r"<i>\1</i>"), (r"`([^`]+)`", r"<code>\1</code>")]


def markdown_html(text: str) -> str:
    """The common part of Markdown as HTML: headings, lists, quotes, fences, emphasis, links and code."""
    out, held, kind = [], [], ""

    def close() -> None:
        nonlocal held, kind
        if held:
            out.append(f"<p>{chr(10).join(held)}</p>" if not kind else f"<{kind}>{''.join(f'<li>{h}</li>' for h in held)}</{kind}>")
        held, kind = [], ""

    fenced = False
    for line in text.split("\n"):
        if line.startswith("```"):
            close()
            fenced = not fenced
            continue
        if fenced:
            out.append(f"<code>{line}</code>")
            continue
        for old, new in _INLINE:
            line = re.sub(old, new, line)
        if not line.strip():
            close()
        elif m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", line):
            close()
            out.append(f"<h{len(m[1])}>{m[2]}</h{len(m[1])}>")
        elif m := re.match(r"\s*(?:([-*+])|\d+[.)])\s+(.*)", line):
            own = "ul" if m[1] else "ol"
            if kind != own:
                close()
            kind = own
            held.append(m[2])
        else:
            line = re.sub(r"^\s*>\s?", "", line)
            if kind:
                held[-1] += "\n" + line.strip()
            else:
                held.append(line)
    close()
    return "\n".join(out)


def markdown_text(text: str) -> str:
    return parse(markdown_html(text)).text("\n")


def faq_pairs(html: str) -> list[dict]:
    """Question and answer of every button that opens a panel with a card body."""
    root, out = parse(html), []
    for button in root.all():
        if button.tag != "button" or button.attrs.get("data-toggle") != "collapse":
            continue
        target = button.attrs.get("data-target", "")
        panel = root.find("div", id=target[1:]) if target.startswith("#") else None
        body = panel.find("div", **{"class": "card-body"}) if panel else None
        question = button.text(strip=True).strip()
        answer = body.text(" ", strip=True) if body else ""
        if question and answer:
            out.append({"question": question, "answer": answer})
    return out


def next_page(html: str, number: int) -> str | None:
    """The link to the page after ``number``: by its number, or by a word or sign for next."""
    block = parse(html).find("div", **{"class": "pagination-block"})
    found = None
    for link in block.all() if block else ():
        if link.tag == "a":
            text = link.text(strip=True)
            if text.isdigit():
                if int(text) == number + 1:
                    return link.attrs.get("href")
            elif "next" in text.lower() or "»" in text:
                found = link.attrs.get("href")
    return found


def _apply(kind: str, f):
    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(f)

    return run


def html_text_column(c: Column | str) -> Column:
    return _apply("string", html_text)(col(c))


def markdown_text_column(c: Column | str) -> Column:
    return _apply("string", lambda v: v if v is None else markdown_text(v))(col(c))


def faq_column(c: Column | str) -> Column:
    """array<struct<question, answer>>."""
    return _apply("array<struct<question:string,answer:string>>", lambda v: faq_pairs(v or ""))(col(c))


def next_page_column(c: Column | str, number: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series, numbers: pd.Series) -> pd.Series:
        return pd.Series([next_page(p or "", n) for p, n in zip(pages, numbers)], dtype=object)

    return run(col(c), col(number))
