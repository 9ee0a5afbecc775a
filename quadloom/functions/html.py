"""Rewriting links in HTML, and local addresses of public ones."""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Which attribute of which element is a link.
LINKS = {"a": "href", "img": "src"}
#: Elements whose content is no markup, and what ends it.
RAW = {name: re.compile(rf"</{name}(?=[\t\n\f\r />])", re.I) for name in ("script", "style")}
_NAME, _IS = r"[^\t\n\f\r />=]++", r"[\t\n\f\r ]*+=[\t\n\f\r ]*+"
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|(?!["'])[^\t\n\f\r >]*+)"""
#: The name, and the value with its quotes.
ATTRIBUTE = re.compile(f"({_NAME})(?:{_IS}({_VALUE}))?+")
#: The < of a comment, declaration, instruction or end tag, or a start tag up to its >: the name and the rest.
MARKUP = re.compile(rf"<(?:[!?/]|([A-Za-z][^\t\n\f\r />]*+)((?:[\t\n\f\r /]++|{_NAME}(?:{_IS}{_VALUE})?+)*+))")
#: A reference in an attribute; a name before = is part of an address.
REFERENCE = re.compile(r"&(?:#(?:[0-9]++|[xX][0-9a-fA-F]++);?+|([A-Za-z][A-Za-z0-9]*+(?:;|(?!=))))")


def _decoded(value: str) -> str:
    return REFERENCE.sub(lambda m: html5.get(m[1], m[0]) if m[1] else html.unescape(m[0]), value)


def _replaced(written: str, replace: Callable[[str], str]) -> str:
    """The attribute value ``written`` after ``replace``, in quotes; an & that stands for itself stays so where it can."""
    value = written[1:-1] if written[:1] in ("'", '"') else written
    plain = _decoded(value)
    out = replace(plain)
    if plain != value or _decoded(out) != out:
        out = out.replace("&", "&amp;")
    return '"' + out.replace('"', "&quot;") + '"'


def _start_tag(name: str, rest: str, replace: Callable[[str], str]) -> tuple[str, bool]:
    """A start tag of a void element or one with links, written anew, and whether it ends its element too."""
    attributes = list(ATTRIBUTE.finditer(rest))
    last = attributes[-1] if attributes else None
    closed = rest.endswith("/") and (last is None or last.end() < len(rest))
    if name in VOID and not closed:
        # an unquoted value would take the slash
        rest += " /" if last and last.end() == len(rest) and last[2] and last[2][0] not in "'\"" else "/"
    link = next((m for m in attributes if m[1].lower() == LINKS.get(name)), None)
    if link:
        rest = f"{rest[: link.start()]}{LINKS[name]}={_replaced(link[2] or '', replace)}{rest[link.end() :]}"
    return f"<{name}{rest}>", closed


def replace_links(source: str, replace: Callable[[str], str]) -> str:
    """``source`` with ``a href`` and ``img src`` passed through ``replace``; only the first such attribute of a tag.

    Void elements get a slash.  All else stays as written: text with its
    references, whether or not a semicolon ends them, comments, declarations,
    instructions, scripts and styles, other tags.
    """
    out: list[str] = []
    done = at = 0
    comment = source.rfind("-->")
    while m := MARKUP.search(source, at):
        at = m.end()
        if not m[1]:
            closing = "-->" if source.startswith("!--", at - 1) and at <= comment else ">"
            end = source.find(closing, at)
            if end < 0:
                break
            at = end + len(closing)
            continue
        if at == len(source):
            break
        at += 1
        name = m[1].lower()
        # where a quote is never closed the tag is text, and what comes next may be markup
        if source[at - 1] != ">" or not (name in VOID or name in LINKS or name in RAW):
            continue
        tag, closed = _start_tag(name, m[2], replace)
        if name not in RAW:
            out += (source[done : m.start()], tag)
            done = at
        elif not closed:
            end = RAW[name].search(source, at)
            at = end.start() if end else len(source)
    out.append(source[done:])
    return "".join(out)


def replace_links_column(source: Column, replace: Callable[[str], str]) -> Column:
    """``replace_links`` in Arrow batches; null stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: replace_links(t, replace), na_action="ignore")

    return run(source)


def local_url(url: Column, prefixes: list[str]) -> Column:
    """The address without scheme and host if it starts with one of ``prefixes``; else unchanged."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | url.startswith(p)
    return F.when(hit, F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")).otherwise(url)
