"""Leaf blocks of an HTML page: text between block-level tags, with its ancestors.

A tolerant scanner: tags need not be closed or nested well, quotes may hold ``>``,
and a reference may lack its semicolon. Scripts, styles and other raw elements, and
the head, give no text; a head that is not closed ends where something stands that it cannot hold; formulas give what is shown of them, without annotations.
"""

import html
import re
from typing import NamedTuple

# Element names by their part in HTML.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INERT = frozenset("head template svg annotation annotation-xml object audio video canvas datalist".split())
#: What a head may hold; anything else ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: What an opening tag closes, if it is open inside the nearest listed scope.
CLOSES = {
    "li": ("li", "ul ol menu"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "option": ("option", "select datalist"),
}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}

TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"']+))")
NAMED = re.compile(r"(?i)\b(?:class|id|role|data-y)\s*=")


class Node(NamedTuple):
    tag: str
    context: object  # what ``enter`` made of the ancestors and this element


class Leaf(NamedTuple):
    text: str
    context: object
    linked: float  # share of the characters that are inside links
    tag: str  # of the nearest block-level element


def leaves(page: str, root, enter):
    """Leaf blocks in page order. ``enter(context, tag, attributes)`` gives a child's context."""
    stack = [Node("", root)]
    opened: dict[str, int] = {}
    inert = links = 0
    parts: list[str] = []
    linked = 0
    place = None
    at = 0

    def pop():
        nonlocal inert, links
        tag = stack.pop().tag
        opened[tag] -= 1
        inert -= tag in INERT
        links -= tag == "a"

    def flush():
        nonlocal linked, place
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                yield Leaf(text, place[0], min(1.0, linked / len(text)), place[1])
            parts.clear()
        linked, place = 0, None

    def add(text):
        nonlocal linked, place
        if not text:
            return
        if inert and stack[-1].tag == "head" and not text.isspace():
            pop()
        if inert:
            return
        if place is None and not text.isspace():
            k = len(stack) - 1
            while k and stack[k].tag not in BLOCK:
                k -= 1
            place = (stack[k].context, stack[k].tag)
        if place is not None:
            parts.append(text)
            if links:
                linked += len(text.strip())

    while True:
        found = TAG.search(page, at)
        if found is None:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        slash, name, rest = found.group(1, 2, 3) if found[2] else found.group(4, 5, 6)
        if name is None:
            continue
        tag = name.lower()
        if slash:
            if tag in BLOCK:
                yield from flush()
            if opened.get(tag):
                if tag not in BLOCK:
                    k = len(stack) - 1
                    while stack[k].tag != tag and stack[k].tag not in BLOCK:
                        k -= 1
                    if stack[k].tag != tag:
                        continue
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if opened.get("head") and tag not in IN_HEAD and not opened.get("template"):
            while opened["head"]:
                pop()
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            if tag in BLOCK:
                yield from flush()
            continue
        if tag in BLOCK:
            yield from flush()
            if opened.get("p"):
                while stack[-1].tag not in BLOCK:
                    pop()
                if stack[-1].tag == "p":
                    pop()
            if tag in CLOSES:
                ends, scope = CLOSES[tag]
                if any(opened.get(x) for x in ends):
                    k = len(stack) - 1
                    while k and stack[k].tag not in ends and stack[k].tag not in scope:
                        k -= 1
                    while stack[k].tag in ends:
                        while len(stack) > k:
                            pop()
                        k -= 1
            if tag == "body":
                while inert:
                    pop()
        if tag == "br":
            add(" ")
        if tag in VOID or rest.endswith("/") and tag not in BLOCK:
            continue
        attributes = {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(rest)} if rest and NAMED.search(rest) else {}
        stack.append(Node(tag, enter(stack[-1].context, tag, attributes)))
        opened[tag] = opened.get(tag, 0) + 1
        inert += tag in INERT
        links += tag == "a"
    yield from flush()
