"""HTML to rows: nodes in document order, text lines, and CSS selectors over them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions import parsec as P
from tidemark.plans.model import InvalidInput
from tidemark.session import ready

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NODES = "node_id int, parent_id int, sibling int, depth int, kind string, tag string, attrs map<string,string>, text string"


#: Start tags that end an open element: of these names, if it is open below none of those.
_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_TABLE = frozenset(["table"])
IMPLIED = {
    **{t: (frozenset(["p"]), frozenset(["button", "td", "th", "caption", "body"])) for t in _P},
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])), "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th"]), _TABLE), "th": (frozenset(["td", "th"]), _TABLE), "tr": (frozenset(["tr"]), _TABLE),
    **{t: (frozenset(["thead", "tbody", "tfoot", "tr"]), _TABLE) for t in ("thead", "tbody", "tfoot")},
}


@dataclass(eq=False)
class Element:
    """A node; place is its number among all children of its parent, nth among the tags and nth_type among those of its name, from 1."""

    id: int
    parent: Element | None
    kind: str  # doc, tag, text, comment, doctype
    tag: str = ""
    attrs: dict[str, str] = field(default_factory=dict)
    text: str = ""
    children: list[Element] = field(default_factory=list)
    depth: int = 0
    place: int = 0
    nth: int = 0
    nth_type: int = 0
    before: Element | None = None
    tags: int = 0
    names: dict[str, int] = field(default_factory=dict)


class _Builder(HTMLParser):
    """Unbalanced tags are tolerated: a start tag ends what it implies the end of, an end tag closes up to the nearest open one of its name, or is ignored."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.all: list[Element] = []
        self.open: list[Element] = [self._add("doc", None)]
        # How many elements of each name are open, so that most tags needn't look through them.
        self.count: dict[str, int] = {}

    def _add(self, kind: str, parent: Element | None, **more) -> Element:
        e = Element(len(self.all), parent, kind, **more)
        self.all.append(e)
        if parent is not None:
            e.depth, e.place = parent.depth + 1, len(parent.children)
            if kind == "tag":
                parent.tags += 1
                parent.names[e.tag] = parent.names.get(e.tag, 0) + 1
                e.nth, e.nth_type = parent.tags, parent.names[e.tag]
                k = len(parent.children) - 1
                while k >= 0 and parent.children[k].kind != "tag":
                    k -= 1
                e.before = parent.children[k] if k >= 0 else None
            parent.children.append(e)
        return e

    def _close(self, k: int) -> None:
        for e in self.open[k:]:
            self.count[e.tag] -= 1
        del self.open[k:]

    def handle_starttag(self, tag, attrs):
        ends, within = IMPLIED.get(tag, ((), ()))
        if any(self.count.get(x) for x in ends):
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag in ends:
                    self._close(k)
                    break
                if self.open[k].tag in within:
                    break
        e = self._add("tag", self.open[-1], tag=tag, attrs={k: "" if v is None else v for k, v in attrs})
        if tag not in VOID:
            self.open.append(e)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self._add("tag", self.open[-1], tag=tag, attrs={k: "" if v is None else v for k, v in attrs})

    def handle_endtag(self, tag):
        if self.count.get(tag):
            self._close(next(k for k in range(len(self.open) - 1, 0, -1) if self.open[k].tag == tag))

    def handle_data(self, data):
        self._add("text", self.open[-1], text=data)

    def handle_comment(self, data):
        self._add("comment", self.open[-1], text=data)

    def handle_decl(self, decl):
        self._add("doctype", self.open[-1], text=decl)

    def unknown_decl(self, data):
        # <![CDATA[...]]> is text.
        if data.startswith("CDATA["):
            self._add("text", self.open[-1], text=data[6:])


def parse(html: str) -> list[Element]:
    """All nodes in document order, the document first; in time linear in the text, however deep or wide it is."""
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.all


def node_rows(html: str) -> Iterator[tuple]:
    for e in parse(html):
        yield e.id, e.parent.id if e.parent else None, e.place, e.depth, e.kind, e.tag or None, e.attrs, e.text or None


def inside(e: Element) -> Iterator[Element]:
    """A node and all below it, in document order."""
    stack = [e]
    while stack:
        e = stack.pop()
        yield e
        stack += reversed(e.children)


def lines(html: str) -> list[str]:
    """Text of the body (of the whole where there is none), each text node trimmed, blank ones left out; scripts and styles aren't text."""
    every = parse(html)
    body = next((e for e in every if e.tag == "body"), every[0])
    return [t for e in inside(body) if e.kind == "text" and e.parent.tag not in ("script", "style") and (t := e.text.strip())]


# -- selectors --


@dataclass
class Simple:
    """Conditions on one element, and how it is joined to the one before: ' ', '>', '+', '~' or ''."""

    joint: str
    tag: str = "*"
    tests: list[tuple] = field(default_factory=list)


_WORD = r"-?[A-Za-z_\u0080-￿][\w\u0080-￿-]*"
_ident = P.regex(_WORD, "name")
_value = P.choice(P.regex(r'"[^"]*"', "quoted"), P.regex(r"'[^']*'", "quoted"), P.regex(_WORD + r"|\d+", "bare"))
_ws = P.maybe(P.regex(r"\s+", "ws"))
_attr = P.sequence("attr", P.atom("["), _ws, _ident, _ws, P.maybe(P.sequence("test", P.literals("op", "~=", "^=", "$=", "|=", "*=", "="), _ws, _value, _ws)), P.atom("]"))
_pseudo = P.sequence("pseudo", P.atom(":"), _ident, P.maybe(P.sequence("argument", P.atom("("), P.regex(r"[^()]+", "text"), P.atom(")"))))
_part = P.choice(P.sequence("class", P.atom("."), _ident), P.sequence("id", P.atom("#"), _ident), _attr, _pseudo)
_head = P.choice(P.atom("*", "any"), P.renamed(_ident, "tag"))
_simple = P.choice(P.sequence("simple", _head, P.kleene(_part, "parts")), P.sequence("simple", P.many(_part, "parts")))
_joint = P.choice(P.regex(r"\s*[>+~]\s*", "joint"), P.regex(r"\s+", "joint"))
_selector = P.kleene(_simple, "selector", _joint, 1)
PSEUDO = ("root", "empty", "first-child", "last-child", "only-child", "first-of-type", "last-of-type", "only-of-type", "nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type", "enabled", "disabled", "checked", "lang", "link")


def selector(text: str) -> list[list[Simple]]:
    """A list of alternatives, each a chain of conditions."""
    out = []
    for part in text.split(","):
        try:
            tree = P.parse_full(_selector, part.strip())
        except P.ParseError as e:
            raise InvalidInput(f"no selector: {text!r}: {e}") from e
        chain, joint = [], ""
        for node in tree.children:
            if node.name == "joint":
                joint = node.token.strip() or " "
                continue
            s = Simple(joint)
            for c in node.children:
                if c.name == "tag":
                    s.tag = c.token.lower()
                for p in c.children:
                    if p.name in ("class", "id"):
                        s.tests.append((p.name, p.children[1].token))
                    elif p.name == "attr":
                        test = p.children[4].children
                        value = test[0].children[2].token if test else None
                        if value and value[0] in "\"'":
                            value = value[1:-1]
                        s.tests.append(("attr", p.children[2].token.lower(), test[0].children[0].token if test else None, value))
                    elif p.name == "pseudo":
                        name, given = p.children[1].token.lower(), p.children[2].children
                        if name not in PSEUDO:
                            raise InvalidInput(f"no pseudo-class {name}")
                        s.tests.append(("pseudo", name, given[0].children[1].token.strip() if given else None))
            chain.append(s)
        out.append(chain)
    return out


def _attr_fits(have: str | None, op: str | None, want: str | None) -> bool:
    if have is None:
        return False
    if op is None:
        return True
    return {
        "=": have == want,
        "~=": bool(want) and want in have.split(),
        "^=": bool(want) and have.startswith(want),
        "$=": bool(want) and have.endswith(want),
        "*=": bool(want) and want in have,
        "|=": have == want or have.startswith(f"{want}-"),
    }[op]


def _nth(k: int, rule: str) -> bool:
    rule = {"odd": "2n+1", "even": "2n"}.get(rule.replace(" ", ""), rule.replace(" ", ""))
    found = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", rule)
    if not found:
        raise InvalidInput(f"no nth rule: {rule}")
    if found[3]:
        return k == int(found[3])
    a = int(found[1] + "1") if found[1] in ("", "+", "-") else int(found[1])
    b = int(found[2] or 0)
    return k == b if a == 0 else (k - b) % a == 0 and (k - b) // a >= 0


def _fits(e: Element, s: Simple) -> bool:
    if e.kind != "tag" or s.tag not in ("*", e.tag):
        return False
    for kind, name, *more in s.tests:
        if kind == "class" and name not in e.attrs.get("class", "").split():
            return False
        if kind == "id" and e.attrs.get("id") != name:
            return False
        if kind == "attr" and not _attr_fits(e.attrs.get(name), *more):
            return False
        if kind == "pseudo":
            alike = name.endswith("of-type")
            at = e.nth_type if alike else e.nth
            size = e.parent.names[e.tag] if alike else e.parent.tags
            ok = {
                "root": lambda: e.parent.kind == "doc",
                "empty": lambda: not [c for c in e.children if c.kind in ("tag", "text")],
                "first-child": lambda: at == 1, "first-of-type": lambda: at == 1, "last-child": lambda: at == size, "last-of-type": lambda: at == size,
                "only-child": lambda: size == 1, "only-of-type": lambda: size == 1,
                "nth-child": lambda: _nth(at, more[0] or ""), "nth-of-type": lambda: _nth(at, more[0] or ""),
                "nth-last-child": lambda: _nth(size + 1 - at, more[0] or ""), "nth-last-of-type": lambda: _nth(size + 1 - at, more[0] or ""),
                "enabled": lambda: "disabled" not in e.attrs and e.tag in ("button", "input", "select", "textarea", "option", "fieldset"),
                "disabled": lambda: "disabled" in e.attrs, "checked": lambda: "checked" in e.attrs or "selected" in e.attrs,
                "link": lambda: e.tag == "a" and "href" in e.attrs, "lang": lambda: _lang(e, more[0] or ""),
            }[name]()
            if not ok:
                return False
    return True


def _lang(e: Element | None, want: str) -> bool:
    while e is not None:
        if "lang" in e.attrs:
            return _attr_fits(e.attrs["lang"].lower(), "|=", want.lower())
        e = e.parent
    return False


def _chain(every: list[Element], chain: list[Simple]) -> list[bool]:
    """Which nodes end the chain; one pass in document order for each part of it, as parents and earlier siblings come first."""
    n = len(every)
    fit = [_fits(e, chain[0]) for e in every]
    for s in chain[1:]:
        held = [False] * n  # whether the part before fits an ancestor, or an earlier sibling
        out = [False] * n
        for k, e in enumerate(every):
            from_ = e.parent if s.joint in (" ", ">") else e.before
            if from_ is None:
                continue
            reach = fit[from_.id]
            if s.joint in (" ", "~"):
                reach = held[k] = reach or held[from_.id]
            out[k] = reach and _fits(e, s)
        fit = out
    return fit


def select(html: str, css: str) -> list[Element]:
    """Elements that a selector names, in document order."""
    every = parse(html)
    found = [_chain(every, c) for c in selector(css)]
    return [e for e in every if any(f[e.id] for f in found)]


def content(e: Element) -> str:
    return "".join(x.text for x in inside(e) if x.kind == "text")


# -- tables --


def _explode(rows: DataFrame, key: str, column: str, schema: str, each) -> DataFrame:
    """Rows of each(text), column by column in Arrow batches of bounded size."""
    ready(rows.sparkSession)
    out = T.StructType([rows.schema[key], *T._parse_datatype_string(schema).fields])

    def run(batches):
        kinds = to_arrow_schema(out)

        def batch(found):
            return pa.RecordBatch.from_arrays([pa.array([list(x.items()) for x in c] if isinstance(f.dataType, T.MapType) else c, kinds.field(k).type) for k, (f, c) in enumerate(zip(out.fields, zip(*found)))], names=out.names)

        held: list[tuple] = []
        for b in batches:
            for k, t in zip(b.column("_k").to_pylist(), b.column("_t").to_pylist()):
                held += [(k, *r) for r in each(t or "")]
                if len(held) >= 1 << 14:
                    yield batch(held)
                    held = []
        if held:
            yield batch(held)

    return rows.select(F.col(key).alias("_k"), F.col(column).alias("_t")).mapInArrow(run, out)


def html_nodes(rows: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    return _explode(rows, key, column, NODES, node_rows)


def html_text_lines(rows: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    return _explode(rows, key, column, "line int, text string", lambda t: enumerate(lines(t)))


def html_select(rows: DataFrame, css: str, key: str = "page_id", column: str = "html") -> DataFrame:
    """(key, node_id, tag, attrs, text) of the elements that a selector names."""
    selector(css)
    return _explode(rows, key, column, "node_id int, tag string, attrs map<string,string>, text string", lambda t: ((e.id, e.tag, e.attrs, content(e)) for e in select(t, css)))


def register(spark) -> None:
    """Table functions for SQL: html_nodes(html), html_text_lines(html), html_select(html, css)."""

    class Nodes:
        def eval(self, html: str):
            yield from node_rows(html)

    class Lines:
        def eval(self, html: str):
            yield from enumerate(lines(html))

    class Select:
        def eval(self, html: str, css: str):
            for e in select(html, css):
                yield e.id, e.tag, e.attrs, content(e)

    for name, cls, schema in (("html_nodes", Nodes, NODES), ("html_text_lines", Lines, "line int, text string"), ("html_select", Select, "node_id int, tag string, attrs map<string,string>, text string")):
        spark.udtf.register(name, F.udtf(cls, returnType=schema))
