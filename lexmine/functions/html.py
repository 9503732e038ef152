"""Main-content text of an HTML page, as built-in expressions.

Rule: try the selectors ``article``, ``main``, ``[role="main"]``, ``.content``, ``.post-content``, ``body`` in
order; take the *first* element matching each; its text is every descendant text node joined by a space with
whitespace runs collapsed; an empty text moves on to the next selector; no text at all gives ``''``.

The page becomes an array of tokens (comments, tags with their attributes, elements whose content is raw, text), cut
by one regular expression.  The tags are folded over a stack of open elements (:func:`_step`) that follows the
HTML rules for end tags without an element, end tags that close others with them, and start tags that end a
``p``, ``li``, ``dd``, ``dt``, ``option``, table part, heading, ``a`` or ``button``.  What comes out is one range of
tokens per selector; the text of a range is decoded only if the selectors before it gave none.

Pages with one plain ``article`` need no fold: :func:`plain_article` takes its text by expressions on the whole page
and gives null for every page that could differ.

Defined results: a null page has a null text here; ``head`` and ``body`` are implied where their tags are missing;
content after ``</body>`` or ``</html>`` still belongs to the open elements; a tag cut off by the end of the page is
dropped; ignored tags do not split a text.  Text that stands directly in a table stays where it is written.
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmine.functions import text as T

# The selectors, in order of preference.
SELECTORS = ("article", "main", '[role="main"]', ".content", ".post-content", "body")
BODY = len(SELECTORS) - 1

# Element groups of the HTML standard.
RAW = ("script", "style", "xmp", "iframe", "noembed", "noframes", "noscript", "textarea", "title")
DECODED_RAW = ("textarea", "title")
VOID = ("area", "base", "basefont", "bgsound", "br", "col", "embed", "frame", "hr", "img", "input", "keygen", "link",
        "meta", "param", "source", "track", "wbr")
IN_HEAD = ("base", "basefont", "bgsound", "link", "meta", "title", "noscript", "noframes", "style", "script", "template", "head", "html")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
FORMATTING = ("a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u")
BLOCKS = ("address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset",
          "figcaption", "figure", "footer", "form", "header", "hgroup", "listing", "main", "menu", "nav", "ol", "pre",
          "search", "section", "summary", "ul")
ENDS_P = BLOCKS + HEADINGS + ("p", "hr", "xmp", "plaintext", "table", "li", "dd", "dt")
SCOPE = ("applet", "caption", "html", "table", "td", "th", "marquee", "object", "template", "svg", "math")
TABLE_PARTS = ("caption", "colgroup", "col", "tbody", "thead", "tfoot", "tr", "td", "th")
SPECIAL = BLOCKS + HEADINGS + SCOPE[:9] + (
    "p", "li", "dd", "dt", "body", "head", "button", "frameset", "select", "tbody", "thead", "tfoot", "tr", "colgroup", "textarea",
    "title", "script", "style", "iframe", "noscript", "xmp", "noembed", "noframes")

# Bits of the groups that a name belongs to; one lookup a tag, bit tests after that.
GROUPS = {
    "special": SPECIAL, "scope": SCOPE, "list": SCOPE + ("ol", "ul"), "table": ("table", "template"), "heading": HEADINGS,
    "formatting": FORMATTING, "block": BLOCKS, "part": TABLE_PARTS, "ends_p": ENDS_P, "void": VOID, "foreign": ("svg", "math"),
    "far": tuple(x for x in SPECIAL if x not in ("address", "div", "p")), "raw": RAW, "in_head": IN_HEAD,
    "listed": BLOCKS + HEADINGS + FORMATTING + SCOPE + TABLE_PARTS + ("p", "li", "dd", "dt", "button"),
    "root": ("html", "head", "body", "frameset"), "button_scope": SCOPE + ("button",),
}
BIT = {g: 1 << k for k, g in enumerate(GROUPS)}
BITS = {n: sum(BIT[g] for g, names in GROUPS.items() if n in names) for n in sorted({n for names in GROUPS.values() for n in names})}

ATTRIBUTES = r"(?:=\s*\"[^\"]*\"|=\s*'[^']*'|=|[^>=]++)*+>"
TOKEN = (
    r"(?is)<!--(?:>|->|.*?(?:--!?>|\z))"
    r"|<(" + "|".join(RAW) + r")(?=[\s/>])" + ATTRIBUTES + r".*?(?:(?=</\1[\s/>])|\z)"
    r"|<plaintext(?=[\s/>])[^>]*>.*\z"
    r"|</?[a-z]" + ATTRIBUTES + r"|</?[a-z][^>]*\z|<[!?/][^>]*>|[^<]++|<"
)
NAME = r"^</?([A-Za-z][^\s/>]*)"
ATTRIBUTE = r"[\s/]([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?"

# Code points that stand for others when written as numbers: the names of windows-1252.
NUMBERS = {n: bytes([n]).decode("cp1252") for n in range(128, 160) if n not in (129, 141, 143, 144, 157)}
ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)|[^&]++|&"
# Names of the standard, from the language's own table; those that need no semicolon stand without one.
NAMED = {k: v for k, v in html.entities.html5.items() if k.endswith(";")}
BARE = sorted((k for k in html.entities.html5 if not k.endswith(";")), key=lambda k: (-len(k), k))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _table(values: dict, kind: str = "string") -> Column:
    """A constant map (folded once per plan)."""
    return F.from_json(F.lit(json.dumps(values)), f"map<string,{kind}>")


def _code_point(n: Column) -> Column:
    """The character of a code point; U+FFFD for those that are none."""
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    bad = (n <= 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    return F.when(bad, F.lit("�")).when(n.between(128, 159), F.coalesce(F.element_at(_table({str(k): v for k, v in NUMBERS.items()}), n.cast("string")), char)).otherwise(char)


def _reference(piece: Column) -> Column:
    """Text of one character reference; a piece that is none stays."""
    digits = F.regexp_extract(piece, r"^&#[xX]?([0-9a-fA-F]+)", 1)
    wide = F.length(F.ltrim(digits, F.lit("0"))) > 8
    number = F.when(wide, F.lit(-1)).when(piece.rlike("^&#[xX]"), F.conv(digits, 16, 10).cast("long")).otherwise(digits.cast("long"))
    whole, part = _table(NAMED), _table({k: html.entities.html5[k] for k in BARE})
    prefix = F.regexp_extract(piece, "^&(" + "|".join(BARE) + ")", 1)
    return (
        F.when(piece.isin("&amp;", "&AMP;"), F.lit("&"))
        .when(piece.startswith("&#"), _code_point(number))
        .when(piece.endswith(";") & F.element_at(whole, F.substring(piece, 2, 64)).isNotNull(), F.element_at(whole, F.substring(piece, 2, 64)))
        .when(prefix != "", F.concat(F.element_at(part, prefix), _after(piece, prefix)))
        .otherwise(piece)
    )


def _after(piece: Column, prefix: Column) -> Column:
    """What follows ``&prefix`` in ``piece``."""
    return piece.substr(F.length(prefix) + 2, F.length(piece))


def decode_references(text: Column) -> Column:
    """``text`` with its character references decoded, each once (``&amp;lt;`` gives ``&lt;``)."""
    pieces = F.regexp_extract_all(text, F.lit(ENTITY), 0)
    done = F.transform(pieces, lambda p: F.when(p.startswith("&") & (F.length(p) > 1), _reference(p)).otherwise(p))
    return F.when(text.contains("&"), F.array_join(done, "")).otherwise(text)


def _attribute(tag: Column, name: str) -> Column:
    """Value of the first attribute ``name`` of a start tag; null without one."""
    rest = F.regexp_replace(tag, NAME, "")
    pairs = F.filter(F.regexp_extract_all(rest, F.lit(ATTRIBUTE), 0), lambda a: F.lower(F.regexp_extract(a, ATTRIBUTE, 1)) == name)
    return _let(F.get(pairs, 0), lambda a: F.when(a.isNotNull(), decode_references(
        F.concat(*(F.regexp_extract(a, ATTRIBUTE, k) for k in (2, 3, 4))))))


def _mask(name: Column, tag: Column) -> Column:
    """Bits of the selectors (without ``body``) that a start tag matches."""
    words = F.split(F.coalesce(_attribute(tag, "class"), F.lit("")), r"[ \t\n\f\r]+")
    by_class = _let(words, lambda w: F.when(F.array_contains(w, "content"), 8).otherwise(0) + F.when(F.array_contains(w, "post-content"), 16).otherwise(0))
    return (
        F.when(name == "article", 1).otherwise(0) + F.when(name == "main", 2).otherwise(0)
        + F.when(tag.rlike(r"(?i)[\s/]role"), F.when(_attribute(tag, "role") == "main", 4).otherwise(0)).otherwise(0)
        + F.when(tag.rlike(r"(?i)[\s/]class"), by_class).otherwise(0)
    )


def _kind(token: Column) -> Column:
    """s start tag, e end tag, r raw element, c comment, x dropped, t text."""
    return (
        F.when(~token.startswith("<") | (token == "<"), "t")
        .when(token.rlike(r"^</[A-Za-z]"), F.when(token.endswith(">"), "e").otherwise("x"))
        .when(token.rlike(r"(?i)^<(?:" + "|".join(RAW) + r"|plaintext)[\s/>]"), "r")
        .when(token.rlike(r"^<[A-Za-z]"), F.when(token.endswith(">"), "s").otherwise("x"))
        .when(token.rlike(r"(?i)^<!doctype") | (token == "</>"), "x")
        .when(token.rlike(r"^<[!?/]"), "c")
        .otherwise("t")
    )


def _of(e: Column, *groups: str) -> Column:
    """An element or tag belongs to one of the groups."""
    return e["g"].bitwiseAND(F.lit(sum(BIT[g] for g in groups))) > 0


def _last(stack: Column, test) -> Column:
    """Position (from 1) of the last open element that passes; 0 without one."""
    return F.coalesce(F.array_max(F.transform(stack, lambda e, i: F.when(test(e), i + 1))), F.lit(0))


def _kept_by_start(stack: Column, tag: Column) -> Column:
    """How many open elements a start tag leaves open."""
    n, size = tag["n"], F.size(stack)
    top = F.get(stack, size - 1)

    def above(name, barrier) -> Column:
        """Those below the last ``name``, if no barrier stands above it."""
        return _let(F.struct(_last(stack, name).alias("a"), _last(stack, barrier).alias("b")),
                    lambda p: F.when(p["a"] > p["b"], p["a"] - 1).otherwise(size))

    table = lambda e: _of(e, "table")
    item = lambda *own: above(lambda e: e["n"].isin(*own), lambda e: _of(e, "far") & ~e["n"].isin(*own))
    own = (
        F.when(n == "li", item("li"))
        .when(n.isin("dd", "dt"), item("dd", "dt"))
        .when(n.isin("td", "th"), above(lambda e: e["n"].isin("td", "th", "caption"), table))
        .when(n == "tr", above(lambda e: e["n"].isin("tr", "caption"), table))
        .when(n.isin("tbody", "thead", "tfoot"), above(lambda e: e["n"].isin("tbody", "thead", "tfoot", "caption"), table))
        .when(n.isin("option", "optgroup") & (top["n"] == "option"), size - 1)
        .when(n == "button", above(lambda e: e["n"] == "button", lambda e: _of(e, "scope")))
        .when(n == "a", above(lambda e: e["n"] == "a", lambda e: _of(e, "special")))
        .when(_of(tag, "heading") & _of(top, "heading"), size - 1)
        .otherwise(size)
    )
    return F.when(_of(tag, "ends_p"), F.least(own, above(lambda e: e["n"] == "p", lambda e: _of(e, "button_scope")))).otherwise(own)


def _step(state: Column, tag: Column) -> Column:
    """One tag on ``(stack, done, drop, found)``.

    ``stack``: open elements (n name, g groups, m selectors that it is the first for, i token); ``done``: ranges of
    closed ones with a selector; ``drop``: tokens of ignored tags; ``found``: selectors met.
    """
    stack, n = state["stack"], tag["n"]
    size = F.size(stack)
    ranges = lambda closed: F.transform(F.filter(closed, lambda e: e["m"] > 0), lambda e: F.struct(e["m"].alias("m"), e["i"].alias("a"), tag["i"].alias("b")))

    def cut(keep: Column, push: Column, dropped: Column) -> Column:
        """The state with the elements from ``keep`` on closed."""
        fresh = tag["m"].bitwiseAND(F.lit(-1) - state["found"])
        opened = F.array(F.struct(n.alias("n"), tag["g"].alias("g"), fresh.alias("m"), tag["i"].alias("i")))
        return F.struct(
            F.concat(F.slice(stack, 1, keep), F.when(push, opened).otherwise(F.slice(stack, 1, 0))).alias("stack"),
            F.concat(state["done"], ranges(F.slice(stack, keep + 1, F.greatest(size - keep, F.lit(0))))).alias("done"),
            F.when(dropped, F.concat(state["drop"], F.array(tag["i"]))).otherwise(state["drop"]).alias("drop"),
            state["found"].bitwiseOR(F.when(push, tag["m"]).otherwise(0)).alias("found"))

    no, yes = F.lit(False), F.lit(True)
    outside = _of(tag, "part") & (_last(stack, lambda e: _of(e, "table")) == 0)
    foreign = tag["c"] & (_last(stack, lambda e: _of(e, "foreign")) > 0)
    start = F.when(_of(tag, "root") | outside, cut(size, no, yes)).otherwise(
        _let(_kept_by_start(stack, tag), lambda keep: cut(keep, ~_of(tag, "void") & ~foreign, no)))

    def end_with(p: Column) -> Column:
        at = p["at"]
        barred = (
            F.when(n == "table", F.lit(False)).when(_of(tag, "part"), p["table"] > at).when(n == "p", p["button"] > at)
            .when(n == "li", p["list"] > at).when(_of(tag, "listed"), p["scope"] > at).otherwise(p["special"] > at)
        )
        # a formatting element that holds an open block ends, the block does not
        without = F.struct(F.filter(stack, lambda e, i: i + 1 != at).alias("stack"), F.concat(state["done"], ranges(F.slice(stack, at, 1))).alias("done"),
                           state["drop"].alias("drop"), state["found"].alias("found"))
        return (
            F.when((at > 0) & ~barred, F.when(_of(tag, "formatting") & (p["special"] > at), without).otherwise(cut(at - 1, no, no)))
            .otherwise(cut(size, no, ~n.isin("p", "br") & ~_of(tag, "raw")))
        )

    places = F.struct(
        _last(stack, lambda e: (e["n"] == n) | (_of(tag, "heading") & _of(e, "heading"))).alias("at"),
        _last(stack, lambda e: _of(e, "scope") & (e["n"] != n)).alias("scope"),
        _last(stack, lambda e: _of(e, "button_scope")).alias("button"), _last(stack, lambda e: _of(e, "list")).alias("list"),
        _last(stack, lambda e: _of(e, "table")).alias("table"), _last(stack, lambda e: _of(e, "special") & (e["n"] != n)).alias("special"))
    end = F.when(n.isin("body", "html"), cut(size, no, yes)).otherwise(_let(places, end_with))
    return F.when(tag["k"] == "s", start).otherwise(end)


STATE = "struct<stack:array<struct<n:string,g:int,m:int,i:int>>,done:array<struct<m:int,a:int,b:int>>,drop:array<int>,found:int>"


def _ranges(tokens: Column) -> Column:
    """(ranges, drop): for each selector the tokens ``a`` < i < ``b`` of its first element (null without one)."""
    size = F.size(tokens)
    # the body opens at the first token that cannot stand in or before the head
    opens = F.coalesce(F.array_min(F.transform(tokens, lambda t: F.when(
        ((t["k"] == "t") & t["x"].rlike(r"[^ \t\n\f\r]"))
        | (t["k"].isin("s", "r") & ~_of(t, "in_head")) | ((t["k"] == "e") & t["n"].isin("body", "html", "br")), t["i"]))), size)
    tags = lambda at: F.filter(tokens, lambda t: t["k"].isin("s", "e") & (t["i"] >= at))
    folded = lambda at: F.aggregate(tags(at), F.expr(
        f"cast(named_struct('stack', array(), 'done', array(), 'drop', array(), 'found', 0) as {STATE})"), _step)

    def finished(p: Column) -> Column:
        left = F.transform(F.filter(p["s"]["stack"], lambda e: e["m"] > 0), lambda e: F.struct(e["m"].alias("m"), e["i"].alias("a"), size.alias("b")))
        found = F.concat(p["s"]["done"], left)

        def of(bit: int) -> Column:
            root = lambda name, start: _let(  # noqa: E731  html and body tags that match themselves
                F.get(F.filter(tokens, lambda t: (t["k"] == "s") & (t["n"] == name)), 0),
                lambda t: F.when(t["m"].bitwiseAND(F.lit(bit)) > 0, F.struct(start.alias("a"), size.alias("b"))))
            inner = _let(F.get(F.filter(found, lambda r: r["m"].bitwiseAND(F.lit(bit)) > 0), 0),
                         lambda r: F.when(r.isNotNull(), F.struct(r["a"].alias("a"), r["b"].alias("b"))))
            return F.coalesce(root("html", F.lit(-1)), root("body", p["at"] - 1), inner) if bit >= 4 else inner

        whole = F.struct((p["at"] - 1).alias("a"), size.alias("b"))
        return F.struct(F.array(*[of(1 << k) for k in range(BODY)], whole).alias("ranges"), p["s"]["drop"].alias("drop"))

    return _let(opens, lambda at: _let(F.struct(at.alias("at"), folded(at).alias("s")), finished))


def tokens(page: Column) -> Column:
    """Tokens of a page: (i, k kind, n name, x token, m selectors, c closed by a slash)."""
    def one(x: Column, i: Column) -> Column:
        return _let(F.struct(x.alias("x"), _kind(x).alias("k")), lambda t: F.struct(
            i.alias("i"), t["k"].alias("k"), F.when(t["k"].isin("s", "e", "r"), F.lower(F.regexp_extract(t["x"], NAME, 1))).otherwise("").alias("n"),
            t["x"].alias("x")))

    groups = _table(BITS, "int")

    def marked(t: Column) -> Column:
        tag = t["k"] == "s"
        return F.struct(t["i"].alias("i"), t["k"].alias("k"), t["n"].alias("n"), t["x"].alias("x"), F.coalesce(F.element_at(groups, t["n"]), F.lit(0)).alias("g"),
                        F.when(tag, _mask(t["n"], t["x"])).otherwise(0).alias("m"), (tag & t["x"].endswith("/>")).alias("c"))

    return F.transform(F.transform(F.regexp_extract_all(page, F.lit(TOKEN), 0), one), marked)


def _text_between(all_tokens: Column, drop: Column, a: Column, b: Column) -> Column:
    """Collapsed text of the tokens strictly between ``a`` and ``b``; adjacent text is one node, other tokens part it."""
    raw = lambda t: F.regexp_replace(t["x"], r"(?s)^<[A-Za-z]" + ATTRIBUTES, "")
    piece = lambda t: (
        F.when(t["k"] == "t", t["x"])
        .when(t["k"] == "r", F.concat(F.lit(" "), F.when(t["n"].isin(*DECODED_RAW), raw(t)).otherwise(F.replace(raw(t), F.lit("&"), F.lit("&amp;"))), F.lit(" ")))
        .when((t["k"] == "x") | F.array_contains(drop, t["i"]), F.lit(""))
        .otherwise(F.lit(" ")))
    joined = F.array_join(F.transform(F.slice(all_tokens, F.greatest(a, F.lit(-1)) + 2, F.greatest(b - a - 1, F.lit(0))), piece), "")
    return T.collapse_ws(decode_references(joined))


def folded_text(page: Column) -> Column:
    """Main text by the fold over all tags."""
    def chosen(p: Column) -> Column:
        return F.aggregate(p["r"]["ranges"], F.lit(""), lambda text, r: F.when((text != "") | r.isNull(), text).otherwise(
            _text_between(p["t"], p["r"]["drop"], r["a"], r["b"])))

    return _let(_let(tokens(page), lambda t: F.struct(t.alias("t"), _ranges(t).alias("r"))), chosen)


# Names whose end tags may reach an element outside the article, and whose presence needs the fold.
REACHING = "|".join(BLOCKS + ("h[1-6]", "li", "dd", "dt", "button"))
NEEDS_FOLD = "|".join(SCOPE + TABLE_PARTS + RAW + ("select", "option", "plaintext", "frameset", "html", "head", "body"))
UNPLAIN = (
    r"(?is)(?=[<&=])(?:</?(?:" + NEEDS_FOLD + r")[\s/>]|<!(?!--)|<\?|<(?![a-zA-Z/!])|</(?![a-zA-Z])"
    r"|=\s*\"[^\">]*>|=\s*'[^'>]*>|<!--(?:-?>|[^>]*--!>)|<[a-zA-Z][^>]*<|(?<=[^\s>])(?:</[a-zA-Z][^>]*>)++(?=[^\s<]))"
)
UNPLAIN_BEFORE = (
    r"(?is)(?=<)(?:<!--(?!.*?-->)|<!--(?:-?>|[^>]*--!>)|<(" + "|".join(RAW) + r")[\s/>](?!.*?</\1[\s/>])"
    r"|<(?:select|svg|math|template|frameset|plaintext|table|object|applet|marquee)[\s/>]|<[a-zA-Z/!?][^>]*\z)"
)


def plain_article(page: Column) -> Column:
    """Text of the page's only ``article`` where no rule of the fold can matter; null otherwise."""
    def text(p: Column) -> Column:
        before, region = p["before"], p["region"]
        stripped = F.regexp_replace(F.regexp_replace(region, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
        reach = F.arrays_overlap(F.regexp_extract_all(F.lower(before), F.lit(rf"<({REACHING})[\s/>]"), 1),
                                 F.regexp_extract_all(F.lower(region), F.lit(rf"</({REACHING})[\s/>]"), 1))
        sound = ~region.rlike(UNPLAIN) & ~before.rlike(UNPLAIN_BEFORE) & ~reach
        return F.when(sound, F.nullif(T.collapse_ws(decode_references(stripped)), F.lit("")))

    marks = F.regexp_extract_all(page, F.lit(r"(?i)</?article"), 0)
    one = (F.size(marks) == 2) & (F.lower(F.get(marks, 0)) == "<article") & (F.lower(F.get(marks, 1)) == "</article")
    found = page.rlike(ARTICLE)
    return F.when(one & found, _let(F.struct(F.regexp_extract(page, ARTICLE, 1).alias("before"), F.regexp_extract(page, ARTICLE, 2).alias("region")), text))


ARTICLE = r"(?is)\A(.*?)<article(?:\s(?:[^>\"'=]|=\s*\"[^\">]*\"|=\s*'[^'>]*'|=)*)?>(.*?)</article\s*>"


def main_text(page: Column) -> Column:
    """Main text of a page (null in, null out; ``''`` when no selector has text)."""
    return F.when(page.isNotNull(), F.coalesce(plain_article(page), folded_text(page)))


def page_title(page: Column) -> Column:
    """Text of ``<title>`` ('' when absent)."""
    return T.collapse_ws(decode_references(F.regexp_extract(page, r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>", 1)))
