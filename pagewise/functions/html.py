"""HTML extraction as native column expressions over a page's ``html``.

A page is cut once into tokens: a token is a tag or the text between two tags.
``names`` holds, token by token, ``<nav`` for an opening tag, ``</nav`` for a
closing one and '' for text, so elements are ranges of tokens and "inside"
means between two places of that array. Depth counts elements of one name:
an element ends at the closing tag that brings its own depth back to zero.

Every pattern is possessive and accepts whatever it has read, so no place of a
page is read again from another start: time is linear in the page, and Java's
possessive loops need no stack. The rules for odd pages:

* a tag ends at its first ``>`` outside of quoted values; quotes count only
  right after ``=`` and only if they are closed, elsewhere they are characters;
* a tag that meets ``<`` or the end of the page first ends there;
* a script, style, comment, title or region that is never closed reaches to the
  end of the page; an unclosed boilerplate element to the last closing tag of its
  name (none: it is kept);
* a heading or paragraph ends where the next one starts.

Element text follows the get-text recipe: decode entities, trim each text
piece, drop empty pieces, join (with '' for element text, ' ' for body text).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewise.functions.text import WS, ws_trim

# The entity references decoded (``&amp;`` last so it never
# double-decodes).
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
            ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
NUMERIC_RES = (r"^[xX]([0-9a-fA-F]{1,6});", r"^([0-9]{1,7});")

# What a tag holds after its name, up to the place where it ends.
INSIDE = r"(?:[^>\"'=<]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+"
TAG = rf"<[a-zA-Z/!?]{INSIDE}>?+"
TEXT = r"(?:[^<]++|<(?![a-zA-Z/!?]))++"
TOKEN_RE = rf"{TAG}|{TEXT}"
NAME_RE = r"^</?[a-zA-Z][^\s/>]*+"
COMMENT_RE = r"(?s)<!--.*?(?:-->|\z)"
SCRIPT_RE = rf"(?is)<script(?=[\s/>]){INSIDE}(?:>(.*?)(?:</script\s*+>|\z))?+"
STYLE_RE = rf"(?is)<style(?=[\s/>]){INSIDE}(?:>(.*?)(?:</style\s*+>|\z))?+"
OPENING_RE = rf"(?s)^{TAG}"
# One attribute: its name and, after =, a quoted or bare value.
ATTRIBUTE = r"[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+"
# Elements dropped before main-text extraction.
BOILERPLATE = ["nav", "header", "footer", "aside"]
# Content regions, in priority order (the first that exists wins, even if it is empty):
# article, main, role=main, a div with such a class, body.
CONTENT_CLASS = "(?:content|article|post|entry)"
# A paragraph ends at </p> or at the first of these tags (open or close).
BLOCKS = ["p", "div", "article", "section", "main", "aside", "header", "footer", "nav", "ul", "ol", "li", "dl", "table",
          "tr", "td", "th", "blockquote", "form", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "hr", "address", "fieldset",
          "figure"]

MAX_IMAGES = 50
MAX_LINKS = 100
MAX_H1 = 10
MAX_H2 = 20
MAX_SCHEMA_ITEMS = 10
_RUN = 64  # events summed up together


def _numeric(piece: Column) -> Column:
    """What follows a ``&#``: the character it names and the rest; not a valid
    code point: U+FFFD; not a reference: unchanged."""
    hexa, deci = (F.regexp_extract(piece, p, 1) for p in NUMERIC_RES)
    code = F.when(hexa != "", F.conv(hexa, 16, 10).cast("long")).when(deci != "", deci.cast("long"))
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("�"))
    rest = F.substring(piece, F.instr(piece, ";") + 1, F.length(piece))
    return F.when(code.isNull(), F.concat(F.lit("&#"), piece)).otherwise(F.concat(char, rest))


def decode_entities(c: Column) -> Column:
    """Numeric references, then the named ones."""
    def numeric(x: Column) -> Column:
        pieces = F.split(x, "&#", -1)
        more = F.transform(F.slice(pieces, 2, F.size(pieces)), _numeric)
        return F.when(x.contains("&#"), F.concat(F.get(pieces, 0), F.array_join(more, ""))).otherwise(x)

    def named(x: Column) -> Column:
        out = numeric(x)
        for ent, ch in ENTITIES:
            out = F.replace(out, F.lit(ent), F.lit(ch))
        return F.when(x.contains("&"), out).otherwise(x)
    return bind(c, named)


def bind(c: Column, fn) -> Column:
    """``fn(c)`` with ``c``, which may be a costly expression, evaluated once."""
    return F.get(F.transform(F.array(c), fn), 0)


def bind2(a: Column, b: Column, fn) -> Column:
    """``fn(a, b)``, both evaluated once. What a lambda reads per element has to be
    bound: the optimizer may put a column's whole expression in its place."""
    return bind(F.struct(a.alias("a"), b.alias("b")), lambda s: fn(s["a"], s["b"]))


def strip_comments(html: Column) -> Column:
    return F.regexp_replace(html, F.lit(COMMENT_RE), F.lit(""))


def strip_code(html: Column) -> Column:
    """Remove script and style elements (with their content)."""
    return F.regexp_replace(F.regexp_replace(html, F.lit(SCRIPT_RE), F.lit("")), F.lit(STYLE_RE), F.lit(""))


# ---------------------------------------------------------------- tokens

def tokens(clean: Column) -> Column:
    return F.regexp_extract_all(clean, F.lit(TOKEN_RE), F.lit(0))


def token_names(toks: Column) -> Column:
    return F.transform(toks, lambda t: F.when(t.startswith("<"), F.lower(F.regexp_extract(t, NAME_RE, 0))).otherwise(F.lit("")))


def _range(toks: Column, start: Column, stop: Column) -> Column:
    """Tokens from place ``start`` (from 0) up to, without, ``stop``."""
    return F.slice(toks, start + 1, F.greatest(stop - start, F.lit(0)))


def _first_place(names: Column, name: str) -> Column:
    """Place of the first such token; NULL where there is none."""
    place = F.array_position(names, F.lit(name))
    return F.when(place > 0, (place - 1).cast("int"))


def events(names: Column, wanted: list[str]) -> Column:
    """``(place, name)`` of the tokens with one of ``wanted``, in order."""
    return F.filter(F.transform(names, lambda n, i: F.when(n.isin(*wanted), F.struct(i.alias("i"), n.alias("n")))),
                    lambda e: e.isNotNull())


def is_tag(t: Column) -> Column:
    return t.rlike("^<[a-zA-Z/!?]")


def pieces_text(toks: Column, sep: str = "") -> Column:
    """get_text(sep, strip=True) of a range of tokens."""
    texts = F.transform(F.filter(toks, lambda t: ~is_tag(t)), lambda t: ws_trim(decode_entities(t)))
    return F.array_join(F.filter(texts, lambda x: x != ""), sep)


def _attr_re(name: str) -> str:
    own = rf"{name}(?=[\s=/>]|$)"
    other = rf"(?:[\s/=]*+(?!{own}){ATTRIBUTE})*+"
    return rf"(?is)^<[^\s/>]++{other}[\s/=]*+{own}(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+"


def attr_present(tag: Column, name: str) -> Column:
    return tag.rlike(_attr_re(name))


def attr(tag: Column, name: str) -> Column:
    """Value of the tag's first attribute of that name (entities decoded); ''
    for a value-less attribute; NULL when the attribute is absent."""
    def value(raw: Column) -> Column:
        quoted = (F.length(raw) > 1) & F.substring(raw, 1, 1).isin('"', "'") & (F.substring(raw, 1, 1) == F.substring(raw, -1, 1))
        val = F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
        return F.when(raw != "", decode_entities(val)).when(attr_present(tag, name), F.lit(""))
    return bind(F.regexp_extract(tag, _attr_re(name), 1), value)


def tags(toks: Column, names: Column, name: str) -> Column:
    """The opening tags of one name, in document order."""
    return bind2(toks, names, lambda ts, ns: F.filter(ts, lambda t, i: F.get(ns, i) == f"<{name}"))


def first(arr: Column) -> Column:
    """First element or NULL (safe on empty arrays)."""
    return F.get(arr, 0)


# ---------------------------------------------------------------- elements

def _depths(marks: Column, opening: str) -> Column:
    """Depth after each event, never below 0. Events are cut into runs: a run is
    summed up by its sum and least prefix sum, which give the depth at the start of
    every run; inside a run each event adds up what is before it. (A fold that
    collects an array copies it at every step.)"""
    def move(e: Column) -> Column:
        return F.when(e["n"] == opening, F.lit(1)).otherwise(F.lit(-1))

    def cut(ev: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(ev) - 1) / _RUN).cast("int")),
                           lambda c: F.slice(ev, c * _RUN + 1, F.lit(_RUN)))

    def sums(runs: Column) -> Column:
        def step(x: Column, e: Column) -> Column:
            total = x["s"] + move(e)
            return F.struct(total.alias("s"), F.least(x["m"], total).alias("m"))
        return F.transform(runs, lambda r: F.aggregate(r, F.struct(F.lit(0).alias("s"), F.lit(0).alias("m")), step))

    def at_start(totals: Column) -> Column:
        return F.transform(totals, lambda x, k: F.aggregate(
            F.slice(totals, F.lit(1), k), F.lit(0), lambda d, y: F.greatest(d + y["s"], y["s"] - y["m"])))

    def inside(runs: Column, starts: Column) -> Column:
        return F.flatten(F.transform(runs, lambda r, k: F.transform(r, lambda e, j: F.aggregate(
            F.slice(r, F.lit(1), j + 1), F.get(starts, k), lambda d, x: F.greatest(d + move(x), F.lit(0))))))

    def all_of(ev: Column) -> Column:
        return bind(cut(ev), lambda runs: bind2(runs, bind(sums(runs), at_start), inside))
    return F.when(F.size(marks) == 0, F.array().cast("array<int>")).otherwise(bind(marks, all_of))


def outer_elements(names: Column, name: str) -> Column:
    """``(a, b)``, places of the opening and closing tag, of the outermost
    elements of one name. One that is never closed ends at the last closing tag
    after it; without any it is none."""
    opening, closing = f"<{name}", f"</{name}"

    def outer(ev: Column, depths: Column) -> Column:
        return F.filter(ev, lambda e, k: F.when(e["n"] == opening, F.get(depths, k) == 1).otherwise(
            (F.get(depths, k) == 0) & (F.coalesce(F.get(depths, k - 1), F.lit(0)) == 1)))

    def pairs(marks: Column, last: Column) -> Column:
        found = F.transform(marks, lambda e, k: F.when(e["n"] == opening, F.struct(
            e["i"].alias("a"), F.coalesce(F.get(marks, k + 1)["i"], last).alias("b"))))
        return F.filter(found, lambda x: x.isNotNull() & (x["b"] > x["a"]))

    def of(ev: Column) -> Column:
        closes = F.filter(ev, lambda e: e["n"] == closing)
        return bind2(bind2(ev, _depths(ev, opening), outer), F.coalesce(F.get(closes, F.size(closes) - 1)["i"], F.lit(-1)), pairs)
    return bind(events(names, [opening, closing]), of)


def without(arr: Column, elements: Column) -> Column:
    """``arr`` without the ranges of ``elements`` (ascending, apart)."""
    def cut(a: Column, es: Column) -> Column:
        before = F.transform(es, lambda e, k: _range(a, F.coalesce(F.get(es, k - 1)["b"] + 1, F.lit(0)), e["a"]))
        last = F.get(es, F.size(es) - 1)["b"] + 1
        return F.when(F.size(es) == 0, a).otherwise(F.flatten(F.concat(before, F.array(_range(a, last, F.size(a))))))
    return bind2(arr, elements, cut)


def element_end(names: Column, start: Column) -> Column:
    """Place of the tag that closes the element opened at ``start``; the number of tokens if none does."""
    name = F.substring(F.get(names, start), 2, 1 << 20)
    zero = F.struct(F.lit(-1).alias("i"), F.lit(0).alias("depth"), F.lit(-1).alias("end"))

    def scan(tag: Column, at: Column) -> Column:
        opens, closes = tag["opens"], tag["closes"]

        def step(s: Column, n: Column) -> Column:
            i = s["i"] + 1
            live = (s["end"] < 0) & (i >= at)
            depth = (F.when(live & (n == opens), s["depth"] + 1).when(live & (n == closes), s["depth"] - 1)
                      .otherwise(s["depth"]))
            end = F.when(live & (n == closes) & (s["depth"] == 1), i).otherwise(s["end"])
            return F.struct(i.alias("i"), depth.alias("depth"), end.alias("end"))
        return F.aggregate(names, zero, step, lambda s: F.when(s["end"] >= 0, s["end"]).otherwise(s["i"] + 1))
    both = F.struct(F.concat(F.lit("<"), name).alias("opens"), F.concat(F.lit("</"), name).alias("closes"))
    return bind2(both, start, scan)


def title(toks: Column, names: Column) -> Column:
    """Text of the first <title>, tags inside included; NULL when there is none."""
    start = _first_place(names, "<title")
    rest = F.array_position(F.slice(names, start + 2, F.size(names)), F.lit("</title"))
    inside = F.when(rest > 0, F.slice(toks, start + 2, (rest - 1).cast("int"))).otherwise(
        F.slice(toks, start + 2, F.size(toks)))
    return F.when(start.isNotNull(), ws_trim(decode_entities(F.array_join(inside, ""))))


def html_lang(toks: Column, names: Column) -> Column:
    """lang attribute of <html> when present and non-empty."""
    lang = attr(F.get(toks, _first_place(names, "<html")), "lang")
    return F.when(lang != "", lang)


def _texts_between(toks: Column, marks: Column, opening: str) -> Column:
    """Element text from each ``opening`` event to the event after it."""
    def texts(ts: Column, ev: Column) -> Column:
        return F.transform(ev, lambda e, k: F.when(e["n"] == opening, pieces_text(_range(
            ts, e["i"] + 1, F.coalesce(F.get(ev, k + 1)["i"], F.size(ts))))))
    return F.filter(bind2(toks, marks, texts), lambda t: t.isNotNull())


def headings(toks: Column, names: Column, level: int) -> Column:
    return _texts_between(toks, events(names, [f"<h{level}", f"</h{level}"]), f"<h{level}")


def body_tokens(toks: Column, names: Column) -> Column:
    """Tokens of <body>; without one, those after </head>; without either, all."""
    start = F.coalesce(_first_place(names, "<body"), _first_place(names, "</head"))
    rest = F.array_position(F.slice(names, start + 2, F.size(names)), F.lit("</body"))
    return F.when(start.isNull(), toks).when(rest > 0, F.slice(toks, start + 2, (rest - 1).cast("int"))).otherwise(
        F.slice(toks, start + 2, F.size(toks)))


def body_text(toks: Column, names: Column) -> Column:
    """get_text(' ', strip=True) of <body> (scripts, styles, comments removed)."""
    return pieces_text(body_tokens(toks, names), " ")


def _first_tag(toks: Column, names: Column, pred) -> Column:
    """Place of the first opening tag with ``pred(token, name)``; NULL where there is none."""
    return first(bind2(toks, names, lambda ts, ns: F.filter(
        F.transform(ts, lambda t, i: F.when(pred(t, F.get(ns, i)), i)), lambda i: i.isNotNull())))


def region_start(toks: Column, names: Column) -> Column:
    """Place of the tag that opens the content region; NULL for the body."""
    def role(t: Column, n: Column) -> Column:
        return n.rlike("^<[a-z]") & t.rlike("(?i)role") & (F.lower(attr(t, "role")) == "main")

    def content(t: Column, n: Column) -> Column:
        return (n == "<div") & t.rlike(f"(?i){CONTENT_CLASS}") & attr(t, "class").rlike(f"(?i){CONTENT_CLASS}")
    return F.coalesce(_first_place(names, "<article"), _first_place(names, "<main"), _first_tag(toks, names, role),
                      _first_tag(toks, names, content))


def region_bounds(names: Column, start: Column) -> Column:
    """``(a, b)``: the region's tokens run from a to before b."""
    body = _first_place(names, "<body")
    head = _first_place(names, "</head")
    close = _first_place(names, "</body")
    return F.when(start.isNotNull(), F.struct((start + 1).alias("a"), element_end(names, start).alias("b"))).otherwise(
        F.struct(F.coalesce(body + 1, head + 1, F.lit(0)).alias("a"),
                 F.when(close > F.coalesce(body, head, F.lit(-1)), close).otherwise(F.size(names)).alias("b")))


def paragraphs(toks: Column, names: Column) -> Column:
    """Texts of the <p> elements of a range (non-empty ones only)."""
    marks = events(names, [f"{o}{b}" for b in BLOCKS for o in ("<", "</")])
    return F.filter(_texts_between(toks, marks, "<p"), lambda t: t != "")


def meta_structs(toks: Column, names: Column) -> Column:
    return F.transform(tags(toks, names, "meta"), lambda m: F.struct(
        attr(m, "name").alias("name"), attr(m, "property").alias("property"),
        attr(m, "content").alias("content"), attr(m, "charset").alias("charset")))


def meta_lookup(metas: Column, pred) -> Column:
    """The first meta struct satisfying ``pred`` (or NULL)."""
    return first(F.filter(metas, pred))


def meta_content(m: Column) -> Column:
    """content of a found meta ('' when the tag lacks it); NULL when no tag."""
    return F.when(m.isNotNull(), F.coalesce(m["content"], F.lit("")))


def stripped_or_null(c: Column) -> Column:
    """``value.strip() or None``."""
    t = ws_trim(c)
    return F.when(t != "", t)


def ld_json_scripts(no_comments: Column) -> Column:
    """Raw text of each <script type="application/ld+json">, in order."""
    scripts = F.filter(F.regexp_extract_all(no_comments, F.lit(SCRIPT_RE), F.lit(0)), lambda s: F.lower(
        attr(F.regexp_extract(s, OPENING_RE, 0), "type")) == "application/ld+json")
    return F.transform(scripts, lambda s: F.regexp_extract(s, SCRIPT_RE, 1))


def canonical(toks: Column, names: Column) -> Column:
    """href of the first <link> whose rel tokens include 'canonical'."""
    links = F.filter(tags(toks, names, "link"),
                     lambda t: F.coalesce(attr(t, "rel"), F.lit("")).rlike(rf"(?:^|{WS})canonical(?:{WS}|$)"))
    l0 = first(links)
    return F.when(l0.isNotNull(), F.coalesce(attr(l0, "href"), F.lit("")))


# ---------------------------------------------------------------- markdown

def _mark(t: Column, n: Column) -> Column:
    """Markdown of one token, links apart."""
    src = attr(t, "src")
    out = F.when(~is_tag(t), t)
    for level in range(1, 7):
        out = out.when(n == f"<h{level}", F.lit("\n\n" + "#" * level + " ")).when(n == f"</h{level}", F.lit("\n\n"))
    return (out.when(n == "<li", F.lit("\n- ")).when((n == "<img") & src.isNotNull(), F.concat(F.lit("![]("), src, F.lit(")")))
               .when(n.isin("<b", "</b", "<strong", "</strong"), F.lit("**")).when(n == "<p", F.lit("\n\n"))
               .when(n.isin("<br", "</br"), F.lit("\n")).otherwise(F.lit("")))


def markdown(toks: Column, names: Column) -> Column:
    """Markdown of a range of tokens: headings, list items, links, images, bold
    and paragraphs; other tags are dropped. A link reaches from ``<a href>`` to
    the first ``</a`` before the next ``<a``; a link without one is its text."""
    opens = F.filter(F.transform(names, lambda n, i: F.when(n == "<a", i)), lambda i: i.isNotNull())

    def parts(r: Column) -> Column:
        return F.struct(r["own"].alias("own"), r["kinds"].alias("kinds"), attr(F.get(r["own"], 0), "href").alias("href"),
                        F.when(F.get(r["kinds"], 0) == "<a", F.array_position(r["kinds"], F.lit("</a"))).alias("close"))

    def written(r: Column) -> Column:
        link = F.coalesce((r["close"] > 0) & r["href"].isNotNull(), F.lit(False))
        return F.array_join(F.transform(r["own"], lambda t, i: F.when(link & (i == 0), F.lit("[")).when(
            link & (i == r["close"] - 1), F.concat(F.lit("]("), r["href"], F.lit(")"))).otherwise(
            _mark(t, F.get(r["kinds"], i)))), "")

    def render(page: Column) -> Column:
        ts, ns, starts = page["ts"], page["ns"], page["starts"]

        def segment(start: Column, stop: Column) -> Column:
            return bind(bind(F.struct(_range(ts, start, stop).alias("own"), _range(ns, start, stop).alias("kinds")), parts), written)
        rest = F.transform(starts, lambda s, k: segment(s, F.coalesce(F.get(starts, k + 1), F.size(ts))))
        return F.concat(segment(F.lit(0), F.coalesce(F.get(starts, 0), F.size(ts))), F.array_join(rest, ""))
    md = decode_entities(bind(F.struct(toks.alias("ts"), names.alias("ns"), opens.alias("starts")), render))
    for pattern, to in ((r"[ \t]+", " "), (r"\n[ \t]+", "\n"), (r"\n{3,}", "\n\n")):
        md = F.regexp_replace(md, F.lit(pattern), F.lit(to))
    return ws_trim(md)


__all__ = [n for n in dir() if not n.startswith("_")]
