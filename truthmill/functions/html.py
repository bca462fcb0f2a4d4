"""Element selection and text of HTML held in a string column.

Everything is regular-expression and array expressions, so a page stays in the JVM.
A selector is a chain of simple parts, each an optional tag with ``#id`` and ``.class``
marks. A part after ``>`` narrows the elements found before to their children, a part after
a blank to the elements anywhere inside them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from truthmill.functions.arrays import let

# --- fixed values: markup that breaks no word, and common named entities ----------
INLINE_TAGS = (
    "a abbr acronym b bdo big button cite code del dfn em font i img input ins kbd label mark "
    "q s samp select small span strike strong sub sup textarea time tt u var"
).split()
ENTITIES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "reg": "®",
    "trade": "™", "middot": "·", "bull": "•", "hellip": "…", "ndash": "–", "mdash": "—",
    "lsquo": "‘", "rsquo": "’", "sbquo": "‚", "ldquo": "“", "rdquo": "”", "bdquo": "„",
    "laquo": "«", "raquo": "»", "euro": "€", "deg": "°", "sect": "§",
}
# ---------------------------------------------------------------------------------

_HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>"
_INLINE = r"(?i)</?(?:" + "|".join(INLINE_TAGS) + r")(?=[\s/>])[^>]*>"
_OPENS = r"(?is)^<(?!(?:area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr)[\s/>])[a-z][^>]*(?<!/)>"
_NUMERIC_PIECE = r"(?i)&#x?[0-9a-f]{1,6};|[^&]+|&"


def visible_markup(html: Column) -> Column:
    """The page without comments, scripts and styles."""
    return F.regexp_replace(html, _HIDDEN, "")


def _numeric_entities(text: Column) -> Column:
    def decode(piece: Column) -> Column:
        digits = F.regexp_extract(piece, r"(?i)^&#(x?)([0-9a-f]+);$", 2)
        is_hex = piece.rlike("(?i)^&#x")
        point = F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
        char = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
        valid = point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF)
        return F.when(valid, char).otherwise(piece)

    pieces = F.regexp_extract_all(text, F.lit(f"({_NUMERIC_PIECE})"), F.lit(1))
    decoded = F.transform(pieces, lambda p: F.when(p.startswith("&#"), decode(p)).otherwise(p))
    return F.when(text.contains("&#"), F.array_join(decoded, "")).otherwise(text)


def _named_entities(text: Column) -> Column:
    plain = text
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    text = F.replace(text, F.lit("&amp;"), F.lit("&"))
    return F.when(plain.contains("&"), text).otherwise(plain)


def unescape(text: Column) -> Column:
    """Character references to characters; ``&amp;`` last, so nothing is decoded twice."""
    return let(let(text, _numeric_entities), _named_entities)


def markup_text(fragment: Column) -> Column:
    """Text of a fragment: inline tags vanish, other tags part words, blanks collapse."""
    t = F.regexp_replace(visible_markup(fragment), _INLINE, "")
    t = F.regexp_replace(t, "<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescape(t), r"[ \t\n\f\r]+", " "))


def open_tag(part: str) -> str:
    """Regular expression of the opening tag that a simple selector part describes."""
    m = re.fullmatch(r"([A-Za-z][\w-]*)?((?:[#.][\w-]+)*)", part.strip())
    if not m or not part.strip():
        raise ValueError(f"not a simple selector: {part!r}")
    needs = ""
    for mark in re.findall(r"[#.][\w-]+", m.group(2)):
        name = re.escape(mark[1:])
        if mark[0] == "#":
            needs += rf"""(?=[^>]*?\sid\s*=\s*["']?{name}["'\s>])"""
        else:
            needs += (
                rf"""(?=[^>]*?\sclass\s*=\s*(?:["'](?:[^"'>]*\s)?{name}(?:\s[^"'>]*)?["']|{name}[\s>]))"""
            )
    return rf"(?is)<({m.group(1) or '[a-z][a-z0-9-]*'})(?=[\s/>]){needs}[^>]*>"


def selector_steps(selector: str) -> list[tuple[bool, str]]:
    """(child of the step before, opening-tag pattern) of each part, outermost first."""
    out, child = [], False
    for word in selector.replace(">", " > ").split():
        if word == ">":
            child = True
        else:
            out.append((child, open_tag(word)))
            child = False
    if child or not out or out[0][0]:
        raise ValueError(f"not a selector: {selector!r}")
    return out


def _element_body(rest: Column) -> Column:
    """``struct<closed, inner, length>`` of the element whose opening tag starts the text.

    The text is cut at every tag of the same name and the pieces are counted up and down
    to find where the element closes, so nested elements of the same name stay inside it.
    An element that never closes runs to the end.
    """
    name = F.regexp_extract(rest, r"^<([a-zA-Z][\w-]*)", 1)
    pieces = F.split(rest, F.concat(F.lit("(?i)(?=</?"), name, F.lit(r"[\s/>])")))

    def until_closed(p: Column) -> Column:
        # depth after a piece, pieces before it, and how many stand before the closing tag
        end = F.aggregate(
            p,
            F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("end")),
            lambda acc, piece: F.struct(
                (acc["depth"] + F.when(piece.startswith("</"), -1).otherwise(1)).alias("depth"),
                (acc["seen"] + 1).alias("seen"),
                F.when((acc["end"] == 0) & (acc["depth"] == 1) & piece.startswith("</"), acc["seen"])
                .otherwise(acc["end"])
                .alias("end"),
            ),
            lambda acc: acc["end"],
        )

        def cut(e: Column) -> Column:
            kept = F.array_join(F.slice(p, F.lit(1), F.when(e > 0, e).otherwise(F.size(p))), "")
            inner = F.regexp_replace(kept, "(?s)^<[^>]*>", "")
            return F.struct((e > 0).alias("closed"), inner.alias("inner"), F.length(kept).alias("length"))

        return let(end, cut)

    return let(pieces, until_closed)


def all_elements(html: Column, opening: str) -> Column:
    """``struct<start, closed, inner, length>`` of every element whose opening tag fits, in page order.

    The page is cut before each such tag. An element mostly closes within its own cut; one
    that holds another match does not, and is then read on to the end of the page.
    """

    def bodies(cuts: Column) -> Column:
        def body(cut: Column, i: Column) -> Column:
            whole = F.array_join(F.slice(cuts, i + 1, F.size(cuts)), "")
            start = F.length(F.array_join(F.slice(cuts, F.lit(1), i), ""))
            own = let(_element_body(cut), lambda r: F.when(r["closed"], r).otherwise(_element_body(whole)))
            found = let(own, lambda r: F.struct(start.alias("start"), r["closed"], r["inner"], r["length"]))
            return F.when(cut.rlike("^" + opening), found)

        return F.array_compact(F.transform(cuts, body))

    return let(F.split(html, f"(?={opening})"), bodies)


def outermost(elements: Column) -> Column:
    """The elements that stand in no other of them."""
    kind = "array<struct<start:int,closed:boolean,inner:string,length:int>>"
    start = F.struct(F.lit(0).alias("upto"), F.array().cast(kind).alias("kept"))

    def step(acc: Column, e: Column) -> Column:
        free = e["start"] >= acc["upto"]
        return F.struct(
            F.when(free, e["start"] + e["length"]).otherwise(acc["upto"]).alias("upto"),
            F.when(free, F.concat(acc["kept"], F.array(e))).otherwise(acc["kept"]).alias("kept"),
        )

    return F.aggregate(elements, start, step, lambda acc: acc["kept"])


def child_bodies(html: Column, opening: str) -> Column:
    """Inner markup of the fitting elements that stand in no other element of the fragment.

    One walk over the tags counts how deep each stands; tags that take no content count for nothing.
    """

    def children(p: Column) -> Column:
        none = F.array().cast("array<int>")
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), none.alias("at"))

        def step(acc: Column, piece: Column) -> Column:
            fits = (acc["depth"] == 0) & piece.rlike("^" + opening)
            change = F.when(piece.rlike("^</[a-zA-Z]"), -1).when(piece.rlike(_OPENS), 1).otherwise(0)
            return F.struct(
                F.greatest(acc["depth"] + change, F.lit(0)).alias("depth"),
                (acc["seen"] + 1).alias("seen"),
                F.when(fits, F.concat(acc["at"], F.array(acc["seen"]))).otherwise(acc["at"]).alias("at"),
            )

        at = F.aggregate(p, start, step, lambda acc: acc["at"])
        return F.transform(at, lambda i: _element_body(F.array_join(F.slice(p, i + 1, F.size(p)), ""))["inner"])

    return let(F.split(html, "(?=<)"), children)


def select_bodies(markup: Column, selector: str) -> Column:
    """Inner markup of the selected elements, each once, in page order.

    The patterns are literals, so each is compiled once for the whole job.
    """
    (_, first), *rest = selector_steps(selector)
    found = all_elements(markup, first)
    if rest and not rest[0][0]:
        found = outermost(found)
    bodies = F.transform(found, lambda e: e["inner"])
    for child, opening in rest:
        if child:
            bodies = F.flatten(F.transform(bodies, lambda b: child_bodies(b, opening)))  # noqa: B023
        else:
            bodies = F.flatten(F.transform(bodies, lambda b: F.transform(all_elements(b, opening), lambda e: e["inner"])))  # noqa: B023
    return bodies


def select_markup(markup: Column, selector: str) -> Column:
    """The selected elements' inner markup, joined by a blank; '' if there is none."""
    return F.array_join(select_bodies(markup, selector), " ")


def select_text(markup: Column, selector: str) -> Column:
    return markup_text(select_markup(markup, selector))


def link_markup(fragment: Column) -> Column:
    """Markup of every link in a fragment."""
    return F.regexp_extract_all(fragment, F.lit(r"((?is)<a(?=[\s/>])[^>]*>.*?</a\s*>)"), F.lit(1))
