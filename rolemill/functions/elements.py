"""Elements of loose HTML as columns: found by patterns, cut at their matching end, read as text.

Selectors are compiled on the driver, one pattern for each step. A page is not made a tree: an element begins
where its pattern fits a tag, and its end is found by counting the tags of its own name behind it.
Patterns come in as columns, so one expression serves every board and field.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolemill.functions import posting_text as P
from rolemill.functions.text import collapse, let, text

VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
# Tags that an opening tag of the same name closes, as browsers do, and what closes a paragraph.
REPEATED = ("li", "tr", "td", "th", "option", "dt", "dd")
BLOCKS = (
    "p", "div", "ul", "ol", "li", "dl", "table", "section", "article", "aside", "header", "footer", "main", "nav", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "body", "html",
)
LISTS = ("ul", "ol", "table", "dl", "select")

_TEST = re.compile(r"([#.]?[\w-]+|\*)|\[([\w:-]+)(?:([*^$~]?=)[\"']?([^\"'\]]*)[\"']?)?\]")
_SILENT = r"(?is)<!--.*?-->|<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>"
_TAG_NAME = r"^</?([A-Za-z][\w-]*)"


# --- selectors to patterns ------------------------------------------------------------


def _attribute(name: str, operator: str, wanted: str) -> str:
    """A look ahead inside a tag; values may stand in quotes or bare."""
    value = re.escape(wanted)
    end = {
        "": r"(?=[\s=/>])",
        "=": rf"\s*=\s*(?:\"{value}\"|'{value}'|{value}(?=[\s>]))",
        "*=": rf"\s*=\s*[\"']?[^\"'>]*{value}",
        "^=": rf"\s*=\s*[\"']?{value}",
        "$=": rf"\s*=\s*[\"']?[^\"'>]*{value}(?=[\"'\s>])",
        "~=": rf"\s*=\s*[\"']?(?:[^\"'>]*\s)?{value}(?=[\"'\s>])",
    }[operator]
    return rf"(?=[^>]*\s(?i:{name}){end})"


def tag_pattern(compound: str) -> str:
    """The pattern of an opening tag that fits one step of a selector, as in ``a.posting-title[href]``."""
    tag, looks = r"[A-Za-z][\w-]*", ""
    for word, attribute, operator, wanted in _TEST.findall(compound):
        if attribute:
            looks += _attribute(attribute, operator, wanted)
        elif word.startswith("#"):
            looks += _attribute("id", "=", word[1:])
        elif word.startswith("."):
            looks += _attribute("class", "~=", word[1:])
        elif word != "*":
            tag = re.escape(word)
    return rf"<(?i:{tag})(?=[\s/>]){looks}"


def paths(selector: str) -> list[list[str]]:
    """Comma list to alternatives of steps; alternatives of a single step are one pattern, in document order."""
    found = []
    for part in re.split(r",(?![^\[]*\])", selector):
        steps = re.findall(r"(?:[^\s\[]|\[[^\]]*\])+", part.strip())
        found.append([tag_pattern(step) for step in steps])
    if len(found) > 1 and all(len(steps) == 1 for steps in found):
        return [["(?:" + "|".join(steps[0] for steps in found) + ")"]]
    return found


def options(rule) -> list[dict]:
    """A rule (selectors in order of preference) to options of steps and an attribute.

    ``@name`` at the end of a selector reads an attribute, a bare ``@name`` one of the element itself,
    ``self`` its own text.
    """
    out = []
    for selector in (rule,) if isinstance(rule, str) else rule:
        path, _, name = selector.strip().rpartition("@") if re.search(r"(^|\s)@[\w-]+$", selector.strip()) else (selector.strip(), "", "")
        attribute = rf"(?i)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))" if name else ""
        steps = [[]] if path.strip() in ("", "self") else paths(path.strip())
        out += [{"attribute": attribute, "steps": s} for s in steps]
    return out


def compiled(rules: dict) -> dict:
    """A page's rules to patterns: cards, and fields with their options; ``*name`` joins all matches."""
    card = rules.get("card")
    return {
        "cards": [path for selector in ((card,) if isinstance(card, str) else card or ()) for part in re.split(r",(?![^\[]*\])", selector) for path in paths(part)],
        "fields": [{"name": n.lstrip("*"), "many": n.startswith("*"), "options": options(r)} for n, r in rules.items() if n != "card"],
    }


KIND = "struct<cards:array<array<string>>,fields:array<struct<name:string,many:boolean,options:array<struct<attribute:string,steps:array<string>>>>>>"


# --- elements -------------------------------------------------------------------------


def without_silent(html: Column) -> Column:
    """A page as one element, without comments and what its scripts and styles hold."""
    return F.concat(F.lit("<page>"), F.regexp_replace(text(html), _SILENT, ""))


def cut(rest: Column) -> Column:
    """The element that ``rest`` begins with, up to its end tag, or to where its end is understood."""

    def close(name: Column, pieces: Column) -> Column:
        def step(state, piece):
            def moved(here: Column) -> Column:
                closing = F.startswith(piece, F.lit("</"))
                change = F.when(closing, -1).when(piece.rlike("^<[^>]*/>"), 0).otherwise(1)
                depth = state["depth"] + F.when(here == name, change).otherwise(0)
                lists = state["lists"] + F.when(here.isin(*LISTS), change).otherwise(0)
                alone = state["lists"] == 0
                ends = (
                    (closing & (here == name) & (depth <= 0))
                    | ((name == "p") & here.isin(*BLOCKS))
                    | (name.isin(*REPEATED) & alone & (((here == name) & ~closing) | (here.isin(*LISTS) & closing)))
                )
                done = (state["n"] > 0) & ends
                return F.struct(depth.alias("depth"), lists.alias("lists"), (state["n"] + F.when(done, 0).otherwise(1)).alias("n"), done.alias("done"))

            return F.when(state["done"], state).otherwise(let(F.lower(F.regexp_extract(piece, _TAG_NAME, 1)), moved))

        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lists"), F.lit(0).alias("n"), F.lit(False).alias("done"))
        count = F.aggregate(pieces, start, step, lambda s: s["n"])
        return F.array_join(F.slice(pieces, F.lit(1), count), "")

    def named(name: Column) -> Column:
        head = F.regexp_extract(rest, "^<[^>]*>", 0)
        whole = let(F.split(rest, r"(?=</?[A-Za-z])", -1), lambda pieces: close(name, pieces))
        return F.when(rest == "", "").when(name.isin(*VOID), head).otherwise(whole)

    return let(F.lower(F.regexp_extract(rest, _TAG_NAME, 1)), named)


def below(block: Column) -> Column:
    """An element without its own tag, which is no descendant of it."""
    return F.regexp_replace(block, "^<[^>]*>", "")


def first(html: Column, pattern: Column) -> Column:
    """The first element that fits, '' where none does."""
    found = F.call_function("regexp_extract", html, F.concat(F.lit("(?s)("), pattern, F.lit(".*)")), F.lit(1))
    return let(found, lambda rest: F.when(rest == "", "").otherwise(cut(rest)))


def inside(html: Column, steps: Column) -> Column:
    """The first element along steps, each looked for inside the one before."""
    return F.aggregate(steps, html, lambda block, step: first(below(block), step))


def every(html: Column, pattern: Column) -> Column:
    """All elements that fit, each up to its end or to where the next one begins."""
    parts = F.split(html, F.concat(F.lit("(?="), pattern, F.lit(")")), -1)
    return F.transform(F.filter(parts, lambda p: F.rlike(p, F.concat(F.lit("^"), pattern))), cut)


def along(html: Column, steps: Column) -> Column:
    """All elements that fit the last step inside the first element along the steps before it."""
    scope = inside(html, F.slice(steps, F.lit(1), F.size(steps) - 1))
    return let(below(scope), lambda s: every(s, F.element_at(steps, -1)))


def plain(block: Column) -> Column:
    """Text of an element: tags go without leaving a blank, entities are resolved, white space collapses."""
    return collapse(P.decode_entities(F.regexp_replace(block, r"<[A-Za-z/!][^>]*>", "")))


def attribute(block: Column, pattern: Column) -> Column:
    """An attribute of the tag that ``block`` begins with."""
    head = F.regexp_extract(block, "^<[^>]*>", 0)
    return let(head, lambda h: F.btrim(P.decode_entities(F.concat(*[F.call_function("regexp_extract", h, pattern, F.lit(i)) for i in (1, 2, 3)]))))


def cards(html: Column, rules: Column) -> Column:
    """The cards of a list page: of the first kind of card that the page has."""
    kinds = F.filter(rules["cards"], lambda steps: F.rlike(html, F.element_at(steps, -1)))
    chosen = F.get(kinds, F.lit(0))
    return F.when(chosen.isNull(), F.array().cast("array<string>")).otherwise(let(chosen, lambda steps: along(html, steps)))


def value(html: Column, field: Column) -> Column:
    """The first non-blank value of a field's options; of a field of many, all texts, each once."""

    def one(option: Column) -> Column:
        return let(inside(html, option["steps"]), lambda block: F.when(option["attribute"] == "", plain(block)).otherwise(attribute(block, option["attribute"])))

    single = F.aggregate(field["options"], F.lit(""), lambda found, option: F.when(found != "", found).otherwise(one(option)))
    texts = F.flatten(F.transform(field["options"], lambda option: F.transform(along(html, option["steps"]), plain)))
    many = F.array_join(F.array_distinct(F.filter(texts, lambda t: t != "")), ", ")
    return F.when(field["many"], many).otherwise(single)


def values(html: Column, rules: Column) -> Column:
    """Field names to values."""
    return F.map_from_entries(F.transform(rules["fields"], lambda f: F.struct(f["name"], value(html, f))))
