"""TEI XML of an external service: reference lists and document headers as columns.

The elements of a reference list are read by a parser in Arrow batches, as every call of Spark's
XPath functions parses its text anew; headers are read by those functions. An unreadable element of
a list is no reference; an unreadable header is an error of Spark's.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import ship
from . import rx

REFERENCE = "authors string, year int, title string, journal string, volume string, pages string, doi string, raw_text string"
_NAMES = [part.split()[0] for part in REFERENCE.split(", ")]
_NOTHING = (None,) * len(_NAMES)

#: Stands in no XML text, not even as a character code.
_CUT = "\x00"
#: The JDK allows a hundred steps and operators in one expression, which is so many of the paths here.
_TOGETHER = 9
_LISTED = 3  # authors in one pass
#: A plain ``bibl`` whose text can be taken as it stands: no marks, codes or characters that XML changes.
_PLAIN = re.compile("<bibl>([^<>&\x00-\x08\x0b-\x1f\ufffe\uffff]*)</bibl>")
#: References from an opening tag, but of elements that end at once, to the first closing one.
_STRUCT = re.compile(r"<biblStruct\b[^>]*(?<!/)>[^<]*(?:<(?!/biblStruct>)[^<]*)*</biblStruct>")
_BIBL = re.compile(r"<bibl(?!Struct)\b[^>]*(?<!/)>[^<]*(?:<(?!/bibl>)[^<]*)*</bibl>")
_TOGETHER_CHARS = 1 << 16  # of lists that are parsed together


def _text(xml: Column, path: str) -> Column:
    return rx.empty_to_null(rx.strip(F.xpath_string(xml, F.lit(path))))


def _start(path: str) -> str:
    """The text with which the first element of a path begins, before any child of it. The last
    step is on the descendant axis, whose first in document order needs no brackets: the JDK allows ten."""
    return f"string({path}[1]/node()[1][self::text()])"


def _either(path: str, other: str) -> dict[str, str]:
    """Whether a path has an element, the text of its first and that of another path's."""
    return {"there": f"boolean({path})", "text": _start(path), "other": _start(other)}


def _read(xml: Column, paths: dict[str, str], then: Callable[[Callable[[str], Column]], Column]) -> Column:
    """``then(value)`` where ``value(name)`` is the string of each path; as many as may be are read
    in one pass, as every call of an XPath function parses its text anew."""
    all_paths = list(paths.values())
    parts = [all_paths[lo : lo + _TOGETHER] for lo in range(0, len(all_paths), _TOGETHER)]
    read = [F.split(F.xpath_string(xml, F.lit("concat(" + f", '{_CUT}', ".join(p) + ")")), _CUT, -1) for p in parts]
    place = {n: i for i, n in enumerate(paths)}
    return rx.let(F.concat(*read) if len(read) > 1 else read[0], lambda p: then(lambda n: F.get(p, F.lit(place[n]))))


def _prefixed(name: str, paths: dict[str, str]) -> dict[str, str]:
    return {f"{name} {k}": v for k, v in paths.items()}


def _chosen(value: Callable[[str], Column], name: str) -> Column:
    """Of ``_either``: the first path's text, the other's only where the first has no element."""
    return _clean(F.when(value(f"{name} there") == "true", value(f"{name} text")).otherwise(value(f"{name} other")))


def _clean(c: Column) -> Column:
    return rx.empty_to_null(rx.strip(c))


def _people(n: int) -> dict[str, str]:
    parts = [(k, part) for k in range(1, n + 1) for part in ("surname", "forename")]
    return {f"{part} {k}": _start(f"/descendant::author[{k}]/descendant::persName[1]/descendant::{part}") for k, part in parts}


_AUTHORS = {"authors": "count(//author)"} | _people(1)
_YEAR = {"when": "string(/descendant::date[1]/@when)", "date": _start("/descendant::date")}


def _name(surname: Column, forename: Column) -> Column:
    return F.concat(_clean(surname), F.coalesce(F.concat(F.lit(", "), _clean(forename)), F.lit("")))


def _authors(xml: Column, value: Callable[[str], Column]) -> Column:
    """``surname, forename`` of every author with a surname, comma-joined."""
    people = rx.every(xml, r"(<author\b.*?</author>)", 1, "s")
    paths = {"surname": _start("/descendant::persName[1]/descendant::surname"), "forename": _start("/descendant::persName[1]/descendant::forename")}
    alone = lambda a: _read(a, paths, lambda v: _name(v("surname"), v("forename")))
    listed = lambda v, n: F.array(*[_name(v(f"surname {k}"), v(f"forename {k}")) for k in range(1, n + 1)])

    def names(found: Column) -> Column:
        alike = F.size(found) == value("authors").cast("int")  # no author stands in a comment or another author
        several = _read(xml, _people(_LISTED), lambda v: F.slice(listed(v, _LISTED), 1, F.size(found)))
        return (
            F.when(alike & (F.size(found) == 1), listed(value, 1))
            .when(alike & F.size(found).between(2, _LISTED), several)
            .otherwise(F.transform(found, alone))
        )

    return rx.empty_to_null(F.array_join(F.filter(rx.let(people, names), lambda n: n.isNotNull()), ", "))


def _year(value: Callable[[str], Column]) -> Column:
    """Of the first date alone: its attribute, else its text."""
    stated = F.coalesce(rx.empty_to_null(value("when")), rx.empty_to_null(value("date")))
    return F.substring(stated, 1, 4).try_cast("int")


def _tree(xml: str, marks: bool = True) -> ET.Element | None:
    """The root of an element's text, names as they are written; null if it can't be read. With
    ``marks`` comments and instructions part the text around them."""
    builder = ET.TreeBuilder(insert_comments=marks, insert_pis=marks)
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = builder.start, builder.end, builder.data
    if marks:
        parser.CommentHandler, parser.ProcessingInstructionHandler = builder.comment, builder.pi
    try:
        parser.Parse(xml, True)
    except expat.ExpatError:
        return None
    return builder.close()


def _trees(parts: list[str]) -> list[ET.Element | None]:
    """``_tree`` of each text, of all together where they stay apart: a parser's start takes longer
    than a text. That one knows namespaces, and refuses prefixes that nothing declares."""
    whole = f"<r>{''.join(parts)}</r>"
    if "xmlns" not in whole:
        parser = ET.XMLParser(target=ET.TreeBuilder(insert_comments=True, insert_pis=True))
        try:
            parser.feed(whole)
            roots = list(parser.close())
        except ET.ParseError:
            roots = []
        # Each text has one closing tag, so with as many roots all of them are whole.
        if len(roots) == len(parts):
            return roots
    return [_tree(p) for p in parts]


def _bare(text: str | None) -> str | None:
    return (text or "").strip(rx.BLANKS) or None


def _opening(parent: ET.Element | None, name: str) -> str | None:
    """The text with which the first element of a name begins, before any child of it."""
    found = None if parent is None else next(parent.iter(name), None)
    return None if found is None else _bare(found.text)


def _titled(titles: list[ET.Element], level: str) -> str | None:
    """Of the first title of a level, else of the first title."""
    found = next((t for t in titles if t.get("level") == level), titles[0] if titles else None)
    return None if found is None else _bare(found.text)


def _structured(root: ET.Element, compat: bool) -> tuple:
    """The fields of one ``biblStruct`` element, the year as its text.

    Journal, volume and pages are those of the first ``monogr``; without a journal title its
    first title counts. Pages are the texts of all page scopes, joined; without ``compat`` the
    attributes ``from`` and ``to`` stand in where no scope has a text.
    """
    held: dict[str, list[ET.Element]] = {}
    for e in root.iter():
        held.setdefault(e.tag, []).append(e)
    names = []
    for author in held.get("author", ()):
        person = next(author.iter("persName"), None)
        if surname := _opening(person, "surname"):
            forename = _opening(person, "forename")
            names.append(f"{surname}, {forename}" if forename else surname)
    date = held["date"][0] if "date" in held else None
    year = None if date is None else date.get("when") or date.text or None
    monogr = held["monogr"][0] if "monogr" in held else None
    scopes = [] if monogr is None else list(monogr.iter("biblScope"))
    volume = next((s.text for s in scopes if s.get("unit") == "volume"), None)
    page = [s for s in scopes if s.get("unit") == "page"]
    pages = "-".join(s.text.strip(rx.BLANKS) for s in page if s.text) or None
    if pages is None and not compat:
        ends = [_bare(next((s.get(a) for s in page if a in s.attrib), None)) for a in ("from", "to")]
        pages = "-".join(e for e in ends if e) or None
    doi = next((i.text for i in held.get("idno", ()) if i.get("type") == "DOI"), None)
    journals = [] if monogr is None else list(monogr.iter("title"))
    return ", ".join(names) or None, year and year[:4], _titled(held.get("title", []), "a"), _titled(journals, "j"), _bare(volume), pages, _bare(doi), None


def _raw(xml: str) -> str | None:
    """The text of one ``bibl`` element."""
    if plain := _PLAIN.fullmatch(xml):
        return _bare(plain[1])
    root = _tree(xml, False)
    return None if root is None or root.tag != "bibl" else _bare("".join(root.itertext()))


def _read_lists(lists: list[str | None], compat: bool) -> Iterator[list[tuple]]:
    """The references of each list, read or not; an element that stands there again is read once."""
    structs = [_STRUCT.findall(x) if x else [] for x in lists]
    parts = list(dict.fromkeys(x for found in structs for x in found))
    read = {x: _structured(t, compat) if t is not None else _NOTHING for x, t in zip(parts, _trees(parts))}
    for xml, found in zip(lists, structs):
        bibls = _BIBL.findall(xml) if xml else []
        raw = {x: (*_NOTHING[1:], _raw(x)) for x in dict.fromkeys(bibls)}
        yield [*[read[x] for x in found], *[raw[x] for x in bibls]]


def _listed(lists: pa.Array, compat: bool) -> pa.Array:
    """The references of each list as structs of texts."""
    found: list[tuple] = []
    ends = [0]
    block: list[str | None] = []
    texts = lists.to_numpy(zero_copy_only=False).tolist()
    chars = 0
    for i, xml in enumerate(texts):
        block.append(xml)
        chars += len(xml or "")
        if chars >= _TOGETHER_CHARS or i == len(texts) - 1:
            for refs in _read_lists(block, compat):
                found += refs
                ends.append(len(found))
            block, chars = [], 0
    columns = list(zip(*found)) or [[]] * len(_NAMES)
    structs = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], _NAMES)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs, mask=pa.array([x is None for x in texts], pa.bool_()))


def _has_content(s: Column) -> Column:
    return F.coalesce(*[s[n].cast("string") for n in _NAMES]).isNotNull()


def references(xml: Column, compat: bool = True) -> Column:
    """All ``biblStruct`` elements, then all ``bibl`` elements, in order, as structs."""
    ship(SparkSession.active())
    read = F.arrow_udf(lambda lists: _listed(lists, compat), "array<struct<" + ",".join(f"{n}:string" for n in _NAMES) + ">>")
    typed = F.transform(read(xml), lambda r: F.struct(*[(r[n].try_cast("int") if n == "year" else r[n]).alias(n) for n in _NAMES]))
    return F.filter(typed, _has_content)


def good_quality(refs: Column, limit: float = 0.7) -> Column:
    """Whether at least ``limit`` of the references have a year and a title over 10 characters."""
    def good(rs: Column) -> Column:
        full = F.filter(rs, lambda r: (F.length(r["title"]) > 10) & r["year"].isNotNull())
        return F.coalesce((F.size(rs) > 0) & (F.size(full) >= limit * F.size(rs)), F.lit(False))

    return rx.let(refs, good)


def as_text(ref: Column) -> Column:
    """A structured reference as the citation string that the parser reads."""
    labelled = lambda prefix, c, suffix="": F.concat(F.lit(prefix), c.cast("string"), F.lit(suffix))
    parts = F.concat_ws(
        ". ",
        ref["authors"],
        labelled("(", ref["year"], ")"),
        ref["title"],
        ref["journal"],
        labelled("Vol. ", ref["volume"]),
        labelled("pp. ", ref["pages"]),
        labelled("DOI: ", ref["doi"]),
    )
    return rx.empty_to_null(F.coalesce(ref["raw_text"], parts))


def header(xml: Column) -> Column:
    """Title, authors, year, doi and abstract of a document header."""
    body = rx.first(xml, r"(<abstract\b.*?</abstract>)", 1, "s")
    paths = _prefixed("title", _either('/descendant::title[@type="main"]', "/descendant::title")) | {"doi": _start('/descendant::idno[@type="DOI"]')} | _AUTHORS | _YEAR
    return _read(
        xml,
        paths,
        lambda value: F.struct(
            _chosen(value, "title").alias("title"),
            _authors(xml, value).alias("authors"),
            _year(value).alias("year"),
            _clean(value("doi")).alias("doi"),
            _text(body, "string(/abstract)").alias("abstract"),
        ),
    )
