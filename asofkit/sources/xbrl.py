"""XBRL instances as rows: a pull parser whose facts come out one by one.

An instance is read twice from its bytes (a small one once). The first pass keeps contexts, units and the namespaces in scope and checks all that a fact could fail on; the second
gives the facts, in batches, and lets go of each element once it is read, so memory holds the bytes and the contexts of one document, not its tree of facts.
QName values (axes, members, measures) become {namespace}local by the prefixes that the document declares. What is no sound instance gives one row
that says why, and no facts: nothing is guessed.

Errors: `doctype`, `not_xml`, `not_an_instance` (another root), `rebound_prefix` (one prefix for two namespaces), `undeclared_prefix`, `bad_context` (no id,
entity, scheme or period), `duplicate_context`, `bad_dimension` (no axis, no member, a typed member without exactly one child, another element), `bad_unit` (no id, no
measure), `duplicate_unit`, `dangling_reference`. Null contents are `not_xml`; an instance without facts gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from io import BytesIO
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Namespaces of the public XBRL specifications (fixed values).
XBRLI, XBRLDI, XSI = "{http://www.xbrl.org/2003/instance}", "{http://xbrl.org/2006/xbrldi}", "{http://www.w3.org/2001/XMLSchema-instance}"
#: Facts that are handed over at once, of one document or several.
ROWS = 2000
#: Documents of at most so many bytes are read once, their elements held until their facts are out.
WHOLE = 1 << 20

SCHEMA = (
    "source string, ordinal bigint, concept string, context_ref string, entity string, entity_scheme string, period_type string, period_start string, period_end string, "
    "dimensions array<struct<axis:string,member:string>>, unit string, numerator array<string>, denominator array<string>, value string, decimals string, scale string, sign string, is_nil boolean, error string"
)
_DIMENSION = pa.struct([("axis", pa.string()), ("member", pa.string())])
_TYPES = {"ordinal": pa.int64(), "dimensions": pa.list_(_DIMENSION), "numerator": pa.list_(pa.string()), "denominator": pa.list_(pa.string()), "is_nil": pa.bool_()}
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
ARROW = pa.schema([(n, _TYPES.get(n, pa.string())) for n in NAMES])


class Unsound(ValueError):
    """Why a document is no sound instance."""


class Namespaces(dict):
    """Namespaces by prefix; '' is the default one."""

    def declare(self, prefix: str, uri: str) -> None:
        if self.setdefault(prefix, uri) != uri:
            raise Unsound("rebound_prefix")

    def resolved(self, value: str | None, missing: str) -> str:
        """{namespace}local of a QName value."""
        name = (value or "").strip()
        if not name:
            raise Unsound(missing)
        prefix, colon, local = name.partition(":")
        if colon and prefix not in self:
            raise Unsound("undeclared_prefix")
        uri = self.get(prefix if colon else "")
        local = local if colon else name
        return f"{{{uri}}}{local}" if uri else local


def _children(data: bytes, spaces: Namespaces | None = None) -> Iterator[ElementTree.Element]:
    """The elements right below the root, each whole and gone when the next one comes."""
    root, depth = None, 0
    for event, found in ElementTree.iterparse(BytesIO(data), events=("start-ns", "start", "end")):
        if event == "start-ns":
            if spaces is not None:
                spaces.declare(*found)
        elif event == "start":
            depth += 1
            if root is None:
                root = found
                if root.tag != f"{XBRLI}xbrl":
                    raise Unsound("not_an_instance")
        else:
            depth -= 1
            if depth == 1:
                yield found
                root.remove(found)


def _text(e: ElementTree.Element | None) -> str | None:
    return None if e is None or e.text is None else e.text.strip()


def _dimension(e: ElementTree.Element, spaces: Namespaces) -> tuple[str, str]:
    """(axis, member): the member's name, or [typed]name=text of a typed one, its blanks made single."""
    axis = spaces.resolved(e.get("dimension"), "bad_dimension")
    if e.tag == f"{XBRLDI}explicitMember":
        return axis, spaces.resolved(e.text, "bad_dimension")
    if e.tag == f"{XBRLDI}typedMember" and len(e) == 1:
        return axis, f"[typed]{e[0].tag}={' '.join((e[0].text or '').split())}"
    raise Unsound("bad_dimension")


def _context(e: ElementTree.Element, spaces: Namespaces) -> tuple:
    """entity, scheme, kind and dates of the period, dimensions in order."""
    entity, period = e.find(f"{XBRLI}entity"), e.find(f"{XBRLI}period")
    named = None if entity is None else entity.find(f"{XBRLI}identifier")
    if named is None or named.text is None or not named.get("scheme") or period is None:
        raise Unsound("bad_context")
    instant, start, end = (period.find(f"{XBRLI}{n}") for n in ("instant", "startDate", "endDate"))
    if instant is not None:
        when = "instant", None, _text(instant)
    elif start is not None and end is not None:
        when = "duration", _text(start), _text(end)
    elif period.find(f"{XBRLI}forever") is not None:
        when = "forever", None, None
    else:
        raise Unsound("bad_context")
    members = [m for part in (entity.find(f"{XBRLI}segment"), e.find(f"{XBRLI}scenario")) if part is not None for m in part]
    return named.text.strip(), named.get("scheme"), *when, [{"axis": a, "member": m} for a, m in sorted(_dimension(m, spaces) for m in members)]


def _unit(e: ElementTree.Element, spaces: Namespaces) -> tuple[list[str], list[str]]:
    """Sorted measures above and below the line."""
    measures = lambda part: sorted(spaces.resolved(m.text, "bad_unit") for m in (() if part is None else part.findall(f"{XBRLI}measure")))
    divide = e.find(f"{XBRLI}divide")
    top, bottom = (measures(e), []) if divide is None else (measures(divide.find(f"{XBRLI}unitNumerator")), measures(divide.find(f"{XBRLI}unitDenominator")))
    if not top or (divide is not None and not bottom):
        raise Unsound("bad_unit")
    return top, bottom


def _structure(data: bytes, said: list[ElementTree.Element] | None = None) -> tuple[dict[str, tuple], dict[str, tuple[list[str], list[str]]]]:
    """Contexts and units by id, of a document whose every fact can be read. Elements with a context go to `said`, if given."""
    spaces, held, asked = Namespaces(), [], set()
    for e in _children(data, spaces):
        if said is not None and e.get("contextRef") is not None:
            said.append(e)
        if e.tag in (f"{XBRLI}context", f"{XBRLI}unit"):
            held.append(e)
        elif e.get("contextRef") is not None:
            asked |= {("context", e.get("contextRef")), ("unit", e.get("unitRef"))}
    contexts, units = {}, {}
    for e in held:  # prefixes may be declared further down
        kind = e.tag.removeprefix(XBRLI)
        mine = contexts if kind == "context" else units
        if not e.get("id"):
            raise Unsound(f"bad_{kind}")
        if e.get("id") in mine:
            raise Unsound(f"duplicate_{kind}")
        mine[e.get("id")] = (_context if kind == "context" else _unit)(e, spaces)
    known = {("context", c) for c in contexts} | {("unit", u) for u in units} | {("unit", None)}
    if asked - known:
        raise Unsound("dangling_reference")
    return contexts, units


def facts(source: str | None, data: bytes) -> Iterator[dict]:
    """Rows of one instance, or one row with its error."""
    try:
        if b"<!DOCTYPE" in data or b"<!doctype" in data:
            raise Unsound("doctype")
        said: list[ElementTree.Element] | None = [] if len(data) <= WHOLE else None
        contexts, units = _structure(data, said)
    except (Unsound, ElementTree.ParseError) as why:
        yield {"source": source, "is_nil": False, "error": str(why) if isinstance(why, Unsound) else "not_xml"}
        return
    names = ("entity", "entity_scheme", "period_type", "period_start", "period_end", "dimensions")
    ordinal = 0
    for e in _children(data) if said is None else said:
        ref = e.get("contextRef")
        if ref is None:
            continue
        top, bottom = units.get(e.get("unitRef"), ([], []))
        nil = e.get(f"{XSI}nil") in ("true", "1")
        yield {
            "source": source, "ordinal": ordinal, "concept": e.tag, "context_ref": ref, **dict(zip(names, contexts[ref], strict=True)), "unit": "*".join(top) + ("/" + "*".join(bottom) if bottom else "") or None,
            "numerator": top, "denominator": bottom, "value": None if nil else e.text, "decimals": e.get("decimals"), "scale": e.get("scale"), "sign": e.get("sign"), "is_nil": nil, "error": None,
        }
        ordinal += 1


def xbrl_facts(files: DataFrame, name_col: str = "path", content_col: str = "content") -> DataFrame:
    """Facts of XBRL instances (as from the binaryFile source): a row for each fact, in `ordinal` their order in the document. Documents are parsed where they lie; nothing is
    shuffled."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = ((source.as_py(), data.as_py() or b"") for batch in batches for source, data in zip(batch["source"], batch["content"], strict=True))
        rows = (row for source, data in documents for row in facts(source, data))
        while part := list(islice(rows, ROWS)):
            yield pa.RecordBatch.from_pylist(part, ARROW)

    return files.select(F.col(name_col).cast("string").alias("source"), F.col(content_col).cast("binary").alias("content")).mapInArrow(parse, SCHEMA)
