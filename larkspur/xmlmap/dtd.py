"""A DTD as a graph of elements, attributes and character data.

Content models are simplified to one quantifier for each child: once, optional
or many.  ``+`` counts as ``*``; the members of a choice are optional; a child
named twice is many.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from ..errors import SemanticError

ONCE, OPTIONAL, MANY = "once", "optional", "many"
#: The attribute prefix that sets the SQL type of an element's data or of an attribute.
TYPE_HINT = "DBT"
DEFAULT_SIZE = 255


@dataclass
class Attribute:
    name: str
    required: bool
    is_id: bool = False
    type: str = f"STRING({DEFAULT_SIZE})"
    default: str | None = None


@dataclass
class Element:
    name: str
    children: dict[str, str] = field(default_factory=dict)
    data: bool = False
    data_type: str = f"STRING({DEFAULT_SIZE})"
    attributes: dict[str, Attribute] = field(default_factory=dict)


@dataclass
class DTD:
    root: str
    elements: dict[str, Element]

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "DTD":
        raw = json.loads(text)
        made = {}
        for name, e in raw["elements"].items():
            made[name] = Element(**e | {"attributes": {k: Attribute(**a) for k, a in e["attributes"].items()}})
        return DTD(raw["root"], made)


def _merge(into: dict[str, str], more: dict[str, str]) -> None:
    for name, q in more.items():
        into[name] = MANY if name in into else q


def _scaled(children: dict[str, str], mark: str) -> dict[str, str]:
    if mark in ("*", "+"):
        return dict.fromkeys(children, MANY)
    if mark == "?":
        return {n: OPTIONAL if q == ONCE else q for n, q in children.items()}
    return children


def _content(tokens: list[str]) -> dict[str, str]:
    """The children of one parenthesised group or name, with the mark that follows it."""
    first = tokens.pop(0)
    if first != "(":
        found = {first: ONCE}
    else:
        found, choice = {}, False
        while True:
            _merge(found, _content(tokens))
            sep = tokens.pop(0)
            choice |= sep == "|"
            if sep == ")":
                break
        if choice:
            found = {n: OPTIONAL if q == ONCE else q for n, q in found.items()}
    mark = tokens.pop(0) if tokens and tokens[0] in "*+?" else ""
    return _scaled(found, mark)


def parse_dtd(text: str, root: str | None = None) -> DTD:
    """Element and attribute declarations of a DTD, or of a document's internal subset."""
    doctype = re.search(r"<!DOCTYPE\s+([\w.-]+)\s*\[(.*?)\]\s*>", text, re.S)
    if doctype:
        root, text = root or doctype[1], doctype[2]
    text = re.sub(r"<!--.*?-->", "", text, flags=re.S)
    elements: dict[str, Element] = {}
    for name, model in re.findall(r"<!ELEMENT\s+([\w.-]+)\s+(.*?)>", text, re.S):
        element = elements[name] = Element(name)
        model = model.strip()
        if model == "EMPTY":
            continue
        if model == "ANY":
            raise SemanticError(f"content ANY of {name} has no mapping")
        children = _content(re.findall(r"#?[\w.-]+|[()|,*+?]", model))
        element.data = children.pop("#PCDATA", None) is not None
        if element.data and children:
            raise SemanticError(f"mixed content of {name} has no mapping")
        element.children = children
    for name, body in re.findall(r"<!ATTLIST\s+([\w.-]+)\s+(.*?)>", text, re.S):
        element = elements.get(name)
        if element is None:
            raise SemanticError(f"attributes of undeclared element {name}")
        declared = re.findall(r"([\w.-]+)\s+(\w+|\([^)]*\))\s+(#REQUIRED|#IMPLIED|(?:#FIXED\s+)?(?:\"[^\"]*\"|'[^']*'))", body)
        hints = {a[len(TYPE_HINT) :]: re.sub(r"^#FIXED\s+", "", d)[1:-1] for a, _, d in declared if a.startswith(TYPE_HINT)}
        element.data_type = hints.get("", element.data_type)
        for attr, kind, default in declared:
            if not attr.startswith(TYPE_HINT):
                given = re.sub(r"^#FIXED\s+", "", default)
                value = given[1:-1] if given[0] in "\"'" else None
                element.attributes[attr] = Attribute(attr, default == "#REQUIRED" or value is not None, kind == "ID", hints.get(attr, f"STRING({DEFAULT_SIZE})"), value)
    for element in elements.values():
        for child in element.children:
            if child not in elements:
                raise SemanticError(f"{element.name} contains undeclared element {child}")
    if root is None:
        inner = {c for e in elements.values() for c in e.children}
        root = next((n for n in elements if n not in inner), next(iter(elements), ""))
    return DTD(root, elements)
