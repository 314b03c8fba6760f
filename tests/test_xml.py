import pytest

from larkspur.engine import Engine
from larkspur.errors import SemanticError
from larkspur.xmlmap.dtd import DTD, parse_dtd
from larkspur.xmlmap.mapping import create, find, load, load_text, path_query, statements, to_text

DOC = """<?xml version="1.0"?>
<!DOCTYPE shelf [
<!-- <!ELEMENT never (here)> -->
<!ELEMENT shelf (label, item*, owner?)>
<!ELEMENT label (#PCDATA)>
<!ATTLIST label DBT CDATA #FIXED "STRING(40)">
<!ELEMENT item (writer+, (price|gift))>
<!ATTLIST item code ID #REQUIRED state CDATA #IMPLIED DBTstate CDATA #FIXED "STRING(9)">
<!ELEMENT writer (#PCDATA)>
<!ELEMENT price (#PCDATA)>
<!ELEMENT gift EMPTY>
<!ELEMENT owner EMPTY>
]>
<shelf><label>Top</label>
<item code="b1" state="new"><writer>Ann</writer><writer>Ben</writer><price>3</price></item>
<item code="b2"><writer>Cem</writer><gift/></item>
</shelf>"""


def test_content_models():
    dtd = parse_dtd(DOC)
    assert dtd.root == "shelf"
    assert dtd.elements["shelf"].children == {"label": "once", "item": "many", "owner": "optional"}
    assert dtd.elements["item"].children == {"writer": "many", "price": "optional", "gift": "optional"}
    assert dtd.elements["label"].data_type == "STRING(40)" and dtd.elements["item"].attributes["state"].type == "STRING(9)"
    assert DTD.from_json(dtd.to_json()) == dtd
    assert parse_dtd("<!ELEMENT a (b, b)><!ELEMENT b EMPTY>").elements["a"].children == {"b": "many"}
    for bad in ("<!ELEMENT a ANY>", "<!ELEMENT a (#PCDATA|b)*><!ELEMENT b EMPTY>", "<!ELEMENT a (b)>"):
        with pytest.raises(SemanticError):
            parse_dtd(bad)


def test_tables():
    made = statements(parse_dtd(DOC))
    assert "CREATE TABLE E_shelf (id UINT PRIMARY KEY, E_label UINT, E_owner UINT);" in made
    assert "CREATE TABLE E_item (id UINT PRIMARY KEY, E_price UINT, E_gift UINT, A_code STRING(255), A_state STRING(9), A_state_P INT);" in made
    assert "CREATE TABLE E_shelf__to__E_item (id UINT PRIMARY KEY, E_shelf UINT FOREIGN KEY(E_shelf,id), E_item UINT);" in made
    assert "CREATE INDEX ON E_item (A_code);" in made


def test_round_trip(spark):
    dtd, e = parse_dtd(DOC), Engine(spark)
    create(e, dtd)
    counts = load_text(e, dtd, DOC)
    assert counts["E_item"] == 2 and counts["E_item__to__E_writer"] == 3
    assert [x.text for x in find(e, dtd, "/shelf/item/writer")] == ["Ann", "Ben", "Cem"]
    items = find(e, dtd, "/shelf/item")
    assert to_text(items[:1]) == '<item code="b1" state="new"><writer>Ann</writer><writer>Ben</writer><price>3</price></item>'
    assert items[1].get("state") is None and items[1].find("gift") is not None
    assert [x.text for x in find(e, dtd, "/shelf/item[code='b2']/writer")] == ["Cem"]
    assert find(e, dtd, "/shelf/owner") == []
    for bad in ("/shelf/writer", "shelf", "/shelf[none='x']", "/nothing"):
        with pytest.raises(SemanticError):
            path_query(dtd, bad)


def test_many_documents(spark):
    dtd, e = parse_dtd(DOC), Engine(spark)
    create(e, dtd)
    load(e, dtd, spark.createDataFrame([(i, DOC.replace("Ann", f"Ann{i}")) for i in range(3)], "doc_no int, xml string"))
    assert [x.text for x in find(e, dtd, "/shelf/item/writer")][::3] == ["Ann0", "Ann1", "Ann2"]
    assert e.procedure("COUNT('SELECT FROM E_item');") == 6


def test_long_ids(spark):
    dtd, e = parse_dtd(DOC), Engine(spark)
    create(e, dtd, "LONG")
    load_text(e, dtd, DOC, doc_no=1 << 30)
    assert [x.text for x in find(e, dtd, "/shelf/item/writer")] == ["Ann", "Ben", "Cem"]
    small = Engine(spark)
    create(small, dtd)
    with pytest.raises(SemanticError):
        load_text(small, dtd, DOC, doc_no=1 << 30)
