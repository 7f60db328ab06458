import pytest

from mapql.ql import syntax as s


def test_query_with_filters():
    q = s.parse('node.a.b["k"="v"](1,2,3,4)(bn.x:role)->.out;').body[0]
    assert (q.type, q.sets, q.into) == ("node", ["a", "b"], "out")
    assert [f.kind for f in q.filters] == ["equals", "bbox", "recurse"]
    assert q.filters[2].args == {"edge": "bn", "set": "x", "role": "role"}


@pytest.mark.parametrize(("text", "kind"), [("[k]", "present"), ("[!k]", "absent"), ("[k!=v]", "differs"), ("[k~v]", "match"), ("[k!~v]", "no_match"), ('[~"k"~"v",i]', "key_match")])
def test_tag_filters(text, kind):
    assert s.parse(f"node{text};").body[0].filters[0].kind == kind


def test_four_numbers_are_a_box_and_others_ids():
    assert s.parse("node(1,2,3,4);").body[0].filters[0].kind == "bbox"
    assert s.parse("node(1,2,3);").body[0].filters[0].args == {"ids": [1, 2, 3]}


def test_bare_words_glue():
    assert s.parse("node[addr:street=foo-bar];").body[0].filters[0].args == {"key": "addr:street", "value": "foo-bar"}


def test_settings_and_defaults():
    p = s.parse('[out:csv(::id,name;false;"|")][timeout:5][bbox:1,-2,3,4];node;')
    assert p.settings.csv_fields == ["::id", "name"] and not p.settings.csv_header and p.settings.csv_separator == "|"
    assert p.settings.bbox == (1, -2, 3, 4) and p.settings.timeout == 5
    assert s.parse("node;").settings.out == "xml"


def test_blocks_and_groups():
    body = s.parse("(node;way;)->.u; (.u; - node(1);); foreach.u->.e { .e out; } if (count(nodes) > 1) { out; } else { node; }").body
    assert [type(b).__name__ for b in body] == ["Union", "Difference", "Foreach", "If"]


def test_precedence():
    e = s.parse_expression('1+2*3==7?"a":"b"')
    assert isinstance(e, s.Ternary) and e.condition.op == "==" and e.condition.left.op == "+"


def test_escapes_and_comments():
    assert s.parse('node["a\\u0041\\n"="\\q"]; // x\n/* y */').body[0].filters[0].args == {"key": "aA\n", "value": "q"}


@pytest.mark.parametrize("text", ["node", "node[", "node(;", "[out:json]", 'node["a]', "frob;", "(node; - ;);", "[nope:1];node;"])
def test_parse_errors_have_lines(text):
    with pytest.raises(s.ParseError, match="line 1: parse error"):
        s.parse(text)


def test_unsupported():
    with pytest.raises(s.UnsupportedError):
        s.parse("complete { node; }")
