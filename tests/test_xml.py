"""XML as rows against the standard library's tree, on random, awkward and malformed documents."""

import random
from xml.etree import ElementTree

from dossierlake.sources import xml as x


def local(tag):
    return tag.rpartition("}")[2]


def plain(text, depth=12):
    try:
        root = ElementTree.fromstring(text.lstrip("﻿"))
    except ElementTree.ParseError:
        return [(None, None)]
    out = []

    def walk(node, path, level):
        if level > depth:
            return
        here = f"{path}.{local(node.tag)}" if path else local(node.tag)
        out.extend((f"{here}[@{local(k)}]", v.strip()) for k, v in node.attrib.items() if v.strip())
        if node.text and node.text.strip():
            out.append((here, node.text.strip()))
        for child in node:
            walk(child, here, level + 1)

    walk(root, "", 0)
    return out


def flat(spark, texts):
    df = spark.createDataFrame([(i, t, "p", 1) for i, t in enumerate(texts)], "doc_id long, xml string, path string, seq int")
    out = {}
    for r in x.xml_flatten(df).orderBy("doc_id", "seq").collect():
        out.setdefault(r.doc_id, []).append((r.path, r.value))
    return [out.get(i, []) for i in range(len(texts))]


GOOD = [
    "<a/>", "<a></a>", " <?xml version='1.0'?><a>x</a> ".strip(), "<a>x<!-- c -->y<b>z</b>tail</a>", "<a><b>1</b>tail<b>2</b></a>", "<a x='1' y=\"2\" z=' '/>", "<a>&lt;&amp;lt;&gt;&#65;&#x42;&#233;&#128512;&quot;&apos;</a>",
    "<a b='&#x3c;&amp;'/>", "<a><![CDATA[<not> & a tag]]> and</a>", "<n:a xmlns:n='u' n:k='v'><n:b>t</n:b></n:a>", "<a xmlns='http://hl7.org/fhir'><b c = 'd' ></b ></a>", "﻿<a>bom</a>", "<a>\n  <b>\n t \n</b>\n</a>", "<é ü='ß'>ñ</é>", "<a.b-c_d><x1/></a.b-c_d>",
    "<a><?pi some?><b/><!-- <c> --></a>", "<a>" * 20 + "deep" + "</a>" * 20, "<r>" + "<a><b>t</b></a>" * 400 + "</r>", "<a><b/>after</a>", "<a><a><a>in</a></a><a>out</a></a>", "<a>" + "long " * 50_000 + "</a>",
]
BAD = ["<a>", "</a>", "<a></b>", "<a><b></a></b>", "<a/><b/>", "text", "<a/>text", "<a b=c/>", "<a b='1' b='2'/>", "<a", "<a>&nope;</a>", "<a>&</a>", "< a/>", "<a><b></b>", "<a>]</a><", "<1a/>", "<a>]]></a>", "<a><!-- x -- y --></a>", "<a><!- x --></a>", "<a><![CDAT[x]]></a>"]


def test_documents_against_a_tree(spark):
    assert flat(spark, GOOD) == [plain(t) for t in GOOD]
    assert flat(spark, BAD) == [plain(t) for t in BAD] == [[(None, None)]] * len(BAD)


def test_random_documents(spark):
    rng = random.Random(4)

    def node(level):
        name = rng.choice("abc")
        attrs = "".join(f' {k}="{rng.choice(["", " v ", "1", "&lt;"])}"' for k in rng.sample("pqr", rng.randrange(3)))
        inner = "".join(rng.choice(["t", " ", "&amp;", "<!-- -->", "<![CDATA[<]]>", node(level + 1) if level < 15 and rng.random() < 0.7 else "x"]) for _ in range(rng.randrange(4)))
        return f"<{name}{attrs}/>" if not inner and rng.random() < 0.5 else f"<{name}{attrs}>{inner}</{name}>"

    texts = [node(0) for _ in range(300)]
    # some lose a character
    texts += [t[:at] + t[at + 1 :] for t in texts[:150] for at in [rng.randrange(len(t))]]
    got, want = flat(spark, texts), [plain(t) for t in texts]
    assert [(t, g, w) for t, g, w in zip(texts, got, want, strict=True) if g != w] == []
    assert sum(w == [(None, None)] for w in want) > 30


def test_nulls_repeated_ids_and_clinical_documents(spark):
    fhir = '<Bundle><x:e xmlns:x="u" x:value="1"/><e value="2">t</e><text value="no"><div>d</div><p value="yes"/></text><e>u</e><z code=""/></Bundle>'
    rows = [(1, fhir), (2, "<other value='1'/>"), (3, '<o xmlns="http://hl7.org/fhir"><k url="w"/></o>'), (4, None), (5, " "), (6, "<a/>"), (6, "<b/>"), (None, "<c/>")]
    df = spark.createDataFrame(rows, "doc_id long, xml string")
    assert {(r.doc_id, r.key, r.value) for r in x.fhir_flatten(df).collect()} == {(1, "e.value", "1"), (1, "e", "t"), (1, "p.value", "yes"), (3, "k.url", "w")}
    _, bad = x.xml_elements(df)
    assert sorted(((r.doc_id, r.error) for r in bad.collect()), key=str) == [(4, "empty"), (5, "empty"), (6, "id"), (None, "id")]
    assert x.xml_flatten(df.limit(0)).collect() == [] and x.fhir_flatten(df.limit(0)).collect() == []
