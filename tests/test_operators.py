import random

import pytest
from pyspark.sql import functions as F

from weblume.functions import language as lang_f
from weblume.functions import text, urls
from weblume.operators import features, language, links, media, profile, results, roles
from weblume.plans import checks, scan
from weblume.sources import config, html


def values(spark, expr, rows, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in rows], f"v {kind}").select(expr(F.col("v"))).collect()]


def test_cleanse(spark):
    assert values(spark, text.cleanse, ["Apple Pie Co., Ltd", "apple-pies co ltd", "Éclairs à la Crème", "short", "x" * 100, "x" * 101, None]) == ["applepiecoltd", "applepiecoltd", "eclairalacreme", "", "x" * 100, "", None]


def test_scalar_text(spark):
    assert values(spark, text.data_type, ["", " ", None, "1", "-.5e3", "+", ".", "2020-01-31x", "a"]) == ["blank"] * 3 + ["numeric"] * 2 + ["text"] * 2 + ["date", "text"]
    assert values(spark, text.format_integer, ["12", " -3.9 ", "x", "1e3", "", None, "999999999999999999"]) == [12, -3, 0, 1000, 0, 0, 999999999999999999]
    assert values(spark, text.clean_text, ["a&nbsp;\n b  c ", None]) == ["a b c", None]
    assert values(spark, text.xml_escape, ["<a&b>"]) == ["&lt;a&amp;b&gt;"]
    assert values(spark, text.is_utf8, [b"\xc3\xa9", b"\xc3"], "binary") == [True, False]
    assert values(spark, text.key_values, ["Title: a:b\nPages: 3\nx\nTitle: c"]) == [{"Title": "a:bc", "Pages": "3"}]
    line = "".join(chr(97 + i % 26) for i in range(400))
    for column, start in ((0, 0), (24, 0), (25, 25), (199, 25), (250, 200), (401, 0)):
        assert values(spark, lambda c, k=column: text.snippet(c, F.lit(k)), [line]) == [line[start : start + 200]]
    assert values(spark, lambda c: text.metadata_holds(c, ">", "2020-01-31"), ["2020-02-01", "2020-01-31", "x", None]) == [True, False, False, False]


def test_languages(spark):
    assert values(spark, lang_f.iso_639_2, ["EN-ca", "de", "fra", "zho", "xx"]) == ["eng", "ger", "fra", "chi", "xx"]
    assert values(spark, lang_f.language_valid, ["en", "en-CA", "en-ca", "eng", "x-klingon", "EN", "", None, "fr-abcd"]) == [True, False, True, False, False, False, False, False, True]


def test_addresses(spark):
    assert values(spark, lambda c: urls.absolute(c, F.lit("http://h/d/p?q")), ["x", "../y", "/z", "?a", "#f", "http://o/"]) == ["http://h/d/x", "http://h/y", "http://h/z", "http://h/d/p?a", "http://h/d/p?q#f", "http://o/"]
    assert values(spark, lambda c: urls.rooted(c, F.lit("http://h/d/p")), ["/z", "//o/x", "mailto:a", "x"]) == ["http://h/z", "http://o/x", "mailto:a", None]
    assert urls.xml_base("http://h") == "http://h/" and urls.xml_base("http://h/a/b") == "http://h/a/" and urls.xml_base("http://h/a/") == "http://h/a/"
    got = spark.createDataFrame([("text/html; x", "u"), ("text/css", "u"), ("application/pdf", "u"), ("x/y", "a/b.XML?q"), ("x", "u")], "m string, u string")
    assert [r[0] for r in got.select(urls.mime_branch(F.col("m"), F.col("u"))).collect()] == ["html", "css", "pdf", "xml", "none"]


CELLS = [("h", 1, "Apple Pie Co."), ("h", 2, "apple-pie co"), ("h", 3, "Yes"), ("h", 4, "yes"), ("h", 5, "x" * 120), ("h", 6, "Apple Pie Co."), ("n", 1, "3"), ("n", 2, " "), ("n", 3, "10.5"), ("n", 4, None)]


def test_profiles(spark):
    table = spark.createDataFrame(CELLS, "heading string, line int, value string")
    rows = {r["line"]: r for r in profile.consistency(table).where("heading = 'h'").collect()}
    assert [(rows[i]["match"], rows[i]["other_data"], rows[i]["other_line"]) for i in range(1, 7)] == [(True, "", -1), (False, "Apple Pie Co.", 1), (True, "", -1), (False, "Yes", 3), (True, "", -1), (True, "", -1)]
    kinds = {(r["heading"], r["type"]): (r["n"], r["first_data"], r["first_line"]) for r in profile.type_counts(table).collect()}
    assert kinds["n", "numeric"] == (2, "3", 1) and kinds["n", "blank"] == (2, " ", 2) and kinds["h", "text"][0] == 6
    n = {r["heading"]: r for r in profile.profile(table).collect()}
    assert (n["n"]["type"], n["n"]["non_blank"], n["n"]["sum"], n["n"]["max_number"]) == ("numeric", 2, 13.5, 10.5) and (n["h"]["type"], n["h"]["sum"], n["h"]["first_data"]) == ("text", 0.0, "Apple Pie Co.")
    pairs = spark.createDataFrame([(1, "A", "x"), (2, "a", "x"), (3, "A", "y"), (4, "A", "z" * 99), (5, "A", "x"), (6, "a\nb", "1"), (7, "a b", "1")], "line int, a string, b string")
    got = {r["line"]: (r["match"], r["first_data"], r["other_data"], r["first_line"]) for r in profile.pair_consistency(pairs, "line", "a", "b").collect()}
    assert got == {1: (True, "", "", -1), 2: (False, "A", "x", 1), 3: (False, "A", "x", 1), 4: (True, "", "", -1), 5: (True, "", "", -1), 6: (True, "", "", -1), 7: (True, "", "", -1)}


def plain_grams(t):
    import re
    from collections import Counter

    words = re.split(r"[0-9\t-\r ]+", t)
    while words and not words[-1]:
        words.pop()
    c = Counter()
    for w in (f"_{w}_" for w in words):
        if len(w) <= 25:
            c.update(w[i : i + n] for n in range(1, 6) for i in range(len(w) - n + 1))
    return sorted(c.items(), key=lambda x: (-x[1], x[0]))[:400]


@pytest.mark.parametrize("t", ["", "12 3 ", " ab ab3cd  ", "a" * 24 + " b", "12 x", "the cat the"])
def test_grams(spark, t):
    df = spark.createDataFrame([(1, t)], "id int, t string")
    got = [(r["ngram"], r["n"]) for r in language.top_grams(df, "id", F.col("t")).orderBy("rank").collect()]
    assert got == plain_grams(t) and language.ranked(t) == [g for g, _ in got]


def test_language_guess(spark):
    rng = random.Random(1)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(400))
    df = spark.createDataFrame([(1, "xx", make("abcde")), (2, "yy", make("vwxyz")), (3, "xx", "short"), (4, None, None), (5, "zz", make("abcde"))], "id int, lang string, text string")
    models = language.train(df.where("id in (1, 2)"))
    got = {r["id"]: (r["lang"], r["status"]) for r in language.guess(df, models, "id", "text").collect()}
    assert got == {1: ("xx", 0), 2: ("yy", 0), 3: ("", -1), 4: ("", -1), 5: ("xx", 0)}
    assert language.choose({"a": 100, "b": 101}) == ("", -2) and language.choose({"a": 100, "b": 103}) == ("a", 0) and language.choose({"b": 5}) == ("b", 0)


def test_models_count_whole_texts(spark, tmp_path):
    from weblume.catalogue import QUERIES

    docs = spark.createDataFrame([(1, "xx", "ab " * 9000 + "zq " * 9001)], "doc_id long, lang string, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert language.train(docs)["xx"]["_zq"] < language.train(docs)["xx"]["_ab"]
    assert {r["ngram"]: r["n"] for r in QUERIES["language_models"](spark, str(tmp_path)).collect()}["_zq_"] == 9001


def test_readability(spark):
    words = "The beautiful animals are running. " * 5
    (r,) = language.readability(spark.createDataFrame([(1, words)], "id int, t string"), "id", F.col("t")).collect()
    assert (r["words"], r["sentences"], r["complex_words"], r["syllables"]) == (25, 5, 10, 50)
    assert r["fog"] == int(0.4 * (5 + 40)) and r["kincaid"] == int(0.39 * 5 + 11.8 * 2 - 15.59)
    short = language.readability(spark.createDataFrame([(1, "Hi."), (2, None)], "id int, t string"), "id", F.col("t")).collect()
    assert all(r["fog"] == r["kincaid"] == -1 for r in short)


def pages(spark, *bodies):
    return spark.createDataFrame([(i, f"http://h/{i}", b) for i, b in enumerate(bodies)], "page_id long, url string, html string")


def test_page_operators(spark):
    df = pages(spark, '<html><body><a href="#x" id=y>t</a><a href="#y">u</a><a href=a.pdf target="_BLANK">p</a><p class="k">q</p></body>', None, "<style>p{background:url(i.png)}</style><a href=a.pdf>z</a>")
    facts = html.parse_pages(df).cache()
    every = facts.select("page_id", F.inline("links"))
    assert [tuple(r) for r in links.broken_anchors(facts).select("page_id", "fragment").collect()] == [(0, "x")]
    elements = facts.select("page_id", F.inline("elements"))
    made = features.of_elements(elements)
    got = {(r["page_id"], r["feature"]): r["n"] for r in features.counts(made, spark.createDataFrame([("a",), ("PDF href",), ("New window",), ('class="k"',)], "feature string")).collect()}
    assert got == {(0, "a"): 3, (0, "PDF href"): 1, (0, "New window"): 1, (0, 'class="k"'): 1, (2, "a"): 1, (2, "PDF href"): 1}
    assert [r["href"] for r in links.style_links(df).collect()] == ["i.png"]
    assert links.shared_targets(every).first()["href"] == "a.pdf" and links.inconsistent_texts(every).first()["texts"] == 2
    typed = every.withColumn("mime_type", F.lit("text/html"))
    assert features.link_features(typed).count() == 2
    docs = spark.createDataFrame([("u", "text/css"), ("v.xml", "x")], "url string, mime_type string")
    assert {k: v.count() for k, v in links.by_branch(docs).items()} == {"html": 0, "css": 1, "pdf": 0, "xml": 1}


def test_sections_decide_feature_counts(spark):
    rows = spark.createDataFrame([(1, "PAGE", "a", 1, 0), (1, "CONTENT", "a", 5, 2), (1, "CONTENT", "a", 4, 9), (2, "PAGE", "a", 3, 0)], "page_id int, section string, feature string, line_no int, column_no int")
    assert {(r["page_id"], r["section"], r["n"], r["line_no"], r["column_no"]) for r in features.counts(rows).collect()} == {(1, "CONTENT", 2, 4, 9), (2, "PAGE", 1, 3, 0)}


def plain_fps(delays, loops):
    total, n = sum(delays), len(delays)
    if total <= 1.0:
        return n * loops
    times = 1 if loops == 1 else 2 if total >= 1 else min(max(int(2 / total), 2), loops)
    laid, best = delays * times, 1
    for i in range(len(laid)):
        s, c = 0.0, 0
        for x in laid[i:]:
            if s + x > 1.0:
                break
            s, c = s + x, c + 1
        best = max(best, c)
    return best


def test_frames_of_whole_animations(spark):
    from weblume.catalogue import QUERIES

    rng = random.Random(5)
    rows = [([rng.choice((0.1, 0.2, 0.7, 0.3, 0.0, 1.5, 1 / 60)) for _ in range(rng.randrange(1, 60))], rng.randrange(1, 4)) for _ in range(60)] + [([0.1] * 4000, 1), ([1 / 60] * 300, 2)]
    df = spark.createDataFrame([(i, d, n) for i, (d, n) in enumerate(rows)], "id int, d array<double>, n int")
    assert [r[0] for r in df.orderBy("id").select(media.frames_per_second(F.col("d"), F.col("n"))).collect()] == [plain_fps(d, n) for d, n in rows]
    got = QUERIES["animation_frames"](spark, "/root/testdata/sf0.01").collect()
    assert sum(r["shown_s"] for r in got) == 1500 * 0.25 and {r["fps"] for r in got} == {4}


def test_frames(spark):
    rows = [([0.25] * 4, 3), ([0.5, 0.75, 0.125, 0.125, 0.25], 1), ([0.5, 0.75, 0.125, 0.125, 0.25], 4), ([2.0, 3.0], 2), ([0.125] * 20, 9999)]
    df = spark.createDataFrame([(i, d, n) for i, (d, n) in enumerate(rows)], "id int, d array<double>, n int")
    assert [r[0] for r in df.orderBy("id").select(media.frames_per_second(F.col("d"), F.col("n"))).collect()] == [plain_fps(d, n) for d, n in rows]
    assert spark.createDataFrame([([], 1)], "d array<double>, n int").select(media.frames_per_second(F.col("d"), F.col("n"))).first()[0] == 0
    assert values(spark, lambda c: media.pixels(c, F.lit(200)), ["10", "10px", "50%", "x", None]) == [10.0, 10.0, 100.0, -1.0, -1.0]


def test_results(spark):
    rows = results.union(results.results(spark.range(3), "A", url=F.col("id").cast("string"), line_no=F.col("id")), results.results(spark.range(1), "B", url="0"))
    assert rows.schema["line_no"].dataType.simpleString() == "int" and rows.where("testcase = 'B'").first()["page_no"] == -1
    assert results.capped(rows, "testcase", "url", 2).count() == 3
    helped = results.with_help(rows, spark.createDataFrame([("A", "http://h")], "t string, u string"))
    assert {(r["testcase"], r["help_url"]) for r in helped.collect()} == {("A", "http://h"), ("B", "")}
    profile_ = spark.createDataFrame([("p", "B"), ("q", "A")], "profile string, tcid string")
    assert results.selected(rows, profile_, "p").count() == 1
    scores = results.faults(rows, spark.createDataFrame([("0",), ("9",)], "url string"))
    assert {tuple(r) for r in scores.collect()} == {("0", 2, 98), ("9", 0, 100)} and results.scan_score(scores).first()["faults_per_page"] == 1.0


RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:role="http://x#">
<owl:Class rdf:ID="list"><rdfs:subClassOf rdf:resource="#section"/><role:mustContain rdf:resource="#listitem"/></owl:Class>
<owl:Class rdf:ID="slider"><role:requiredState rdf:resource="http://s#aria-valuenow"/><role:scope rdf:resource="#group"/></owl:Class><owl:Class rdf:ID="main"><rdfs:subClassOf rdf:resource="#landmark"/></owl:Class></rdf:RDF>"""


def test_roles(spark):
    rows = config.aria_roles(RDF)
    assert [(r["id"], r["landmark"]) for r in rows] == [("list", False), ("slider", False), ("main", True)] and rows[0]["must_contain"] == ["listitem"]
    facts = html.parse_pages(pages(spark, "<div role=slider></div><div role=main></div><div role=odd></div><p>"))
    told = roles.described(facts.select("page_id", F.inline("elements")), roles.taxonomy(spark, rows)).cache()
    assert {(r["role"], r["known"], r["landmark_role"]) for r in told.collect()} == {("slider", True, False), ("main", True, True), ("odd", False, False)}
    assert [r["property"] for r in roles.missing_properties(told).collect()] == ["aria-valuenow"]


def test_family_checks(spark):
    df = spark.createDataFrame([
        (1, "http://h/a-eng.html", '<html lang=fr><title>A  b</title><meta name="DC.title" content="a B"><a href="http://10.0.0.1/x">x</a><script>G-ABCDEF1 UA-12345-1 G-ABCDEF1</script>'),
        (2, "http://h/b_f.html", '<html lang=fr><title>T</title><meta name=dcterms.title content=U><a href="mailto:a@b">m</a>')], "page_id long, url string, html string")
    facts = html.parse_pages(df).cache()
    every = facts.select("page_id", "url", F.inline("links"))
    said = lambda rows: sorted((r["testcase"], r["url"][-10:], r["message"]) for r in rows.collect())
    assert said(checks.ipv4_links(every)) == [("IPV4_LINK", "a-eng.html", "http://10.0.0.1/x")]
    assert said(checks.title_matches(facts)) == [("TITLE_DCTERMS_TITLE_MATCH", "h/b_f.html", "U / T")]
    assert said(checks.url_languages(facts)) == [("CONTENT_URL_LANGUAGE", "a-eng.html", "eng / fra")]
    assert said(checks.analytics(df)) == [("WA_ID", "a-eng.html", "G-ABCDEF1"), ("WA_ID", "a-eng.html", "UA-12345-1"), ("WA_MULTIPLE", "a-eng.html", "G-ABCDEF1, UA-12345-1")]
    assert said(checks.pattern_hits(every, [("TP_PW_MAILTO", "^mailto:")], "href")) == [("TP_PW_MAILTO", "h/b_f.html", "mailto:")]


def test_scans(spark):
    df = pages(spark, "<title>T</title><a href='#no'>x</a><h1>a</h1><h1>a</h1>", "<html lang=en><title>T</title>")
    assert sorted((r["testcase"], r["url"]) for r in scan.web(df).collect()) == [("BROKEN_ANCHOR", "http://h/0"), ("DUPLICATE_HEADINGS", "http://h/0"), ("DUPLICATE_TITLES", "http://h/1"), ("NO_LANG", "http://h/0")]
    rows = spark.createDataFrame([(1, "Yes", None), (2, "yes", None)], "line int, a string, b string")
    terms = spark.createDataFrame([("a", "^Y")], "term string, regex string")
    assert sorted((r["testcase"], r["description"], r["line_no"]) for r in scan.open_data(rows, "line", ["a", "b"], terms).collect()) == [("OD_DATA", "b", -1), ("TP_PW_OD_CONT_CONSISTENCY", "a", 2), ("TP_PW_OD_DD", "a", 2)]


def test_crawl_planning(spark):
    from weblume.operators import crawl

    requests = spark.createDataFrame([(1, "http://A.org/x"), (2, "http://a.org/private/y"), (3, "http://b.org/"), (4, "http://a.org/z")], "n int, url string")
    robots = spark.createDataFrame([("a.org", "User-agent: *\nDisallow: /private")], "host string, robots string")
    got = {r["n"]: (r["allowed"], r["start_s"]) for r in crawl.schedule(crawl.allowed(requests, robots), "n", 0.5).collect()}
    assert got == {1: (True, 0.0), 2: (False, 30.0), 3: (True, 0.0), 4: (True, 60.0)}
    hits = spark.createDataFrame([(f"k{i}", h) for i, h in enumerate([1, 1, 2, 3, 3, 9])], "key string, hits int")
    assert crawl.trimmed(hits, 6, 2).count() == 6 and sorted(r["hits"] for r in crawl.trimmed(hits, 5, 3).collect()) == [3, 3, 9] and sorted(r["hits"] for r in crawl.trimmed(hits, 5, 2).collect()) == [9]


def test_snippets_of_all_lines(spark):
    from weblume.catalogue import QUERIES

    lines = {(r["doc_id"], i): v for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() for i, v in enumerate(r["text"].split("\n"))}
    got = QUERIES["source_snippet"](spark, "/root/testdata/sf0.001").where("col = 0").collect()
    assert {(r["doc_id"], r["line_no"]): r["snippet"] for r in got} == {k: v[:200] for k, v in lines.items()} and len(got) == len(lines) > 1000


def plain_texts(page):
    """{language: characters of text} and the paragraphs of a page, token by token, from patterns alone."""
    import html as entities
    import re

    from weblume import dims

    tokens = re.findall(r"(?s)<!--.*?-->|<!DOCTYPE[^>]*>|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|</?[a-z][^>]*>|[^<]+", page)
    said, held, paragraphs = [], None, []

    def end():
        text = re.sub(r"\s+", " ", held)
        text = re.sub(r"[:;]\s*$", ".", text)
        if not text.rstrip().endswith("."):
            text = text[:-1] + ".." if text.endswith(" ") else text + "."
        paragraphs.append(text + "\n\n")

    for t in tokens:
        name = (re.match(r"</?([a-z0-9]+)", t) or [None, ""])[1]
        if t.startswith(("<!", "<script", "<style")):
            continue
        if not t.startswith("<"):
            text = entities.unescape(t)
            held = None if held is None else held + text
            if text.strip():
                said.append(text)
        elif name == "p" and not t.startswith("</") or t.startswith("</") and (name == "p" or name in dims.PARAGRAPH_ENDERS):
            if held is not None:
                end()
            held = None if t.startswith("</") else ""
    if held is not None:
        end()
    return len(re.sub(r"\s+", " ", " ".join(said).replace("\xa0", " ")).strip()), len("".join(paragraphs))


def test_page_texts_equal_a_plain_reading(spark):
    from weblume.catalogue import QUERIES

    sf = "/root/testdata/sf0.01"
    got = {r["page_id"]: r for r in QUERIES["page_texts"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(rows) > 200
    for r in rows:
        chars, paragraphs = plain_texts(r["html"])
        assert (got[r["page_id"]]["chars"], got[r["page_id"]]["paragraph_chars"]) == (chars, paragraphs), r["page_id"]


def test_numbers_within_keys(spark):
    """Numbers of a hot key run over many ranges; ties and null keys."""
    from weblume.shared import numbered

    rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 7}", i * 7919 % 2000) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, o long")
    got = numbered(df, "k", ["o"], "n").collect()
    held = {}
    for r in sorted(got, key=lambda r: r["n"]):
        held.setdefault(r["k"], []).append((r["n"], r["o"]))
    assert len(got) == 2000 and {r["k"] for r in got} == {k for k, _ in rows}
    for k, v in held.items():
        assert [n for n, _ in v] == list(range(len(v))) and [o for _, o in v] == sorted(o for x, o in rows if x == k)


def test_most_in_a_window_over_spans(spark):
    """Windows that reach back over the edge of a span."""
    rng = random.Random(3)
    edge = 1_700_006_400  # a day's first second
    rows = [(k, edge + rng.uniform(-90, 90)) for k in ("a", "b") for _ in range(200)] + [("c", edge - 86_400.0), ("c", float(edge)), ("d", edge - 0.5), ("d", edge + 0.5)]
    df = spark.createDataFrame(rows, "k string, t double").selectExpr("k", "timestamp_micros(cast(t * 1000000 as bigint)) AS ts", "cast(t * 1000000 as bigint) AS u")
    times = {}
    for r in df.collect():
        times.setdefault(r["k"], []).append(r["u"])
    want = {k: max(sum(0 <= t - x <= 60_000_000 for x in v) for t in v) for k, v in times.items()}
    assert {r["k"]: r["most"] for r in media.most_in_window(df, "k", "ts", 60).collect()} == want


def test_features_counted_in_the_parse(spark):
    """Features of the parse against those of the elements: counts, sections and first places, with and without a profile."""
    df = pages(spark, '<a href="x.pdf" target=_BLANK>a</a>\n<div role="main"><a class=k href=y>b</a><i class="k"></i></div>', "<p><p class=k>\n<br><br>", None, '<b a="1" a="2" c></b>')
    elements = html.parse_pages(df, wanted=("elements",)).select("page_id", F.inline("elements"))
    for profile in (["a", "br", 'class="k"', "PDF href", "New window", "p", "nothing"], None):
        named = None if profile is None else spark.createDataFrame([(x,) for x in profile], "feature string")
        want = {tuple(r) for r in features.counts(features.of_elements(elements), named).collect()}
        got = {tuple(r) for r in features.of_pages(html.parse_pages(df, wanted=("features",), profile=profile)).collect()}
        assert got == want and got
    tags = ["a", "br", "p", "table"]
    assert {tuple(r) for r in features.tags_of_pages(html.parse_pages(df, wanted=("tags",), profile=tags)).collect()} == {tuple(r) for r in features.tag_counts(elements, tags).collect()}
    assert "features" not in html.parse_pages(df).columns


def test_ranker_forgets_and_orders(spark, monkeypatch):
    """Ranks don't depend on what was met before, on batches, or on what is forgotten; odd characters keep their order."""
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abz~!_\x7f\x01") for _ in range(rng.randint(0, 28))) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    models = {"x": {"a": 1, "_b": 2, "\u00e9": 3, "toolong": 4}, "y": {"zz": 1, "a": 2}}
    plain = [language.Ranker(models).distances(language.split_words(t)) for t in texts]
    monkeypatch.setattr(language.Ranker, "WORDS", 50)
    one = language.Ranker(models)
    assert [one.distances(language.split_words(t)) for t in texts] == plain
    for t in texts:
        assert language.ranked(t) == [g for g, _ in plain_grams(t)][: language.GRAMS]
