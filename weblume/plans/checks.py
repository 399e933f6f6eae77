"""Checks of single families whose rules are plain data: patterns, titles, addresses, analytics. Each yields result rows.

Their names are public test-case ids; where no rule is known beyond the name, the rule here is the one in the docstring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import language as lang_f
from ..operators import profile as profile_o
from ..operators.results import results, union

#: Ids of analytics services in a page.
ANALYTICS = r"\b(UA-\d{4,}-\d+|G-[A-Z0-9]{6,})\b"


def ipv4_links(links: DataFrame) -> DataFrame:
    """IPV4_LINK: the host of a link is an IPv4 address."""
    bad = links.where(F.col("abs_url").rlike(r"^https?://\d{1,3}(\.\d{1,3}){3}([:/?#]|$)"))
    return results(bad, "IPV4_LINK", url=F.col("url"), line_no=F.col("line_no"), column_no=F.col("column_no"), message=F.col("abs_url"))


def pattern_hits(rows: DataFrame, patterns: list[tuple[str, str]], text: str, url: str = "url") -> DataFrame:
    """Rows whose text matches the pattern of a test case (its test data); each row is read once for all patterns."""
    hits = F.filter(F.array(*[F.struct(F.lit(t).alias("testcase"), F.regexp_extract(F.col(text), f"({p})", 1).alias("hit")) for t, p in patterns]), lambda x: x["hit"] != "")
    found = rows.select(F.col(url).alias("url"), F.inline(hits))
    return results(found, F.col("testcase"), url=F.col("url"), message=F.col("hit"))


def title_matches(facts: DataFrame) -> DataFrame:
    """TITLE_DC_TITLE_MATCH, TITLE_DCTERMS_TITLE_MATCH: a page's title differs from its metadata's (but for case and spaces)."""
    rows = facts.select("url", "title", F.inline("metadata"))
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    parts = []
    for name, testcase in (("dc.title", "TITLE_DC_TITLE_MATCH"), ("dcterms.title", "TITLE_DCTERMS_TITLE_MATCH")):
        bad = rows.where((F.lower("name") == name) & (plain(F.col("content")) != plain(F.col("title"))))
        parts.append(results(bad, testcase, url=F.col("url"), line_no=F.col("line_no"), column_no=F.col("column_no"), message=F.concat("content", F.lit(" / "), "title")))
    return union(*parts)


def url_languages(facts: DataFrame) -> DataFrame:
    """CONTENT_URL_LANGUAGE: the address ends in a language (``-eng``, ``_f``, ...) that isn't the page's."""
    mark = F.lower(F.regexp_extract("url", r"(?i)[-_](eng?|fra?|e|f)\.[a-z]+([?#]|$)", 1))
    said = F.when(mark.isin("e", "en", "eng"), "eng").when(mark.isin("f", "fr", "fra"), "fra")
    bad = facts.withColumn("said", said).where(F.col("said").isNotNull() & (F.col("html_lang") != "") & (lang_f.iso_639_2(F.col("html_lang")) != F.col("said")))
    return results(bad, "CONTENT_URL_LANGUAGE", url=F.col("url"), message=F.concat("said", F.lit(" / "), "html_lang"))


def analytics(pages: DataFrame, content: str = "html") -> DataFrame:
    """WA_ID: the analytics ids of a page; WA_MULTIPLE: pages with more than one."""
    found = pages.select("url", F.array_distinct(F.regexp_extract_all(content, F.lit(ANALYTICS), F.lit(1))).alias("ids"))
    each = results(found.select("url", F.explode("ids").alias("id")), "WA_ID", status=0, url=F.col("url"), message=F.col("id"))
    return union(each, results(found.where(F.size("ids") > 1), "WA_MULTIPLE", url=F.col("url"), message=F.array_join("ids", ", ")))


def dispatched(documents: DataFrame) -> DataFrame:
    """Adds ``branch``, the family branch that looks at a document (mime_type, url, content): html, xml, or none without content."""
    mime, some = F.coalesce(F.col("mime_type"), F.lit("")), F.length(F.coalesce(F.col("content"), F.lit(""))) > 0
    xml = mime.rlike(r"application/(xhtml|atom|rss)\+xml|application/xml|text/xml") | F.col("url").rlike(r"(?i)\.xml$")
    return documents.withColumn("branch", F.when(some & mime.contains("text/html"), "html").when(some & xml, "xml").otherwise("none"))


#: Answers by their status, and what a page says whose address leads nowhere though its status is 200.
NO_ANSWER, DENIED, MOVED = (404, 410, 500, 502, 503, 504), (401, 403), (301, 302, 303, 307, 308)
SOFT = r"(?i)\b(404|page not found|not found|page introuvable)\b"


def link_answers(links: DataFrame, answers: DataFrame, inside: list[str] | None = None, blocked: str = r"(?i)blocked by (the )?(firewall|policy)") -> DataFrame:
    """Link checks that need the answer to a link's address. links: url, abs_url, link_type, lang, line_no, column_no; answers:
    address, status (null: none), mime_type, title, lang.

    BROKEN: no answer, or a status of NO_ANSWER; ACCESS_DENIED, REDIRECT: of DENIED, of MOVED; FIREWALL_BLOCKED: the title says so;
    SOFT_404: the title of a good answer is that of a missing page; BAD_IMAGE_MIME_TYPE: an image that isn't one;
    CROSS_LANGUAGE: English leads to French or the other way; BAD_NETWORKSCOPE: the host is one of ``inside``, which the
    public can't reach; IPV4_LINK as in ``ipv4_links``. Each link is met with its one answer; a link may have several results.
    """
    told = answers.select(F.col("address").alias("__a"), "status", "mime_type", F.coalesce("title", F.lit("")).alias("__t"), F.col("lang").alias("__l"))
    met = links.join(told, F.col("abs_url") == F.col("__a"), "left")
    good, status = F.coalesce(F.col("status") == 200, F.lit(False)), F.col("status")
    host = F.lower(F.regexp_extract("abs_url", r"^https?://([^/:?#]+)", 1))
    pair = F.array("lang", "__l")
    cross = good & (F.col("lang") != F.col("__l")) & F.array_contains(pair, "eng") & F.array_contains(pair, "fra")
    rules = {
        "BROKEN": status.isNull() | status.isin(*NO_ANSWER), "ACCESS_DENIED": status.isin(*DENIED), "REDIRECT": status.isin(*MOVED), "FIREWALL_BLOCKED": F.col("__t").rlike(blocked),
        "SOFT_404": good & F.col("__t").rlike(SOFT), "BAD_IMAGE_MIME_TYPE": good & (F.col("link_type") == "img") & ~F.coalesce(F.col("mime_type"), F.lit("")).startswith("image/"),
        "CROSS_LANGUAGE": cross, "BAD_NETWORKSCOPE": host.isin(*inside) if inside else F.lit(False), "IPV4_LINK": F.col("abs_url").rlike(r"^https?://\d{1,3}(\.\d{1,3}){3}([:/?#]|$)"),
    }
    hits = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]))
    return results(met.withColumn("testcase", F.explode(hits)), F.col("testcase"), url=F.col("url"), line_no=F.col("line_no"), column_no=F.col("column_no"), message=F.col("abs_url"))


def open_data_files(files: DataFrame) -> DataFrame:
    """Checks of data files as bytes (url, status, content, registered): TP_PW_OD_URL and OD_URL where the file can't be had,
    OD_REG where it isn't registered, OD_ENC where it isn't UTF-8, TP_PW_OD_BOM where it begins with a byte-order mark, TP_PW_OD_DATA
    where it is empty."""
    bad, raw = F.coalesce(F.col("status") != 200, F.lit(True)), F.coalesce("content", F.lit(b""))
    rules = {
        "TP_PW_OD_URL": bad, "OD_URL": bad, "OD_REG": ~F.coalesce("registered", F.lit(False)), "OD_ENC": ~bad & ~F.is_valid_utf8(raw.cast("string")),
        "TP_PW_OD_BOM": ~bad & (F.hex(F.substring(raw, 1, 3)) == "EFBBBF"), "TP_PW_OD_DATA": ~bad & (F.octet_length(raw) == 0),
    }
    hits = F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))
    return results(files.withColumn("testcase", F.explode(hits)), F.col("testcase"), url=F.col("url"), message=F.col("url"))


def open_data_records(parsed: DataFrame, url: str) -> DataFrame:
    """TP_PW_OD_VAL and OD_VAL: a record that the CSV parser refuses (columns of ``sources.csv.parse_lines``)."""
    each = parsed.where("error <> 0").withColumn("testcase", F.explode(F.array(F.lit("TP_PW_OD_VAL"), F.lit("OD_VAL"))))
    return results(each, F.col("testcase"), url=F.col(url).cast("string"), column_no=F.col("position"), message=F.concat(F.col("error").cast("string"), F.lit(" "), "error_text"))


def open_data_columns(table: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """TP_PW_OD_CONT_DUP: columns alike in all cells (of ``operators.profile.cells``); TP_PW_OD_CONT_COL_CONSISTENCY: pairs of cells
    that don't agree with their first (of ``operators.profile.pair_consistency``)."""
    alike = profile_o.duplicate_columns(table)
    parts = [results(alike, "TP_PW_OD_CONT_DUP", message=F.array_join("headings", ", "))]
    if pairs is not None:
        parts.append(results(pairs.where(~F.col("match")), "TP_PW_OD_CONT_COL_CONSISTENCY", line_no=F.col("line"), source_line=F.col("b"), message=F.concat(F.lit("first "), "other_data", F.lit(" on line "), F.col("first_line").cast("string"))))
    return union(*parts)


def pdf_properties(files: DataFrame, required: DataFrame, filled: DataFrame) -> DataFrame:
    """PDF_PROPERTY: one row for each property that a file (url, ``properties`` map) lacks, and for each that it has without content.
    required, filled: profiles (column property) of what must be there, and of what must have content where it is there."""
    need, full = ([r[0] for r in p.select("property").distinct().orderBy("property").collect()] for p in (required, filled))  # profiles are small
    value = lambda p: F.try_element_at("properties", p)
    listed = lambda names: F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    missing = F.transform(F.filter(listed(need), lambda p: value(p).isNull()), lambda p: F.concat(F.lit("missing "), p))
    empty = F.transform(F.filter(listed(full), lambda p: F.coalesce(F.trim(value(p)) == "", F.lit(False))), lambda p: F.concat(F.lit("empty "), p))
    return results(files.select("url", F.explode(F.concat(missing, empty)).alias("m")), "PDF_PROPERTY", url=F.col("url"), message=F.col("m"))


def validation(outputs: DataFrame) -> DataFrame:
    """<KIND>_VALIDATION from the output of validators (url, kind, output), run elsewhere: any output is one failing result. kind is
    css, epub, html, javascript, marc, robots or xml."""
    said = outputs.where(F.col("output").rlike(r"\S"))
    return results(said, F.concat(F.upper("kind"), F.lit("_VALIDATION")), url=F.col("url"), message=F.col("output"))


#: Fields of a robots file.
ROBOTS = r"(?i)^(user-agent|disallow|allow|sitemap|crawl-delay|host)\s*:"


def robots_faults(files: DataFrame) -> DataFrame:
    """Output for ``validation``: (url, kind, output) of robots files (url, content), the lines that are no fields."""
    lines = F.filter(F.split("content", r"\r?\n"), lambda x: F.regexp_replace(x, "#.*", "").rlike(r"\S") & ~F.regexp_replace(x, "#.*", "").rlike(ROBOTS))
    return files.select("url", F.lit("robots").alias("kind"), F.array_join(lines, "\n").alias("output"))


def accessibility(facts: DataFrame) -> DataFrame:
    """Techniques that the facts of a page (title, html_lang, links, elements) decide: H25 no title, H57 no language, H37 an image
    without alternative text, H64 a frame without a title, H30 a link without text, F77 an id that is used twice."""
    links, elements = F.col("links"), F.col("elements")
    attr = lambda e, n: F.coalesce(F.try_element_at(e["attr"], F.lit(n)), F.lit(""))
    place = lambda name, x, m: F.struct(F.lit(f"WCAG_2.0-{name}").alias("testcase"), x["line_no"].alias("line_no"), x["column_no"].alias("column_no"), m.alias("message"))
    none = F.struct(F.lit(-1).alias("line_no"), F.lit(-1).alias("column_no"))
    whole = lambda name, bad: F.when(bad, F.array(place(name, none, F.lit("")))).otherwise(F.array().cast("array<struct<testcase:string,line_no:int,column_no:int,message:string>>"))
    images = F.transform(F.filter(elements, lambda e: (e["tag"] == "img") & ~F.map_contains_key(e["attr"], "alt")), lambda e: place("H37", e, attr(e, "src")))
    frames = F.transform(F.filter(elements, lambda e: e["tag"].isin("frame", "iframe") & (F.trim(attr(e, "title")) == "")), lambda e: place("H64", e, attr(e, "src")))
    silent = F.transform(F.filter(links, lambda x: (x["link_type"] == "a") & (F.trim(x["anchor"]) == "") & (F.trim(x["title"]) == "")), lambda x: place("H30", x, x["href"]))
    named = F.filter(elements, lambda e: attr(e, "id") != "")
    ids = F.transform(named, lambda e: attr(e, "id"))
    again = F.transform(F.filter(named, lambda e, i: F.array_position(ids, attr(e, "id")) <= i), lambda e: place("F77", e, attr(e, "id")))
    every = F.concat(whole("H25", F.coalesce(F.col("title") == "", F.lit(True))), whole("H57", F.coalesce(F.col("html_lang") == "", F.lit(True))), images, frames, silent, again)
    found = facts.select("url", F.inline(every))
    return results(found, F.col("testcase"), url=F.col("url"), line_no=F.col("line_no"), column_no=F.col("column_no"), message=F.col("message"))


def act_rules(facts: DataFrame) -> DataFrame:
    """Rules of the public ACT catalogue that the facts of a page (url, title, links, elements, headings) decide: language, its validity
    and agreement with xml:lang, a title, names of headings, images, image buttons, objects, links and frames, ids that are
    unique, a refresh after a delay of up to 20 hours, and a viewport that keeps readers from zooming in."""
    elements, links, headings = F.col("elements"), F.col("links"), F.col("headings")
    attr = lambda e, n: F.coalesce(F.try_element_at(e["attr"], F.lit(n)), F.lit(""))
    empty = lambda *c: F.trim(F.concat(*c)) == ""
    bare = lambda c: F.lower(F.regexp_replace(c, "-.*", ""))
    place = lambda name, x, m: F.struct(F.lit(f"ACT-{name}").alias("testcase"), x["line_no"].alias("line_no"), m.alias("message"))
    of = lambda name, tag, test, say: F.transform(F.filter(elements, lambda e: (e["tag"] == tag) & test(e)), lambda e: place(name, e, say(e)))
    label = lambda e: attr(e, "aria-label")
    shown = lambda e: (attr(e, "aria-hidden") != "true") & ~attr(e, "role").isin("presentation", "none")
    content = lambda e: F.lower(attr(e, "content"))
    delay = lambda e: F.regexp_extract(content(e), r"^\s*(\d+)", 1).try_cast("int")
    scale = lambda e: F.regexp_extract(content(e), r"maximum-scale\s*=\s*([\d.]+)", 1).try_cast("double")
    named = F.filter(elements, lambda e: attr(e, "id") != "")
    ids = F.transform(named, lambda e: attr(e, "id"))
    none = F.array().cast("array<struct<testcase:string,line_no:int,message:string>>")
    title = F.when(F.coalesce(F.trim("title") == "", F.lit(True)), F.array(F.struct(F.lit("ACT-HTML_page_title_non_empty").alias("testcase"), F.lit(-1).alias("line_no"), F.lit("").alias("message")))).otherwise(none)
    every = F.concat(
        title,
        of("HTML_page_has_lang", "html", lambda e: empty(attr(e, "lang")), lambda e: F.lit("")),
        of("HTML_page_lang_valid", "html", lambda e: ~empty(attr(e, "lang")) & ~lang_f.language_valid(F.lower(attr(e, "lang"))), lambda e: attr(e, "lang")),
        of("HTML_page_lang_xml_lang_match", "html", lambda e: ~empty(attr(e, "lang")) & ~empty(attr(e, "xml:lang")) & (bare(attr(e, "lang")) != bare(attr(e, "xml:lang"))), lambda e: attr(e, "xml:lang")),
        F.transform(F.filter(elements, lambda e: (e["tag"] != "html") & ~empty(attr(e, "lang")) & ~lang_f.language_valid(F.lower(attr(e, "lang")))), lambda e: place("Lang_has_valid_language", e, attr(e, "lang"))),
        F.transform(F.filter(headings, lambda h: empty(h["text"])), lambda h: place("Heading_non_empty_accessible_name", h, F.lit(""))),
        of("Image_non_empty_accessible_name", "img", lambda e: ~F.map_contains_key(e["attr"], "alt") & empty(label(e), attr(e, "title")) & shown(e), lambda e: attr(e, "src")),
        of("Image_button_non_empty_accessible_name", "input", lambda e: (F.lower(attr(e, "type")) == "image") & empty(attr(e, "alt"), label(e), attr(e, "title")), lambda e: attr(e, "src")),
        F.transform(F.filter(links, lambda x: (x["link_type"] == "object") & empty(x["alt"], x["title"], attr(x, "aria-label"))), lambda x: place("Object_non_empty_accessible_name", x, x["href"])),
        F.transform(F.filter(links, lambda x: (x["link_type"] == "a") & empty(x["anchor"], x["title"], attr(x, "aria-label"))), lambda x: place("Link_non_empty_accessible_name", x, x["href"])),
        of("iframe_non_empty_accessible_name", "iframe", lambda e: empty(attr(e, "title"), label(e)) & shown(e), lambda e: attr(e, "src")),
        F.transform(F.filter(named, lambda e, i: F.array_position(ids, attr(e, "id")) <= i), lambda e: place("id_attribute_value_unique", e, attr(e, "id"))),
        of("Meta_no_refresh_delay", "meta", lambda e: (F.lower(attr(e, "http-equiv")) == "refresh") & F.coalesce(delay(e).between(1, 72_000), F.lit(False)), lambda e: attr(e, "content")),
        of("Meta_viewport_allows_zoom", "meta", lambda e: (F.lower(attr(e, "name")) == "viewport") & (content(e).rlike(r"user-scalable\s*=\s*(no|0)\b") | F.coalesce(scale(e) < 2, F.lit(False))), lambda e: attr(e, "content")),
    )
    found = facts.select("url", F.inline(every))
    return results(found, F.col("testcase"), url=F.col("url"), line_no=F.col("line_no"), message=F.col("message"))


#: Requests, hosts and cookie bytes that a page may have.
MOST_REQUESTS, MOST_HOSTS, MOST_COOKIES = 20, 4, 1000


def mobile(pages: DataFrame, facts: DataFrame) -> DataFrame:
    """Checks of a page's weight by the public rules of these names. pages: url, html, headers (map, names in lower case), redirects;
    facts: url, links, elements.

    GZIP, EXPIRES, ETAGS, COOKIE_SIZE by the headers; MINIFY: lines that begin with white space or comments in scripts and styles;
    EXTERNAL: such text in the page; CSS_TOP, JS_BOTTOM: a style sheet after the head, a script with an address in it; CSS_LINK:
    @import; JS_DUPES: a script twice; EMPTY_SRC: an empty address; IFRAMES; NO_SCALE: an image with a width or height;
    FAVICON: no icon; NUM_HTTP, DNS_LOOKUPS: more parts of the page or hosts than MOST_REQUESTS, MOST_HOSTS; REDIRECTS.
    """
    header = lambda n: F.coalesce(F.try_element_at("headers", F.lit(n)), F.lit(""))
    parts = F.filter("links", lambda x: x["link_type"].isin("img", "script", "link", "iframe", "frame", "embed", "object", "video", "audio", "source", "input"))
    uses = lambda tag, name: F.filter("elements", lambda e: (e["tag"] == tag) & (F.coalesce(F.try_element_at(e["attr"], F.lit(name)), F.lit("")) != ""))
    scripts = F.transform(uses("script", "src"), lambda e: e["attr"]["src"])
    sheet = lambda e: (e["tag"] == "link") & F.lower(F.coalesce(F.try_element_at(e["attr"], F.lit("rel")), F.lit(""))).contains("stylesheet")
    icon = lambda e: (e["tag"] == "link") & F.lower(F.coalesce(F.try_element_at(e["attr"], F.lit("rel")), F.lit(""))).contains("icon")
    inline = F.flatten(F.array(F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1)), F.regexp_extract_all("html", F.lit(r"(?is)<style[^>]*>(.*?)</style>"), F.lit(1))))
    hosts = F.array_distinct(F.filter(F.transform(parts, lambda x: F.lower(F.regexp_extract(x["abs_url"], r"^https?://([^/:?#]+)", 1))), lambda h: h != ""))
    rules = {
        "GZIP": ~header("content-encoding").rlike("(?i)gzip|br|deflate"), "EXPIRES": (header("expires") == "") & ~header("cache-control").contains("max-age"), "ETAGS": header("etag") != "",
        "COOKIE_SIZE": F.length(header("set-cookie")) > MOST_COOKIES, "REDIRECTS": F.coalesce(F.col("redirects"), F.lit(0)) > 0,
        "MINIFY": F.exists(inline, lambda x: x.rlike(r"(?m)^[ \t]+\S|/\*|^\s*//")), "EXTERNAL": F.exists(inline, lambda x: F.trim(x) != ""), "CSS_LINK": F.exists(inline, lambda x: x.contains("@import")),
        "CSS_TOP": F.exists("elements", lambda e: sheet(e) & (e["landmark"] != "head")), "JS_BOTTOM": F.exists("elements", lambda e: (e["tag"] == "script") & F.map_contains_key(e["attr"], "src") & (e["landmark"] == "head")),
        "JS_DUPES": F.size(F.array_distinct(scripts)) < F.size(scripts), "EMPTY_SRC": F.exists("elements", lambda e: F.coalesce(F.trim(F.try_element_at(e["attr"], F.lit("src"))) == "", F.lit(False))),
        "IFRAMES": F.exists("elements", lambda e: e["tag"] == "iframe"), "NO_SCALE": (F.size(uses("img", "width")) > 0) | (F.size(uses("img", "height")) > 0), "FAVICON": ~F.exists("elements", icon),
        "NUM_HTTP": F.size(parts) > MOST_REQUESTS, "DNS_LOOKUPS": F.size(hosts) > MOST_HOSTS,
    }
    hits = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]))
    met = pages.select(F.col("url").alias("__u"), "html", "headers", "redirects").join(facts.select("url", "links", "elements"), F.col("url") == F.col("__u"))
    return results(met.select("url", F.explode(hits).alias("testcase")), F.col("testcase"), url=F.col("url"), message=F.col("testcase"))


def mobile_parts(parts: DataFrame) -> DataFrame:
    """Checks of what a page is made of (url, part, status, headers, image_size, width, height): NO_404, a part that isn't there;
    COOKIE_FREE, one whose answer sets a cookie; OPT_IMAGES, an image of more bytes than it has pixels."""
    cookie = F.coalesce(F.try_element_at("headers", F.lit("set-cookie")), F.lit("")) != ""
    rules = {"NO_404": F.col("status") == 404, "COOKIE_FREE": cookie, "OPT_IMAGES": F.col("image_size") > F.col("width").cast("long") * F.col("height")}
    hits = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]))
    return results(parts.select("url", "part", F.explode(hits).alias("testcase")), F.col("testcase"), url=F.col("url"), message=F.col("part"))


def profile_rules(pages: DataFrame, facts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Test cases whose rule is data of a profile, such as those of a site's template: (testcase, kind, value). kind ``text`` or
    ``link``: a page's mark-up, or an address that it links to, must match the pattern; ``no text``, ``no link``: mustn't;
    ``metadata``: a page must have this metadata, not empty; ``section``, ``landmark``: it must have a link in this section or landmark.

    pages: url, html; facts: url, links, metadata. A profile is a configuration file; each page is read once for all its rules.
    """
    met = pages.select(F.col("url").alias("__u"), "html").join(facts.select("url", "links", "metadata"), F.col("url") == F.col("__u"))

    def holds(kind: str, value: str) -> Column:
        if kind.endswith("text"):
            found = F.coalesce(F.col("html").rlike(value), F.lit(False))
        elif kind.endswith("link"):
            found = F.exists("links", lambda x: x["abs_url"].rlike(value))
        elif kind == "metadata":
            found = F.exists("metadata", lambda m: (F.lower(m["name"]) == value.lower()) & (F.trim(m["content"]) != ""))
        else:
            found = F.exists("links", lambda x: x["content_section" if kind == "section" else "landmark"] == value)
        return ~found if kind.startswith("no ") else found

    failed = F.array_compact(F.array(*[F.when(~holds(k, v), F.struct(F.lit(t).alias("testcase"), F.lit(f"{k} {v}").alias("message"))) for t, k, v in rules]))
    found = met.select("url", F.inline(failed))
    return results(found, F.col("testcase"), url=F.col("url"), message=F.col("message"))


def interoperability(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """SWI_B: a feed that isn't well formed (documents: url, mime_type, content, error of ``sources.xml.validity``); SWI_C: a page that
    names no character set; SWI_D: one that offers no feed; SWI_E, SWI_E_RDFA: one without structured data, or without RDFa in it
    (facts: url, elements). Their names are public; the rules are those said here."""
    has = lambda test: F.exists("elements", test)
    attr = lambda e, n: F.coalesce(F.lower(F.try_element_at(e["attr"], F.lit(n))), F.lit(""))
    charset = has(lambda e: (e["tag"] == "meta") & ((attr(e, "charset") != "") | attr(e, "content").contains("charset=")))
    feed = has(lambda e: (e["tag"] == "link") & attr(e, "type").isin("application/atom+xml", "application/rss+xml"))
    rdfa = has(lambda e: (attr(e, "typeof") != "") | (attr(e, "vocab") != ""))
    data = rdfa | has(lambda e: attr(e, "itemtype") != "") | has(lambda e: attr(e, "type") == "application/ld+json")
    rules = {"SWI_C": ~charset, "SWI_D": ~feed, "SWI_E": ~data, "SWI_E_RDFA": data & ~rdfa}
    hits = F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))
    pages = results(facts.select("url", F.explode(hits).alias("testcase")), F.col("testcase"), url=F.col("url"), message=F.col("testcase"))
    return union(pages, results(dispatched(documents).where((F.col("branch") == "xml") & (F.col("error") != "")), "SWI_B", url=F.col("url"), message=F.col("error")))


def heading_counts(facts: DataFrame) -> DataFrame:
    """LANGUAGE_HEADINGS: pages of one address but for its language (``-eng``, ``_f``, ...) whose numbers of headings differ. facts: url, headings."""
    key = F.regexp_replace("url", r"(?i)[-_](eng?|fra?|e|f)(\.[a-z]+([?#]|$))", "$2")
    held = facts.select("url", key.alias("key"), F.size("headings").alias("n")).where(F.col("url") != F.col("key"))
    spread = held.groupBy("key").agg(F.min("n").alias("least"), F.max("n").alias("most")).where("least < most")
    return results(held.join(spread, "key"), "LANGUAGE_HEADINGS", url=F.col("url"), message=F.concat(F.col("n").cast("string"), F.lit(" of "), F.col("most").cast("string")))


def pdf_titles(facts: DataFrame, files: DataFrame) -> DataFrame:
    """HTML_PDF_TITLE: a page and a PDF file of the same address but for the suffix whose titles differ. facts: url, title; files: url, title."""
    bare = lambda c: F.regexp_replace(c, r"(?i)\.(html?|pdf)$", "")
    told = files.where(F.lower("url").endswith(".pdf")).select(bare(F.col("url")).alias("__k"), F.col("title").alias("__t"))
    met = facts.join(told, bare(F.col("url")) == F.col("__k")).where(F.trim(F.coalesce("title", F.lit(""))) != F.trim(F.coalesce("__t", F.lit(""))))
    return results(met, "HTML_PDF_TITLE", url=F.col("url"), message=F.concat("title", F.lit(" / "), "__t"))


def old_analytics(pages: DataFrame, content: str = "html") -> DataFrame:
    """WA_GA: a page that loads the analytics script by its address."""
    found = F.regexp_extract(content, r"(?i)((?:www|ssl)\.google-analytics\.com/[a-z_]+\.js|www\.googletagmanager\.com/gtag/js)", 1)
    return results(pages.select("url", found.alias("m")).where("m <> ''"), "WA_GA", url=F.col("url"), message=F.col("m"))
