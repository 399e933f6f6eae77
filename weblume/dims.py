"""Fixed values of the checks: small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: landmarks ---------------------------------------------------------------------------------------------
TAG_LANDMARK = {"aside": "complementary", "body": "body", "footer": "contentinfo", "head": "head", "header": "banner", "main": "main", "nav": "navigation", "section": "region"}
#: By landmark, the ancestors under which a tag doesn't take it.
LANDMARK_NOT_UNDER = {
    "banner": ("article", "aside", "main", "nav", "section"), "header": ("article", "aside", "main", "nav", "section"), "footer": ("article", "aside", "main", "nav", "section"),
    "navigation": ("footer", "header"), "region": ("footer", "header"),
}
LANDMARK_NEEDS = {"region": ("aria-labelledby", "aria-label")}
ROLE_LANDMARK = ("banner", "complementary", "contentinfo", "form", "main", "navigation", "region", "search")
ID_LANDMARK = {"header": "banner", "footer": "contentinfo", "main": "main", "main-content": "main", "nav": "navigation", "navigation": "navigation"}

# --- fixed values: content sections, (section, subsection, marker) in the order of registration ----------------------------
MARKERS = [
    ("NAVIGATION", "SKIP_LINKS", "wb-slc"), ("NAVIGATION", "SITE_NAV", "gcweb-menu"), ("NAVIGATION", "BREADCRUMB", "wb-bc"), ("NAVIGATION", "SITE_FOOTER", "wb-info"), ("NAVIGATION", "LEFT_NAV", "wb-sec"),
    ("CONTENT", "CONTENT", "mainContentOfPage"), ("CONTENT", "CONTENT", "main"), ("CONTENT", "CONTENT", "body"), ("CONTENT", "DATE_MODIFIED", "wb-dtmd"),
    ("NAVIGATION", "GC_NAV", "wb-bar"), ("NAVIGATION", "SITE_BANNER", "wb-sttl"), ("NAVIGATION", "SITE_NAV", "wb-sm"), ("NAVIGATION", "TERMS_CONDITIONS_FOOTER", "gc-tctr"), ("NAVIGATION", "GC_FOOTER", "gc-info"),
]

# --- fixed values: tags ----------------------------------------------------------------------------------------------------
VOID_TAGS = frozenset("area base br col command embed frame hr img input keygen link meta param source track wbr".split())
#: An open paragraph ends where one of these elements closes.
PARAGRAPH_ENDERS = frozenset("address article aside blockquote body button dd del details div dl fieldset figure form footer header ins li map menu nav ol pre section table td th ul".split())

# --- fixed values: media ---------------------------------------------------------------------------------------------------
MULTIMEDIA_MIME = ("audio/mid", "audio/mpeg", "audio/x-pn-realaudio", "audio/x-wav", "video/mpeg", "video/quicktime")
MULTIMEDIA_SUFFIX = ("avi", "flv", "mov", "swf", "wmv")

# --- fixed values: languages -----------------------------------------------------------------------------------------------
#: Two-letter codes and the three-letter codes that checks use for them.
ISO_639_1 = {
    "aa": "aar", "ab": "abk", "ae": "ave", "af": "afr", "ak": "aka", "am": "amh", "an": "arg", "ar": "ara", "as": "asm", "av": "ava",
    "ay": "aym", "az": "aze", "ba": "bak", "be": "bel", "bg": "bul", "bh": "bih", "bi": "bis", "bm": "bam", "bn": "ben", "bo": "tib",
    "br": "bre", "bs": "bos", "ca": "cat", "ce": "che", "ch": "cha", "co": "cos", "cr": "cre", "cs": "cze", "cu": "chu", "cv": "chv",
    "cy": "wel", "da": "dan", "de": "ger", "dv": "div", "dz": "dzo", "ee": "ewe", "el": "gre", "en": "eng", "eo": "epo", "es": "spa",
    "et": "est", "eu": "eus", "fa": "per", "ff": "ful", "fi": "fin", "fj": "fij", "fo": "fao", "fr": "fra", "fy": "fry", "ga": "gle",
    "gd": "gla", "gl": "glg", "gn": "grn", "gu": "guj", "gv": "glv", "ha": "hau", "he": "heb", "hi": "hin", "ho": "hmo", "hr": "hrv",
    "ht": "hat", "hu": "hun", "hy": "arm", "hz": "her", "ia": "ina", "id": "ind", "ie": "ile", "ig": "ibo", "ii": "iii", "ik": "ipk",
    "io": "ido", "is": "ice", "it": "ita", "iu": "iku", "ja": "jpn", "jv": "jav", "ka": "geo", "kg": "kon", "ki": "kik", "kj": "kua",
    "kk": "kaz", "kl": "kal", "km": "khm", "kn": "kan", "ko": "kor", "kr": "kau", "ks": "kas", "ku": "kur", "kv": "kom", "kw": "cor",
    "ky": "kir", "la": "lat", "lb": "ltz", "lg": "lug", "li": "lim", "ln": "lin", "lo": "lao", "lt": "lit", "lu": "lub", "lv": "lav",
    "mg": "mlg", "mh": "mah", "mi": "mao", "mk": "mac", "ml": "mal", "mn": "mon", "mr": "mar", "ms": "may", "mt": "mlt", "my": "bur",
    "na": "nau", "nb": "nob", "nd": "nde", "ne": "nep", "ng": "ndo", "nl": "dut", "nn": "nno", "no": "nor", "nr": "nbl", "nv": "nav",
    "ny": "nya", "oc": "oci", "oj": "oji", "om": "orm", "or": "ori", "os": "oss", "pa": "pan", "pi": "pli", "pl": "pol", "ps": "pus",
    "pt": "por", "qu": "que", "rm": "roh", "rn": "run", "ro": "rum", "ru": "rus", "rw": "kin", "sa": "san", "sc": "srd", "sd": "snd",
    "se": "sme", "sg": "sag", "si": "sin", "sk": "slo", "sl": "slv", "sm": "smo", "sn": "sna", "so": "som", "sq": "sqi", "sr": "srp",
    "ss": "ssw", "st": "sot", "su": "sun", "sv": "swe", "sw": "swa", "ta": "tam", "te": "tel", "tg": "tgk", "th": "tha", "ti": "tir",
    "tk": "tuk", "tl": "tgl", "tn": "tsn", "to": "ton", "tr": "tur", "ts": "tso", "tt": "tat", "tw": "twi", "ty": "tah", "ug": "uig",
    "uk": "ukr", "ur": "urd", "uz": "uzb", "ve": "ven", "vi": "vie", "vo": "vol", "wa": "wln", "wo": "wol", "xh": "xho", "yi": "yid",
    "yo": "yor", "za": "zha", "zh": "chi", "zu": "zul",
}
#: ISO 639-2/T to 639-2/B.
ISO_639_2B = {
    "bod": "tib", "ces": "cze", "cym": "wel", "deu": "ger", "eus": "baq", "ell": "gre", "fas": "per", "hye": "arm", "isl": "ice", "kat": "geo",
    "mkd": "mac", "mri": "mao", "msa": "may", "mya": "bur", "nld": "dut", "ron": "rum", "slk": "slo", "sqi": "alb", "zho": "chi",
}
ONE_LETTER = {"e": "eng", "f": "fra"}
LANGUAGE_NAMES = {"english": "eng", "francais": "fra"}

# --- fixed values: accepted forms of a language attribute -------------------------------------------------------------------
LANGUAGE_FORMS = (
    r"^(en-GB-oed)|(i-[a-z]{3,8})|(sgn-[A-Z]{2}-[A-Z]{2})$", r"^([a-z]{2,3}-[a-z]{3,})|([a-z]{2}-[a-z]{3}-[a-z]{3})$", r"(?i)^x-[a-z0-9]+$", r"^([a-z]{2,3})$",
    r"^([a-z]{2,3}-[a-z]{2,3})$", r"^([a-z]{2,3}-[a-z]{3,}(-[a-z]+)*)$",
)

# --- fixed values: errors of the CSV parser --------------------------------------------------------------------------------
CSV_ERRORS = {
    1000: "INI - constructor failed", 1001: "sep_char is equal to quote_char or escape_char", 1002: "INI - allow_whitespace with escape_char or quote_char SP or TAB", 1003: "INI - \r or \n in main attr not allowed",
    2010: "ECR - QUO char inside quotes followed by CR not part of EOL", 2011: "ECR - Characters after end of quoted field",
    2021: "EIQ - NL char inside quotes, binary off", 2022: "EIQ - CR char inside quotes, binary off", 2025: "EIQ - Loose unescaped escape", 2026: "EIQ - Binary character inside quoted field, binary off", 2027: "EIQ - Quoted field not terminated",
    2030: "EIF - NL char inside unquoted verbatim, binary off", 2031: "EIF - CR char is first char of field, not part of EOL", 2032: "EIF - CR char inside unquoted, not part of EOL", 2034: "EIF - Loose unescaped quote", 2037: "EIF - Binary character in unquoted field, binary off",
    2110: "ECB - Binary character in Combine, binary off", 2200: "EIO - print to IO failed. See errno",
    4002: "EIQ - Unescaped ESC in quoted field", 4003: "EIF - ESC CR", 4004: "EUF - ",
    3001: "EHR - Unsupported syntax for column_names ()", 3002: "EHR - getline_hr () called before column_names ()", 3003: "EHR - bind_columns () and column_names () fields count mismatch", 3004: "EHR - bind_columns () only accepts refs to scalars",
    3006: "EHR - bind_columns () did not pass enough refs for parsed fields", 3007: "EHR - bind_columns needs refs to writable scalars", 3008: "EHR - unexpected error in bound fields", 3009: "EHR - print_hr () called before column_names ()", 3010: "EHR - print_hr () called with invalid arguments",
    0: "",
}

# --- fixed values: ARIA roles by class; a role in two lists has the later class -----------------------------------------------
ROLE_CLASSES = {
    "abstract": (
        "command", "composite", "input", "landmark", "range", "roletype", "section", "sectionhead", "select", "structure", "widget",
        "window",
    ),
    "widget": (
        "alert", "alertdialog", "button", "checkbox", "dialog", "gridcell", "link", "log", "marquee", "menuitem", "menuitemcheckbox",
        "menuitemradio", "option", "progressbar", "radio", "scrollbar", "slider", "spinbutton", "status", "tab", "tabpanel", "textbox",
        "timer", "tooltip", "treeitem",
    ),
    "composite": (
        "combobox", "grid", "listbox", "menu", "menubar", "radiogroup", "tablist", "tree", "treegrid",
    ),
    "document": (
        "article", "columnheader", "definition", "directory", "document", "group", "heading", "img", "list", "listitem", "math", "none",
        "note", "presentation", "region", "row", "rowgroup", "rowheader", "separator", "toolbar",
    ),
    "landmark": (
        "application", "banner", "complementary", "contentinfo", "form", "main", "navigation", "search",
    ),
    "epub": (
        "cell", "definition", "directory", "doc-abstract", "doc-acknowledgments", "doc-appendix", "doc-backlink", "doc-biblioentry",
        "doc-bibliography", "doc-biblioref", "doc-chapter", "doc-colophon", "doc-conclusion", "doc-cover", "doc-credit", "doc-credits",
        "doc-dedication", "doc-endnote", "doc-endnotes", "doc-epigraph", "doc-epilogue", "doc-errata", "doc-footnote", "doc-foreword",
        "doc-glossary", "doc-glossref", "doc-index", "doc-introduction", "doc-noteref", "doc-notice", "doc-pagebreak", "doc-pagelist",
        "doc-part", "doc-preface", "doc-prologue", "doc-pullquote", "doc-qna", "doc-subtitle", "doc-tip", "doc-toc", "figure", "table",
        "term",
    ),
}
ROLE_CLASS = {role: kind for kind, names in ROLE_CLASSES.items() for role in names}

# --- fixed values: ARIA roles that the children of a role may have -------------------------------------------------------------
ALLOWED_CHILDREN = {
    "combobox": ("dialog", "grid", "listbox", "textbox", "tree"), "feed": ("article",), "grid": ("row", "rowgroup"), "list": ("group", "listitem"), "listbox": ("option",),
    "menu": ("group", "menuitem", "menuitemcheckbox", "menuitemradio"), "menubar": ("group", "menuitem", "menuitemcheckbox", "menuitemradio"), "radiogroup": ("radio",),
    "row": ("cell", "columnheader", "gridcell", "rowheader"), "rowgroup": ("row",), "table": ("row", "rowgroup"), "tablist": ("tab",), "tree": ("group", "treeitem"), "treegrid": ("row", "rowgroup"),
}

# --- fixed values: roles that HTML elements have by themselves ------------------------------------------------------------------
IMPLICIT_ROLES = {
    "a": ("link",), "area": ("link",), "article": ("article",), "aside": ("complementary",), "body": ("document",), "button": ("button",), "datalist": ("listbox",), "dd": ("definition",), "details": ("group",), "dl": ("list",),
    "dialog": ("dialog",), "dt": ("listitem",), "fieldset": ("group",), "figure": ("figure",), "footer": ("contentinfo",), "form": ("form",), "h1": ("heading",), "h2": ("heading",), "h3": ("heading",), "h4": ("heading",),
    "h5": ("heading",), "h6": ("heading",), "header": ("banner",), "img": ("img",), "input": ("button", "checkbox", "radio", "searchbox", "slider", "spinbutton", "textbox"), "li": ("listitem",), "link": ("link",), "main": ("main",),
    "math": ("math",), "menu": ("menu",), "menuitem": ("menuitem", "menuitemcheckbox", "menuitemradio"), "nav": ("navigation",), "ol": ("list",), "optgroup": ("group",), "option": ("option",), "output": ("status",),
    "progress": ("progressbar",), "section": ("region",), "select": ("combobox", "listbox"), "summary": ("button",), "table": ("table",), "textarea": ("textbox",), "tbody": ("rowgroup",), "thead": ("rowgroup",),
    "tfoot": ("rowgroup",), "td": ("cell",), "th": ("columnheader", "rowheader"), "tr": ("row",), "ul": ("list",),
}
#: The role that a type attribute chooses, by element.
TYPED_ROLES = {
    "input": {
        "button": "button", "checkbox": "checkbox", "email": "textbox", "image": "button", "number": "spinbutton", "radio": "radio", "range": "slider", "reset": "button", "search": "searchbox", "submit": "button", "tel": "textbox",
        "text": "textbox", "url": "textbox",
    },
    "menuitem": {"command": "menuitem", "checkbox": "menuitemcheckbox", "radio": "menuitemradio"},
}

# --- fixed values: ARIA attributes: their values, or the kind of these ----------------------------------------------------------
ARIA_VALUES = {
    "aria-activedescendant": "ID", "aria-atomic": "false true", "aria-autocomplete": "both inline list none", "aria-busy": "false true", "aria-checked": "false mixed true undefined", "aria-colcount": "INTEGER",
    "aria-colindex": "INTEGER", "aria-colspan": "INTEGER", "aria-controls": "ID LIST", "aria-current": "date false location page step time true", "aria-describedby": "ID LIST", "aria-details": "ID", "aria-disabled": "false true",
    "aria-dropeffect": "copy execute link move none popup", "aria-errormessage": "ID", "aria-expanded": "false true undefined", "aria-flowto": "ID LIST", "aria-grabbed": "false true undefined",
    "aria-haspopup": "dialog false grid listbox menu tree true", "aria-hidden": "false true undefined", "aria-invalid": "false grammar spelling true", "aria-keyshortcuts": "STRING", "aria-label": "STRING", "aria-labelledby": "ID LIST",
    "aria-level": "INTEGER", "aria-live": "assertive off polite", "aria-modal": "false true", "aria-multiline": "false true", "aria-multiselectable": "false true", "aria-orientation": "horizontal undefined vertical", "aria-owns": "ID LIST",
    "aria-placeholder": "STRING", "aria-posinset": "INTEGER", "aria-pressed": "false mixed true", "aria-readonly": "false true", "aria-relevant": "additions additions_text all removals text", "aria-required": "false true",
    "aria-roledescription": "STRING", "aria-rowcount": "INTEGER", "aria-rowindex": "INTEGER", "aria-rowspan": "INTEGER", "aria-selected": "false true undefined", "aria-setsize": "INTEGER", "aria-sort": "ascending descending none other",
    "aria-valuemax": "NUMBER", "aria-valuemin": "NUMBER", "aria-valuenow": "NUMBER", "aria-valuetext": "STRING",
}
#: Attributes that any role may have.
ARIA_GLOBAL = (
    "aria-atomic", "aria-busy", "aria-controls", "aria-current", "aria-describedby", "aria-details", "aria-disabled", "aria-dropeffect", "aria-errormessage", "aria-flowto", "aria-grabbed", "aria-haspopup", "aria-hidden", "aria-invalid",
    "aria-keyshortcuts", "aria-label", "aria-labelledby", "aria-live", "aria-owns", "aria-relevant", "aria-roledescription",
)
#: Roles whose content is their accessible name.
NAMED_BY_CONTENT = ("button", "checkbox", "gridcell", "link", "menuitem", "menuitemcheckbox", "menuitemradio", "option", "radio", "searchbox", "switch", "tab", "treeitem")

# --- fixed values: document types ------------------------------------------------------------------------------------------
DOCTYPES = {
    "-//W3C//DTD XHTML 1.1 plus MathML 2.0//EN": "XHTML 1.1 plus MathML 2.0", "-//W3C//DTD MathML 2.0//EN": "MathML 2.0", "-//W3C//DTD XHTML 1.1//EN": "XHTML 1.1", "-//W3C//DTD XHTML Basic 1.0//EN": "XHTML Basic",
    "-//W3C//DTD XHTML 1.0 Strict//EN": "XHTML 1.0 Strict", "-//W3C//DTD XHTML 1.0 Transitional//EN": "XHTML 1.0 Transitional", "-//W3C//DTD XHTML 1.0 Frameset//EN": "XHTML 1.0 Frameset",
    "-//W3C//DTD HTML 4.01//EN": "HTML 4.01 Strict", "-//W3C//DTD HTML 4.01 Transitional//EN": "HTML 4.01 Transitional", "-//W3C//DTD HTML 4.01 Frameset//EN": "HTML 4.01 Frameset",
    "-//W3C//DTD HTML 4.0//EN": "HTML 4.0 Strict", "-//W3C//DTD HTML 4.0 Transitional//EN": "HTML 4.0 Transitional", "-//W3C//DTD HTML 4.0 Frameset//EN": "HTML 4.0 Frameset",
    "-//W3C//DTD HTML 3.2 Final//EN": "HTML 3.2", "-//W3C//DTD HTML 3.2 Draft//EN": "HTML 3.2", "-//W3C//DTD HTML 3.2//EN": "HTML 3.2", "-//W3O//DTD W3 HTML 3.0//EN": "HTML 3.0 Draft", "-//IETF//DTD HTML//EN": "HTML 2.0", "-//IETF//DTD HTML 2.0//EN": "HTML 2.0",
}


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A dimension table; its rows are written in this module or read from a configuration file."""
    return spark.createDataFrame(rows, schema)
