"""Predicates and rewrites of text, as Column -> Column functions.

White space in these rules is ASCII white space; `\\p{Z}` is named where Unicode spaces count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that begin a bulleted paragraph.
BULLETS = "■•⚫⬤◆◇○●◦‣⁃▪▫∗†‡¹²³⁴⁵⁶⁷⁸⁹⁰₁₂₃₄₅₆₇₈₉₀ᵃᵇᶜᵈᵉᶠᵍʰⁱʲᵏˡᵐⁿᵒᵖʳˢᵗᵘᵛʷˣʸᶻ¶※⁑⁂⁕⁎⁜❧☙⁋‖‽·"
#: Patterns of whole rows.
NUMERIC = r"^-?[0-9]+(\.[0-9]+)?$"
FOLIO = r"(?i)^([0-9]{1,4}|[ivxlcdm]{1,7})$"
PAGE_LIST = r"(?i)^([0-9]{1,4}|[ivxlcdm]{1,7})([ \t\n,;]+([0-9]{1,4}|[ivxlcdm]{1,7}))+$"
NUMBERED_START, PAGE_END = r"^[ \t]*[0-9]+(\.[0-9]+)*\.?[ \t]+[^ \t]", r"[ \t][0-9]{1,4}[ \t]*$"
TERMINAL_LABEL = r"(?i)[ \t]([0-9]{1,4}|[ivxlcdm]{1,8})[ \t]*$"
MARKED = r"^[ \t]*[■▪•◦¡]"
APPENDIX = r"(?i)^[ \t]*appendix[ \t]+[A-Z][ \t]*$"
TRACTION = r"(?i)^[ \t]*(prologue[ \t]+[ivxlcdm]+|.+[ \t]+[0-9]{1,3}[ \t]+[0-9]{1,2}[ \t]*[•·])[ \t]*$"
LIST_ITEM = r"^[ \t]*([■▪•◦\-–*]|[0-9]+[.)])[ \t]+[^ \t]"
DOT_LEADER = r"\.{20,}"
CODE_SIGNS = "{}[]()<>=;|&#$@\\/*+_"
CODE_START = r"^(#|//|/\*|\*|>>>|\.\.\.|\$|def |class )"
QUOTED = r"""["'][^"']{2,}["']"""
SNAKE = r"\b[a-z][a-z0-9]*_[a-z0-9_]+\b"
DOTTED = r"\b[A-Za-z_][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_]*(\.|\()"
ASSIGNED = r"""(^|[ \t,(])[ \t]*[A-Za-z_][A-Za-z0-9_]*[ \t]*=[ \t]*[\[{"'0-9]"""
CID = r"^\(cid:[0-9]+\)$"
SENTENCE_END = r"""[.!?:;"'”’)\]}][ \t]*$"""
CONTINUES = r"^[ \t]*([a-z]|[,;:)\]}]|and\b|or\b|but\b|the\b|of\b|to\b|in\b|a\b)"
MARKER_PREFIX = r"^[ \t]*([•◦▪▫‣※]|\(?[0-9ivxlcIVXLC]{1,4}[.)]|[a-zA-Z][.)])[ \t]+"


def has(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def numeric(text: Column) -> Column:
    """F-NUMERIC: a signed decimal number once trimmed."""
    return F.trim(text).rlike(NUMERIC)


def folio(text: Column) -> Column:
    """F-PAGENUM: at most 8 characters, a number of 1-4 digits or a Roman numeral."""
    t = F.trim(text)
    return (F.length(t) <= 8) & t.rlike(FOLIO)


def page_list(text: Column) -> Column:
    """F-PAGELIST: at most 400 characters and nothing but two folios or more."""
    t = F.trim(text)
    return (F.length(t) <= 400) & t.rlike(PAGE_LIST)


def bullet(text: Column) -> Column:
    """F-BULLET: the first character is a bullet."""
    return text.rlike(f"^[{BULLETS}]")


def digits_and_space(text: Column) -> Column:
    """F-DIGIT-SPACE: ASCII digits and white space alone; true for the empty text."""
    return text.rlike(r"^[0-9 \t\n\r\f]*$")


def dot_leader(text: Column) -> Column:
    """F-DOTLEADER: twenty dots in a row."""
    return text.rlike(DOT_LEADER)


def numbered_row(text: Column) -> Column:
    """F-TOC-NUMBERED: a section number first and a page number last."""
    return text.rlike(NUMBERED_START) & text.rlike(PAGE_END)


def code_signs(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, CODE_SIGNS, ""))


def code_like(text: Column) -> Column:
    """F-CODE: dense in signs, or shaped like code; null and empty texts are not."""
    dense = F.try_divide(code_signs(text), F.length(text)) >= 0.12
    numbered = text.rlike(r"^[ \t]*[0-9]+[ \t]") & (code_signs(text) >= 2)
    shape = F.ltrim(text).rlike(CODE_START) | text.rlike(QUOTED) | text.rlike(SNAKE) | text.rlike(DOTTED) | text.rlike(ASSIGNED)
    return F.coalesce(dense, F.lit(False)) | numbered | shape


def formula_start(char: Column) -> Column:
    """F-FORMULA-START: unmapped glyph, mathematical category, Greek block, digit, bracket or bullet."""
    return char.contains("(cid:") | (char != " ") & (char.rlike(r"^[\p{Mn}\p{Sk}\p{Sm}\p{Zl}\p{Zp}\p{Zs}\p{Co}]") | char.rlike("^[Ͱ-Ͽ]")) | char.rlike(r"^[0-9\[\]•]")


def formula_middle(char: Column) -> Column:
    """F-FORMULA-MID: formula_start or a comma."""
    return formula_start(char) | char.startswith(",")


def valid_char(char: Column) -> Column:
    """F-VALID-CHAR: white space, or neither control, surrogate, private, unassigned nor unmapped."""
    return char.rlike(r"^[ \t\n\r\f]") | ~(char.rlike(r"^[\p{Cc}\p{Cs}\p{Co}\p{Cn}]") | char.contains("(cid:"))


def strip_control(text: Column) -> Column:
    """F-CONTROL: without characters of Unicode category C."""
    return F.regexp_replace(text, r"\p{C}", "")


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normal_key(text: Column) -> Column:
    """Lower case, runs of white space (no-break space too) as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r\f ]+", " "))


def collapse_dots(text: Column) -> Column:
    """Twenty or more dots, commas or spaces in a row as one dot."""
    return F.regexp_replace(text, r"[. 。…，]{20,}", ".")


def strip_placeholders(text: Column) -> Column:
    """Without <bN> and </bN>."""
    return F.regexp_replace(text, r"</?b[0-9]+>", "")


def marker_prefix(text: Column) -> Column:
    """The list marker that a text begins with, trimmed; empty if none."""
    return F.trim(F.regexp_extract(text, MARKER_PREFIX, 0))


def strip_fence(reply: Column) -> Column:
    """A reply without code fences or <json> tags around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(reply, r"^[ \n]*(```(json)?|<json>)", ""), r"(```|</json>)[ \n]*$", ""))


def json_start(reply: Column) -> Column:
    """From the first brace or bracket on."""
    return F.regexp_extract(reply, r"(?s)[\[{].*", 0)


def words_and_marks(text: Column) -> Column:
    """Token-count proxy: runs of letters, digits and underscores, and single other signs."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r\f]"))


def audit_labels(text: Column) -> Column:
    """A-AUDIT: labels of a text's structure, in a fixed order."""
    rules = {
        "toc-heading": text.rlike(r"(?i)\b(table of contents|contents)\b"),
        "chapter-cover-list": text.rlike(r"(?i)this chapter (covers|cover)"),
        "bullet-list": text.rlike(r"[■▪•◦]"),
        "numbered-run": F.regexp_count(text, F.lit(r"[0-9]+\.[0-9]+ ")) >= 3,
        "possible-collapsed-rows": (F.length(text) >= 180) & (F.regexp_count(text, F.lit(r"(?i)[ \t]([0-9]{1,4}|[ivxlcdm]{1,8})[ \t]")) >= 3),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
