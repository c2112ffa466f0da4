"""Text functions: Column in, Column out, all inside the JVM.

Lengths are code points. White space is the Unicode set below, as a class that Java and RE2 read
alike; Spark's own trim and ``\\s`` know ASCII only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = "\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

#: The same characters one by one, for trimming: that looks at the ends only, a regex at every character.
WS_CHARS = WS.replace("\u2000-\u200a", "".join(map(chr, range(0x2000, 0x200B))))

# Words that end in a period as a matter of spelling.
ABBREVIATIONS = (
    "mr mrs ms dr prof sr jr st mt rev hon pres gov sen rep capt lt col gen sgt "
    "vs etc al fig figs eq eqs no nos vol vols ch chap sec pp p ed eds trans ref refs cf viz approx est resp incl cont "
    "inc ltd co corp dept univ assn bros mfg "
    "jan feb mar apr jun jul aug sep sept oct nov dec mon tue tues wed thu thur thurs fri sat sun "
    "min max avg hr hrs sec secs ft in cm mm kg lb lbs oz"
).split()
CLOSERS = "[\"'”’)\\]]"
OPENERS = "\"'“‘(\\["

# Named character references that are decoded.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "—", "ndash": "–",
    "hellip": "…", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "copy": "©", "shy": "",
}
# Elements that end a paragraph, and elements whose content is never read.
BLOCK_TAGS = "p|h[1-6]|li|blockquote|figcaption|dt|dd|tr|div|section|article"
UNREAD_TAGS = ("script", "style", "head", "svg", "math")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def split_at(c: Column, sign: str, pattern: str) -> Column:
    """``F.split`` by a pattern whose matches hold ``sign``; Spark compiles it anew for each text, so only for those that need it."""
    return let(c, lambda t: F.when(~F.contains(t, F.lit(sign)), F.array(t)).otherwise(F.split(t, pattern)))


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def rtrim(c: Column) -> Column:
    return F.rtrim(c, F.lit(WS_CHARS))


def collapse(c: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return trim(F.regexp_replace(c, f"[{WS}]+", " "))


def line_key(c: Column) -> Column:
    """What stays the same when only numbers in a repeated line change."""
    return collapse(F.regexp_replace(F.lower(c), "[0-9]+", "#"))


# Lines that are a page number.
PAGE_NUMBER = (
    "^[0-9]{1,4}$",
    f"^[-–—][{WS}]*[0-9]{{1,4}}[{WS}]*[-–—]$",
    f"^[Pp][Aa][Gg][Ee][{WS}]+[0-9]{{1,4}}([{WS}]+[Oo][Ff][{WS}]+[0-9]{{1,4}})?$",
    "^[ivxlcdmIVXLCDM]{1,7}$",
)


def is_page_number(c: Column) -> Column:
    t = trim(c)
    out = F.lit(False)
    for p in PAGE_NUMBER:
        out = out | t.rlike(p)
    return out


# What markdown is taken off and what stays of it, in order.
MARKDOWN = (
    ("(?md)^```[\\s\\S]*?```", ""),
    (f"(?md)^#{{1,6}}[{WS}]+", ""),
    ("!?\\[([^\\]]*)\\]\\([^)]*\\)", "$1"),
    ("(\\*\\*|__|\\*|_|`)(.+?)\\1", "$2"),
    (f"(?md)^[{WS}]*[-*+][{WS}]+", ""),
    (f"(?md)^[{WS}]*>[{WS}]?", ""),
)


def markdown_to_text(c: Column) -> Column:
    """The words of light markdown: no fences, marks of headings, links, emphasis, lists, quotes."""
    for pattern, by in MARKDOWN:
        c = F.regexp_replace(c, pattern, by)
    return c


def replaced(c: Column, pattern: str, use: Callable[[Column], Column]) -> Column:
    """``c`` in one pass with each match of ``pattern`` as ``use`` makes it of its first group."""
    made = F.concat(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), use), F.array(F.lit("")))
    return F.array_join(F.zip_with(F.split(c, pattern, -1), made, lambda between, new: F.concat(between, new)), "")


ENTITY = "&(#[xX]?[0-9a-fA-F]+|[a-zA-Z]+);"


def decode_entities(c: Column) -> Column:
    """One pass over named, decimal and hexadecimal references; unknown ones stay."""
    names = F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv])

    def one(body: Column) -> Column:
        whole = F.concat(F.lit("&"), body, F.lit(";"))
        digits = F.regexp_extract(body, "^#([0-9]+)", 1)
        hexed = F.regexp_extract(body, "^#[xX]([0-9a-fA-F]+)$", 1)
        code = F.when(hexed != "", F.conv(F.substring(hexed, -8, 8), 16, 10)).when(digits != "", F.substring(digits, 1, 9)).cast("long")
        valid = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF) & (F.length(hexed) <= 8) & (F.length(digits) <= 9)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        named = F.try_element_at(names, F.lower(body))
        return F.when(body.startswith("#"), F.when(valid, char).otherwise(whole)).otherwise(F.coalesce(named, whole))

    return F.when(F.contains(c, F.lit("&")), replaced(c, ENTITY, one)).otherwise(c)


def normalise_paragraphs(c: Column) -> Column:
    """Blank lines separate paragraphs; white space inside them collapses, empty ones go."""
    return F.array_join(paragraphs(c, collapse), "\n\n")


def paragraphs(c: Column, clean: Callable[[Column], Column] = trim) -> Column:
    return F.filter(F.transform(split_at(c, "\n", f"\\n[{WS}]*\\n"), clean), lambda p: p != "")


UNREAD = f"(?i)<({'|'.join(UNREAD_TAGS)})[\\s\\S]*?</\\1\\s*>"
COMMENT = "<!--[\\s\\S]*?-->"
TAG = "<(/?[a-zA-Z][^>]*)>"


def _break_of(tag: Column) -> Column:
    """What a tag leaves of itself: a block's an empty line, a bare ``br`` a new line, others nothing."""
    block = tag.rlike(f"(?i)^/?({BLOCK_TAGS})(?![a-zA-Z0-9])")
    return F.when(block, "\n\n").when(tag.rlike("(?i)^br\\s*/?$"), "\n").otherwise("")


def html_to_text(c: Column) -> Column:
    """Prose of a well-formed chapter: unread bodies and comments go, then each tag is told by its class."""
    seen = F.regexp_replace(F.regexp_replace(c, UNREAD, ""), COMMENT, "")
    return normalise_paragraphs(decode_entities(replaced(seen, TAG, _break_of)))


def ends_with_abbreviation(before: Column) -> Column:
    """Whether a period after this text belongs to the spelling of its last word."""
    word = F.regexp_extract(before, "([A-Za-z][A-Za-z.]*)\\z", 1)
    return F.contains(word, F.lit(".")) | word.rlike("^[A-Z]$") | F.lower(word).isin(*ABBREVIATIONS)


def _any_of(words: list[str]) -> str:
    """A pattern of these words by their first letter, so that most are never tried."""
    by_first: dict[str, list[str]] = {}
    for w in dict.fromkeys(words):
        by_first.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by_first.items())


# only a letter before the period can make it a spelling; other periods skip the look-behinds, which cost most of the time
_VETO = (
    "(?:(?<![A-Za-z])|"
    f"(?<!(?<![A-Za-z])(?:[A-Z]|(?i:{_any_of(ABBREVIATIONS)})))"
    "(?<![A-Za-z]\\.[A-Za-z.]{0,40}))"
)
# the look-aheads for the terminator come first: look-behinds at every character would cost most of the time
SENTENCE_END = f"((?=[.!?])(?<![.!?])(?:[.!?]{{2,}}+|[!?]|(?=\\.){_VETO}\\.(?![.!?])){CLOSERS}*+)[{WS}]+(?=[{OPENERS}A-Z0-9])"


def split_sentences(c: Column, trimmed: bool = False) -> Column:
    """Sentences of one paragraph, trimmed; with ``trimmed`` the paragraph is.

    A run of terminators ends once; closing quotes stay with their sentence; what follows must look
    like a start; a lone period after an abbreviation, an initial or a dotted form ends nothing.
    The look-behind for dotted forms reaches 40 characters back.
    """

    def of_trimmed(t: Column) -> Column:
        # ends take the white space behind them along, so only at a text's own marks some is left
        marked = F.split(F.regexp_replace(t, SENTENCE_END, "$1\x01"), "\x01")
        return F.filter(F.when(F.contains(t, F.lit("\x01")), F.transform(marked, trim)).otherwise(marked), lambda s: s != "")

    return of_trimmed(c) if trimmed else let(trim(c), of_trimmed)


def chapter_title(c: Column, most: int = 60) -> Column:
    """The start of a text for a list of chapters: cut at a space past 20 characters, else hard."""

    def cut(flat: Column) -> Column:
        head = F.substring(flat, 1, most)
        prefix = F.regexp_extract(head, "(?s)^(.*) [^ ]*\\z", 1)
        short = trim(F.when(F.length(prefix) > 20, prefix).otherwise(head))
        return F.when(F.length(flat) <= most, flat).otherwise(F.concat(short, F.lit("…")))

    return let(collapse(c), cut)


def escape_xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def http_date(c: Column) -> Column:
    return F.date_format(c, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def rule_regex(pattern: Column) -> Column:
    """A literal as a regex; one of word characters (dots inside allowed) matches whole words only."""
    escaped = F.regexp_replace(pattern, "([.*+?^${}()|\\[\\]\\\\])", "\\\\$1")
    wordy = pattern.rlike("^[A-Za-z0-9_][A-Za-z0-9_.]*[A-Za-z0-9_]$|^[A-Za-z0-9_]$")
    return F.when(wordy, F.concat(F.lit("(?<![A-Za-z0-9_])"), escaped, F.lit("(?![A-Za-z0-9_])"))).otherwise(escaped)


def literal_replacement(c: Column) -> Column:
    return F.regexp_replace(c, "([\\\\$])", "\\\\$1")


def content_hash(text: Column, voice: Column, model: Column, provider: Column | None = None, plain: str = "alpha") -> Column:
    """sha256 of voice:model:text; providers other than ``plain`` stand in front."""
    key = F.concat_ws(":", voice, model, text)
    if provider is None:
        return F.sha2(key, 256)
    return F.sha2(F.when(provider == plain, key).otherwise(F.concat_ws(":", provider, key)), 256)


def derive_title(name: Column, most: int = 200) -> Column:
    """A file name without its last extension; a typed title loses what follows its last dot too."""
    return F.substring(F.regexp_replace(name, "\\.[^.]+\\z", ""), 1, most)


def format_time(seconds: Column) -> Column:
    whole = F.concat((F.floor(seconds / 60)).cast("string"), F.lit(":"), F.lpad(F.floor(seconds % 60).cast("string"), 2, "0"))
    return F.coalesce(whole, F.lit("0:00"))


def format_chars(n: Column) -> Column:
    """12345 as "12.3k chars"; halves round up."""
    tenths = F.floor((n + 50) / 100).cast("long")
    thousands = F.concat((F.floor(tenths / 10)).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("k chars"))
    return F.when(n >= 1000, thousands).otherwise(F.concat(n.cast("string"), F.lit(" chars")))


def half_up(c: Column) -> Column:
    """Nearest whole number, halves up."""
    return F.floor(c + 0.5).cast("long")
