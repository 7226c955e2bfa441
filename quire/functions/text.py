"""Scalar column functions of the document engine, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that run within a line of text.
INLINE_TAGS = (
    "a", "abbr", "b", "bdi", "bdo", "br", "cite", "code", "data", "dfn", "em", "i", "kbd", "mark", "q", "rp", "rt", "ruby", "s",
    "samp", "small", "span", "strong", "sub", "sup", "time", "u", "var", "wbr", "img", "svg", "canvas", "audio", "video", "map",
    "area", "input", "button", "select", "textarea", "label", "output", "progress", "meter", "iframe", "embed", "object", "script",
    "del", "ins", "slot", "mi", "mn", "mo", "ms", "mspace", "mtext", "menclose", "merror", "mfenced", "mfrac", "mpadded",
    "mphantom", "mroot", "mrow", "msqrt", "mstyle", "mmultiscripts", "mover", "mprescripts", "msub", "msubsup", "msup", "munder",
    "munderover", "mtable", "mtr", "mtd", "annotation", "annotation-xml", "semantics", "maction",
)
#: Elements without content.
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "param", "source", "track", "wbr")
#: A stand-in tokenizer: a tag, a run of ASCII letters, or any other character is one token.
TOKEN = "<[^>]*>|[A-Za-z]+|[\\s\\S]"


def normalize_whitespace(c: Column) -> Column:
    """Runs of white space, as Unicode has it, as one space; not trimmed."""
    return F.regexp_replace(c, "(?U)[\\s&&[^ ]]\\s*| \\s+", " ")  # single spaces, which are most, don't match


def normalize_lines(c: Column, also: str = "") -> Column:
    """The same within the lines of a text, whose breaks stay; characters of ``also`` are white space too."""
    blank = "\\s" + "".join(f"\\{c}" for c in also)
    return F.regexp_replace(c, f"(?U)[{blank}&&[^ \n]][{blank}&&[^\n]]*| [{blank}&&[^\n]]+", " ")


def normalize_text(c: Column) -> Column:
    """Null where nothing but white space is left."""
    n = normalize_whitespace(c)
    return F.when(F.trim(n) != "", n)


def n_tokens(c: Column) -> Column:
    """How many tokens: characters, once each tag and run of letters is one; no token is made a string for it."""
    return F.length(F.regexp_replace(c, "<[^>]*>|[A-Za-z]{2,}", "x")).cast("long")


def split_href(c: Column) -> tuple[Column, Column]:
    """Path and fragment, cut at the first '#'; empty parts are null."""
    path = F.substring_index(c, "#", 1)
    at = F.locate("#", c)
    rest = F.when(at > 0, F.substring(c, at + 1, F.length(c)))
    return F.nullif(path, F.lit("")), F.nullif(rest, F.lit(""))


def unwrap_quotes(c: Column) -> Column:
    """Outer guillemets go, inner ones move out, in one pass."""
    return F.translate(c, "‹›〈〉«»《》", "«»《》")


def unclose_void(c: Column) -> Column:
    """`<br/>` as `<br>` for HTML output; names end where the tag name ends."""
    return F.regexp_replace(c, "<(" + "|".join(VOID_TAGS) + ")(?![A-Za-z0-9_:.-])([^>]*?)\\s*/>", "<$1$2>")


def is_inline(tag: Column, display: Column | None = None) -> Column:
    known = F.lower(tag).isin(*INLINE_TAGS)
    if display is None:
        return known
    shown = F.lower(F.coalesce(display, F.lit("")))
    return known | (shown == "inline") | ((F.lower(tag) == "math") & (shown != "block"))


def fingerprint(tag: Column, attrs: Column) -> Column:
    """`<tag a="1" b="2"/>` with sorted attributes: equal for elements that only differ in content."""
    shown = F.transform(F.array_sort(F.map_entries(attrs)), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    return F.concat(F.lit("<"), F.concat_ws(" ", F.concat(F.array(tag), shown)), F.lit("/>"))


def parse_id(c: Column) -> Column:
    """A whole number, with a sign or single underscores inside if need be; null if it isn't one."""
    bare = F.trim(c)
    return F.when(F.rlike(bare, F.lit("^[+-]?[0-9]+(_[0-9]+)*$")), F.replace(bare, F.lit("_"), F.lit("")).try_cast("bigint"))


def preview(c: Column, n: int = 30) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def token_hint(c: Column, n: int = 6) -> Column:
    tokens = F.regexp_extract_all(F.trim(c), F.lit(TOKEN), 0)
    return F.when(F.size(tokens) > n, F.concat(F.trim(F.array_join(F.slice(tokens, 1, n), "")), F.lit(" ..."))).otherwise(F.trim(c))


def sampling_value(begin: float, end: float, request: Column) -> Column:
    """Halfway to the upper bound at each request."""
    return F.lit(end) - F.lit(end - begin) * F.pow(F.lit(0.5), request)


def json_text(c: Column) -> Column:
    """A string as JSON writes it, non-ASCII characters kept."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return F.concat(F.lit('"'), out, F.lit('"'))


def message_payload(seed: Column, messages: Column) -> Column:
    """What a request's key is made of: seed and messages (array of role number and text) with sorted keys."""
    each = F.transform(messages, lambda m: F.concat(F.lit('{"message": '), json_text(m["message"]), F.lit(', "role": '), m["role"].cast("string"), F.lit("}")))
    return F.concat(F.lit('{"cache_seed": '), F.coalesce(json_text(seed), F.lit("null")), F.lit(', "messages": ['), F.array_join(each, ", "), F.lit("]}"))


def message_key(seed: Column, messages: Column, bits: int = 512) -> Column:
    return F.sha2(message_payload(seed, messages), bits)


def fences(c: Column, kind: str) -> Column:
    """Trimmed contents of the code fences of a kind, whatever its case."""
    return F.transform(F.regexp_extract_all(c, F.lit(f"(?is)```{kind}(.*?)```"), 1), lambda x: F.regexp_replace(x, "^\\s+|\\s+$", ""))


def toc_version(c: Column) -> Column:
    return F.when(F.startswith(F.coalesce(c, F.lit("2.0")), F.lit("3")), 3).otherwise(2)


def header_of(c: Column) -> Column:
    """What stands before the first element, kept as it is."""
    return F.regexp_extract(c, "(?s)^(.*?)(?=<[A-Za-z])", 1)


def valid_name(c: Column) -> Column:
    return F.rlike(c, F.lit("^[A-Za-z_][A-Za-z0-9_:.-]*$"))


def valid_value(c: Column) -> Column:
    return F.rlike(c, F.lit("^[A-Za-z0-9_:.,/#?&=%; -]*$"))


#: What is said of an answer without exactly one block.
NO_ANSWER = "No complete <xml>...</xml> block found. Please ensure you have properly closed the XML with </xml> tag."
MANY_ANSWERS = "Found {n} <xml>...</xml> blocks. Please return only one XML block without any examples or explanations."


def wrong_answer(n: int) -> str:
    return MANY_ANSWERS.format(n=n) if n else NO_ANSWER


def single_answer(c: Column) -> tuple[Column, Column]:
    """The one <xml> block of an answer, or an error text that says how many there are."""
    found = F.regexp_extract_all(c, F.lit("(?s)<xml>.*?</xml>"), 0)
    n = F.size(found)
    error = F.when(n == 0, F.lit(NO_ANSWER)).when(n > 1, F.replace(F.lit(MANY_ANSWERS), F.lit("{n}"), n.cast("string")))
    return F.when(n == 1, found[0]), error


#: Target languages by constant and by the name they are asked for.
LANGUAGES = {
    "CHINESE": "Simplified Chinese", "ENGLISH": "English", "JAPANESE": "Japanese", "KOREAN": "Korean", "SPANISH": "Spanish",
    "FRENCH": "French", "GERMAN": "German", "PORTUGUESE": "Portuguese", "TRADITIONAL_CHINESE": "Traditional Chinese",
    "RUSSIAN": "Russian", "ITALIAN": "Italian", "ARABIC": "Arabic", "HINDI": "Hindi", "DUTCH": "Dutch", "POLISH": "Polish",
    "TURKISH": "Turkish", "VIETNAMESE": "Vietnamese", "THAI": "Thai", "INDONESIAN": "Indonesian", "SWEDISH": "Swedish",
    "DANISH": "Danish", "NORWEGIAN": "Norwegian", "FINNISH": "Finnish",
}
