"""String expressions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware whitespace split separates on.
WHITESPACE = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# The same characters behind two plain ranges, which turn most characters away at once; SQL engines do not know ``&&``.
BLANK = r"[\x00-\x{20}\x{85}-\x{3000}&&" + WHITESPACE + "]"
# The same characters one by one, for trimming.
BLANKS = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# ASCII punctuation removed by answer normalisation.
PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def words(text: Column) -> Column:
    """Whitespace words without empty strings."""
    return F.array_remove(F.split(text, BLANK + "+"), "")


def terms(text: Column) -> Column:
    """Lower-cased whitespace words, the lexical index vocabulary."""
    return words(F.lower(text))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def strip(text: Column) -> Column:
    """Trim whitespace on both ends."""
    return F.btrim(text, F.lit(BLANKS))


def squeeze(text: Column) -> Column:
    """Collapse whitespace runs to one blank and trim."""
    return F.array_join(words(text), " ")


def truncate_words(text: Column, limit: int) -> Column:
    """First ``limit`` words; texts within the limit are returned untouched."""
    parts = words(text)
    return F.when(F.size(parts) > limit, F.array_join(F.slice(parts, 1, limit), " ")).otherwise(text)


def preview(text: Column, limit: int = 50) -> Column:
    """First words followed by an ellipsis when the text is longer."""
    parts = words(text)
    return F.when(
        F.size(parts) > limit, F.concat(F.array_join(F.slice(parts, 1, limit), " "), F.lit("..."))
    ).otherwise(text)


def clip(text: Column, max_words: int = 1000, max_chars: int = 10000) -> Column:
    """Clip by words, then by characters, marking each cut with an ellipsis."""
    by_words = preview(text, max_words)
    return F.when(
        F.length(by_words) > max_chars, F.concat(F.substring(by_words, 1, max_chars), F.lit("..."))
    ).otherwise(by_words)


def repair_dashes(text: Column) -> Column:
    """Remove the blanks a line break leaves after a dash."""
    return F.regexp_replace(text, f"-{WHITESPACE}+", "-")


def clean_entity_name(name: Column) -> Column:
    return squeeze(F.lower(name))


def clean_entity_type(kind: Column) -> Column:
    return F.replace(F.upper(kind), F.lit(" "), F.lit("_"))


def entity_key(name: Column, kind: Column) -> Column:
    """Graph node key of an entity."""
    return F.concat(F.lit("Name: "), name, F.lit("\nType: "), kind)


def split_markers(text: Column, markers: list[str]) -> Column:
    """Split on any of several literal markers; parts are trimmed and empty parts dropped."""
    if not markers:
        return F.array(text)
    pattern = "|".join("\\Q" + m + "\\E" for m in markers)
    return F.array_remove(F.transform(F.split(text, pattern), strip), "")


# The named character references that occur in extracted records.
NAMED_REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def unescape_html(text: Column) -> Column:
    """Resolve the common named character references; the ampersand goes last."""
    for name, char in NAMED_REFERENCES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def clean_record_field(text: Column) -> Column:
    """Unescape, drop control characters, keep ASCII letters, digits and blanks, lower-case, trim."""
    plain = F.regexp_replace(unescape_html(strip(text)), r"[\x00-\x1f\x7f-\x{9f}]", "")
    return F.trim(F.regexp_replace(F.lower(plain), "[^A-Za-z0-9 ]", " "))


def is_plain_float(text: Column) -> Column:
    return text.rlike(r"^[-+]?[0-9]*\.?[0-9]+$")


def parse_number(text: Column) -> Column:
    """Double value of a numeric string, NULL otherwise."""
    numeric = text.rlike(r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$")
    return F.when(numeric, F.trim(text).try_cast("double"))


def first_word_is_acronym(text: Column) -> Column:
    """First word longer than one character, with a cased character and no lower-case one."""
    first = F.get(words(text), F.lit(0))
    return F.coalesce(
        (F.length(first) > 1) & (first == F.upper(first)) & (F.lower(first) != F.upper(first)), F.lit(False)
    )


# Words after which a sentence cannot end.
CONNECTORS = [
    "and", "or", "but", "because", "although", "however", "if", "while", "when", "to", "for", "in", "of", "with",
    "on", "as", "at", "by", "from", "such", "the", "a", "an",
]


def looks_incomplete(text: Column) -> Column:
    """Whether a paragraph seems cut off by a page or column break."""
    body = strip(text)
    unquoted = F.rtrim(body, F.lit("'\""))
    # The last character may stand before a final line break, which is two characters at most.
    ending = F.right(unquoted, F.lit(3))
    # Words are entered at their first character and never given back, so that a text is passed once.
    last_word = F.lower(F.regexp_extract(unquoted, r"(?<!\w)(\w++)\W*+$", 1))
    # A stripped text has as many words as parts; more than five need no count.
    few = F.size(F.split(body, BLANK + "+", 5)) < 5
    return (
        F.when(body.isNull() | (F.length(body) < 25) | few, False)
        .when(body.endswith("-"), True)
        .when(ending.rlike("[,:;]$"), True)
        .when(~ending.rlike("[.!?]$"), True)
        .when(last_word.isin(CONNECTORS), True)
        .otherwise(False)
    )


def cut_garbage_tail(text: Column, window: int = 15, needed: int = 14) -> Column:
    """Cut a text before the first run of ``window`` words of which ``needed`` or more are single characters.

    One flag per word turns the sliding window into a regular expression over a short flag string.
    """
    parts = words(text)
    flags = F.array_join(F.transform(parts, lambda w: F.when(F.length(w) == 1, "1").otherwise("0")), "")
    start = F.regexp_instr(flags, F.lit(_dense_run(window, window - needed)))
    return F.when(start > 0, F.array_join(F.slice(parts, 1, start - 1), " ")).otherwise(text)


def _dense_run(window: int, zeros: int) -> str:
    """Pattern for ``window`` flags holding at most ``zeros`` zeros."""
    if zeros == 0:
        return f"1{{{window}}}"
    if window <= zeros:
        return f"[01]{{{window}}}"
    return f"(?:1{_dense_run(window - 1, zeros)}|0{_dense_run(window - 1, zeros - 1)})"
