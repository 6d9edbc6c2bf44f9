"""Column-level string functions (all JVM-side Catalyst expressions, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. Python's str.isspace() set, as a Java regex class: \t..\r, the four
# information separators, NEL, and every Unicode separator (Zs, Zl, Zp).
WS_CLASS = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
# Fixed values. Inference chat markers and the reply separator.
INST_OPEN = "<s>[INST] "
INST_CLOSE = " [/INST]"
REPLY_MARK = "[/INST]"
# Fixed values. Word-level tokenizer of the built vocabulary: chat specials, word runs,
# single punctuation characters.
WORD_TOKEN_RE = r"</?s>|\[/?INST\]|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


# The four punctuation rules of 13a, in their order, as patterns that find the rare character first
# and then look behind. The tokens are those of the published rules: a space is not set apart from
# its neighbours once more, and as a run of points and commas is taken in pairs there, the second
# rule takes the character after a match along.
RULES_13A = (
    (r"[\{-~\[-`!-&\(-\+:-@/]", " $0 "),
    (r"([\.,])(?<![0-9][\.,])([\.,]?)", " $1 $2"),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"-(?<=[0-9]-)", " - "),
)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ustrip(col: Column | str) -> Column:
    """Python ``str.strip()`` (Unicode whitespace), not SQL ``trim`` (space only)."""
    return F.regexp_replace(_c(col), rf"^{WS_CLASS}+|{WS_CLASS}+\z", "")


def urstrip(col: Column | str) -> Column:
    """Python ``str.rstrip()``."""
    return F.regexp_replace(_c(col), rf"{WS_CLASS}+\z", "")


def ws_split(col: Column | str) -> Column:
    """Python ``str.split()``: split on runs of Unicode whitespace, no empty tokens."""
    return F.array_remove(F.split(_c(col), f"{WS_CLASS}+"), "")


def is_blank(col: Column | str) -> Column:
    """NULL, empty or whitespace only."""
    c = _c(col)
    return c.isNull() | (ustrip(c) == "")


def lang_label(col: Column | str) -> Column:
    """``code.split('-')[0].upper()`` - the label used inside training prompts."""
    return F.upper(F.split_part(_c(col), F.lit("-"), F.lit(1)))


def iso2(col: Column | str) -> Column:
    """``code.upper()[:2]`` with a missing or NULL code read as ``''``."""
    return F.substring(F.upper(F.coalesce(_c(col), F.lit(""))), 1, 2)


def xml_escape(col: Column | str) -> Column:
    """Escape text for XML element content."""
    c = F.replace(_c(col), F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    return F.replace(c, F.lit(">"), F.lit("&gt;"))


def extract_reply(col: Column | str) -> Column:
    """Generated text after the last ``[/INST]`` marker, stripped (whole text if none)."""
    return ustrip(F.element_at(F.split(_c(col), r"\[/INST\]"), -1))


def word_tokens(col: Column | str) -> Column:
    """Word-level tokens used by the built vocabulary (array<string>)."""
    return F.regexp_extract_all(F.coalesce(_c(col), F.lit("")), F.lit(WORD_TOKEN_RE), 0)


def tok_13a(col: Column | str) -> Column:
    """The standard '13a' BLEU tokenization of a segment, as array<string>.

    Same steps as the metric's reference definition: right-strip, drop ``<skipped>``,
    join hyphenated line breaks, newline to space, unescape four entities, pad with
    spaces, then the four punctuation rules, then split on whitespace.
    """
    t = urstrip(F.coalesce(_c(col), F.lit("")))
    t = F.replace(t, F.lit("<skipped>"), F.lit(""))
    t = F.replace(t, F.lit("-\n"), F.lit(""))
    t = F.replace(t, F.lit("\n"), F.lit(" "))
    # Entity unescape order.
    for ent, ch in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(ent), F.lit(ch))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    for pattern, spaced in RULES_13A:
        t = F.regexp_replace(t, pattern, spaced)
    return ws_split(t)


def ngrams(tokens: Column, n: int) -> Column:
    """array<string> of space-joined n-grams of a token array (empty if too short)."""
    count = F.size(tokens) - (n - 1)
    return F.when(
        count > 0,
        F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(tokens, i, n), " ")),
    ).otherwise(F.array().cast("array<string>"))


def format_score(col: Column | str) -> Column:
    """Two-decimal text of a score (``'%.2f'``)."""
    return F.format_string("%.2f", _c(col))
