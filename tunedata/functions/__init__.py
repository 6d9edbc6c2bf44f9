"""Column functions: whitespace, language codes, XML escaping, replies, 13a tokens."""

from tunedata.functions.text import (  # noqa: F401
    WORD_TOKEN_RE,
    extract_reply,
    format_score,
    is_blank,
    iso2,
    lang_label,
    ngrams,
    tok_13a,
    urstrip,
    ustrip,
    word_tokens,
    ws_split,
    xml_escape,
)
