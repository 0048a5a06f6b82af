"""Text helpers: conversation flattening and keyword-pattern building.

Patterns are built on the driver from a small keyword dictionary (a few
thousand literals at most) and used as foldable ``rlike`` /
``regexp_extract_all`` patterns, so each executor compiles each one once.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# A "word character" for the boundary rule: Unicode letters, digits and "_".
_WORD = r"[\p{L}\p{N}_]"


_BOUNDED = frozenset(string.ascii_letters + string.digits + "_")


def _edge_is_word(ch: str) -> bool:
    """A keyword edge gets a boundary when it is one of the 63 ASCII word characters."""
    return ch in _BOUNDED


def _parts(keywords, escape):
    out = []
    for kw in keywords:
        k = kw.lower()
        if not k:
            continue
        out.append((k, _edge_is_word(k[0]), _edge_is_word(k[-1]), escape(k)))
    return out


def _order_key(part) -> int:
    # Longest alternative first so a short keyword cannot pre-empt a longer one
    # starting at the same position; length is measured on the boundary-marked,
    # escaped keyword (stable sort keeps dictionary order among equals).
    k, left, right, _ = part
    return -(len(re.escape(k)) + (2 if left else 0) + (2 if right else 0))


def java_pattern(keywords) -> str:
    """One Java regex matching any keyword with word-boundary edges.

    Boundaries are non-consuming look-arounds over Unicode letters/digits, so a
    keyword inside ``用python写`` or ``épython`` does not count, and matches can
    be counted with ``regexp_extract_all``.
    """
    parts = sorted(_parts(keywords, re.escape), key=_order_key)
    alts = []
    for _k, left, right, esc in parts:
        alts.append((f"(?<!{_WORD})" if left else "") + esc + (f"(?!{_WORD})" if right else ""))
    return "|".join(alts)


def _re2_escape(s: str) -> str:
    return "".join("\\" + ch if (ch.isascii() and not ch.isalnum() and ch not in " _") else ch
                   for ch in s)


def re2_pattern(keywords) -> str:
    """The same keyword set for RE2 engines (no look-arounds): edges consume one
    neighbouring non-word character, which is exact for found / not found."""
    parts = sorted(_parts(keywords, _re2_escape), key=_order_key)
    alts = []
    for _k, left, right, esc in parts:
        alts.append(("(^|[^\\p{L}\\p{N}_])" if left else "") + esc
                    + ("($|[^\\p{L}\\p{N}_])" if right else ""))
    return "|".join(alts)


def topic_patterns(dictionary, dialect: str = "java") -> dict[str, str]:
    """``{topic: pattern}`` in dictionary order; ``dictionary`` maps topic to keywords."""
    build = java_pattern if dialect == "java" else re2_pattern
    return {topic: build(kws) for topic, kws in dictionary.items()}


def flatten_messages(conv: Column | str, field: str = "content",
                     skip_empty: bool = True) -> Column:
    """Lower-cased text of all messages joined by one space.

    ``skip_empty=True`` drops null and empty parts (listing / index form);
    ``False`` keeps every message, a null content counting as empty (the form
    the tagger sees, where two empty-separated words are two spaces apart).
    """
    c = F.col(conv) if isinstance(conv, str) else conv
    contents = F.transform(c, lambda m: m[field])
    if skip_empty:
        parts = F.filter(contents, lambda x: x.isNotNull() & (x != ""))
    else:
        parts = F.transform(contents, lambda x: F.coalesce(x, F.lit("")))
    return F.lower(F.concat_ws(" ", parts))


# Non-word run used to split text into tokens; the complement of _WORD.
TOKEN_SPLIT = r"[^\p{L}\p{N}_]+"


def keyword_kind(keyword: str) -> str:
    """How a keyword can be matched exactly without a regex scan.

    * ``token``: only letters/digits/underscore with boundaries on both edges -
      it occurs iff it equals one token of the text split on non-word runs;
    * ``substring``: no boundary on either edge - a plain substring test;
    * ``regex``: anything else (phrases, inner punctuation, one-sided edges).
    """
    k = keyword.lower()
    left, right = _edge_is_word(k[0]), _edge_is_word(k[-1])
    if left and right and re.fullmatch(r"[\w]+", k) and all(c.isalnum() or c == "_" for c in k):
        return "token"
    if not left and not right:
        return "substring"
    return "regex"


def required_tokens(keyword: str) -> list[str]:
    """Whole tokens a keyword match must contain: the word runs of the keyword
    that are bounded on both sides (inner runs, plus the first / last run when
    that edge has a word boundary).  A match implies each is a token of the text."""
    k = keyword.lower()
    runs = [r for r in re.split(r"[^\w]+", k) if r]
    if not runs:
        return []
    out = []
    for i, r in enumerate(runs):
        if not all(c.isalnum() or c == "_" for c in r):
            continue
        first = i == 0 and k.startswith(r)
        last = i == len(runs) - 1 and k.endswith(r)
        if (first and not _edge_is_word(k[0])) or (last and not _edge_is_word(k[-1])):
            continue
        out.append(r)
    return out


def dictionary_tokens(dictionary) -> list[str]:
    """Every token a dictionary can need to look up (``found`` set of ``keyword_hit``)."""
    toks = set()
    for kws in dictionary.values():
        for k in kws:
            if not k:
                continue
            if keyword_kind(k) == "token":
                toks.add(k.lower())
            elif keyword_kind(k) == "regex":
                toks.update(required_tokens(k))
    return sorted(toks)


def found_tokens(tokens: Column, dictionary) -> Column:
    """The dictionary tokens present in a row: one hash-set intersection per row,
    shared by every topic test."""
    toks = dictionary_tokens(dictionary)
    if not toks:
        return F.array().cast("array<string>")
    return F.array_intersect(tokens, F.array(*[F.lit(t) for t in toks]))


def keyword_hit(text: Column, found: Column, keywords) -> Column:
    """True when any keyword occurs in ``text`` (lower-case) under the boundary
    rule; ``found`` is ``found_tokens(split(text, TOKEN_SPLIT), dictionary)``.

    Exactly the found / not-found result of the combined regex: whole-token
    keywords by membership in ``found``; boundary-free keywords by substring;
    the rest by regex, run only on rows that hold the tokens such a match
    needs and the keyword as a substring.
    """
    kws = [k.lower() for k in keywords if k]
    tok = [k for k in kws if keyword_kind(k) == "token"]
    sub = [k for k in kws if keyword_kind(k) == "substring"]
    rx = [k for k in kws if keyword_kind(k) == "regex"]
    conds = []
    if tok:
        conds.append(F.coalesce(F.arrays_overlap(found, F.array(*[F.lit(k) for k in tok])), F.lit(False)))
    for k in sub:
        conds.append(text.contains(k))
    for k in rx:
        # per keyword: its regex runs only where its tokens and its text occur
        c = text.contains(k)
        for t in required_tokens(k):
            c = F.array_contains(found, F.lit(t)) & c
        conds.append(c & text.rlike(java_pattern([k])))
    if not conds:
        return F.lit(False)
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def tags_to_json(tags) -> Column:
    """TG9: tag array -> JSON text (as stored by the tagger)."""
    c = F.col(tags) if isinstance(tags, str) else tags
    return F.to_json(c)


def tags_from_json(text) -> Column:
    """TG9: JSON text -> tag array; malformed or non-array JSON gives null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.from_json(c, "array<string>")
