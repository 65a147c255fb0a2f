"""Text column expressions (all JVM-side; no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trapwise import config

# --- fixed values: character classes -------------------------------------------
# Whitespace removed by Python's str.strip(): \t \n \v \f \r, the four
# information separators, space, NEL, NBSP, OGHAM SPACE MARK, the spaces
# U+2000..U+200A, LINE/PARAGRAPH SEPARATOR, NNBSP, MMSP, IDEOGRAPHIC SPACE.
WS_CLASS = (r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# Line boundaries of str.splitlines(): \n \r \v \f, FS GS RS, NEL, LS, PS.
NOT_LINE_BREAK = r"[^\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokenize(text: Column | str) -> Column:
    """Lower-case, then all runs of ASCII letters/digits (accents split words)."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(config.TOKEN_PATTERN), F.lit(0))


def ustrip(text: Column | str) -> Column:
    """Strip leading/trailing whitespace like Python ``str.strip()``.

    Spark's ``trim`` removes only spaces.
    """
    return F.regexp_replace(_c(text), f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def first_line(text: Column | str) -> Column:
    return F.regexp_extract(_c(text), f"^({NOT_LINE_BREAK}*)", 1)


def title_of(text: Column | str) -> Column:
    """Title = first line (``splitlines`` boundaries), stripped; NULL for an empty doc."""
    t = _c(text)
    return F.when(F.length(t) > 0, ustrip(first_line(t)))


def compose_text(title: Column | str, doc: Column | str) -> Column:
    """``title + "\\n" + doc`` unless the title is empty or already leads the doc.

    Both parts are stripped first; a NULL part counts as empty.
    """
    t = ustrip(F.coalesce(_c(title), F.lit("")))
    d = ustrip(F.coalesce(_c(doc), F.lit("")))
    return F.when((t != "") & ~d.startswith(t), F.concat(t, F.lit("\n"), d)).otherwise(d)


_TRAIL = r"[?.!\s]+$"


def _clean(x: Column) -> Column:
    return ustrip(F.regexp_replace(x, _TRAIL, ""))


def rule_decompose(query: Column | str) -> tuple[Column, Column]:
    """Split an exclusion query into (target, trap) by its wrapper phrase.

    ``A excluding B`` -> (A, B); ``excluding B, A`` -> (A, B); no wrapper ->
    (query, ""); trailing ``?.!`` removed.  Returns two columns.
    """
    q = ustrip(_c(query))
    lead_pat = "(?is)" + config.RULE_LEADING_PATTERN
    mid_pat = "(?is)" + config.RULE_SPLIT_PATTERN
    lead_1, lead_2 = F.regexp_extract(q, lead_pat, 1), F.regexp_extract(q, lead_pat, 2)
    mid_1, mid_2 = F.regexp_extract(q, mid_pat, 1), F.regexp_extract(q, mid_pat, 2)
    # a match is seen from a non-empty group ("([^,]+)" / "(.+)" never match empty),
    # so no separate rlike pass is needed
    has_lead = lead_1 != ""
    mid_target = _clean(mid_1)
    has_mid = (mid_2 != "") & (mid_target != "")
    target = F.when(has_lead, _clean(lead_2)).when(has_mid, mid_target).otherwise(_clean(q))
    trap = F.when(has_lead, _clean(lead_1)).when(has_mid, _clean(mid_2)).otherwise(F.lit(""))
    return target, trap


def decompose_frame(df, query: str, target: str = "Q_target", trap: str = "Q_trap", keep=()):
    """``rule_decompose`` as two projections: the four regex captures are
    computed once in their own columns (Spark keeps a non-cheap column that
    is read several times in its own projection), then combined."""
    lead_pat = "(?is)" + config.RULE_LEADING_PATTERN
    mid_pat = "(?is)" + config.RULE_SPLIT_PATTERN
    q = ustrip(F.col(query))
    staged = df.select(*keep, q.alias("__q")).select(
        *keep, "__q",
        F.regexp_extract("__q", lead_pat, 1).alias("__l1"), F.regexp_extract("__q", lead_pat, 2).alias("__l2"),
        F.regexp_extract("__q", mid_pat, 1).alias("__m1"), F.regexp_extract("__q", mid_pat, 2).alias("__m2"))
    staged = staged.select(*keep, "__q", "__l1", "__l2", "__m2", _clean(F.col("__m1")).alias("__mt"))
    has_lead = F.col("__l1") != ""
    has_mid = (F.col("__m2") != "") & (F.col("__mt") != "")
    t = F.when(has_lead, _clean(F.col("__l2"))).when(has_mid, F.col("__mt")).otherwise(_clean(F.col("__q")))
    p = F.when(has_lead, _clean(F.col("__l1"))).when(has_mid, _clean(F.col("__m2"))).otherwise(F.lit(""))
    return staged.select(*keep, t.alias(target), p.alias(trap))
