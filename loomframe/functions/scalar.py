"""Scalar column expressions.  All run inside the JVM; none needs a Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and digits of any script; plain ``\w`` would be ASCII only.
TOKEN = r"[\p{L}\p{N}]+"
WORD = r"[\p{L}\p{N}_]+"
#: The DNS name space of version-5 UUIDs (RFC 4122).
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def norm(text: Column) -> Column:
    """Blanks at the ends and case aside."""
    return F.lower(F.trim(text))


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def query_tokens(text: str, limit: int = 24) -> list[str]:
    """The first ``limit`` words of a query string, case folded; a word written twice stays twice."""
    import regex

    return [w.lower() for w in regex.findall(WORD, text)[:limit]]


def _slug(text: Column, drop: str, size: int, default: str = "") -> Column:
    made = F.substring(F.regexp_replace(F.lower(F.regexp_replace(text, drop, "-")), r"^-+|-+$", ""), 1, size)
    return F.when(made == "", F.lit(default)).otherwise(made)


def claim_slug(text: Column) -> Column:
    """Runs of anything but ASCII letters, digits and Hangul become one hyphen; 80 characters at most."""
    return _slug(text, r"[^0-9a-zA-Z가-힣]+", 80, "claim")


def ascii_slug(text: Column, size: int = 64) -> Column:
    return _slug(F.lower(text), r"[^a-z0-9-]+", size)


def entity_slug(text: Column) -> Column:
    """Blanks, underscores and slashes become hyphens, other punctuation goes, repeated hyphens shrink."""
    spaced = F.regexp_replace(norm(text), r"[\s_/]+", "-")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(spaced, r"[^\p{L}\p{N}-]", ""), r"-+", "-"), r"^-|-$", "")


def capture_slug(text: Column) -> Column:
    kept = F.regexp_replace(text, r"[^\p{L}\p{N}_ -]", "")
    return F.substring(F.regexp_replace(F.lower(F.trim(kept)), r"\s+", "-"), 1, 40)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def uuid5(name: Column, namespace_hex: str = DNS_NAMESPACE) -> Column:
    """The version-5 UUID of ``name``."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.substr(F.lit("89ab"), ((F.instr(F.lit("0123456789abcdef"), F.substring(h, 17, 1)) - 1) % 4 + 1).cast("int"), F.lit(1))
    return F.lower(
        F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
    )


def text_hash(text: Column) -> Column:
    return F.sha1(text)


def collapsed_sha(text: Column) -> Column:
    """SHA-256 of the text with runs of white space made one blank."""
    return F.sha2(F.trim(F.regexp_replace(text, r"\s+", " ")), 256)


def month_shard(text: Column) -> Column:
    """``YYYY-MM`` at the start of a date string, else ``undated``."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"^(\d{4}-\d{2})", 1)
    return F.when(found == "", F.lit("undated")).otherwise(found)


def as_date(text: Column) -> Column:
    """The date in the first ten characters, null where there is none."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def age_days(as_of: Column, day: Column) -> Column:
    """Whole days, never below 0."""
    return F.greatest(F.lit(0), F.date_diff(as_of, day))


def days_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / F.lit(86_400_000_000.0)


def word_count(text: Column) -> Column:
    """Words outside of code fences."""
    return F.size(F.regexp_extract_all(F.regexp_replace(text, r"(?s)```.*?```", " "), F.lit(WORD), F.lit(0)))


def assets(text: Column) -> Column:
    """Image targets of markdown and HTML in order of first mention, markdown first."""
    markdown = F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1))
    html = F.regexp_extract_all(text, F.lit(r"""<img[^>]*src=["']([^"']+)["']"""), F.lit(1))
    return F.array_distinct(F.concat(markdown, html))


def set_key(ids: Column) -> Column:
    """Sixteen hex digits that name a set of ids."""
    return F.substring(F.sha2(F.array_join(F.array_sort(ids), "|"), 256), 1, 16)


def salient_terms(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct ASCII words of four letters or more outside of heading lines, stop words aside."""
    body = F.regexp_replace(text, r"(?m)^#.*$", "")
    found = F.array_distinct(F.regexp_extract_all(F.lower(body), F.lit(r"[a-z][a-z0-9_-]{3,}"), F.lit(0)))
    return F.array_except(found, F.array(*[F.lit(w) for w in stop])) if stop else found


def first_line_after(text: Column, heading: str) -> Column:
    """The first line that is not blank after a ``## heading`` line."""
    return F.trim(F.regexp_extract(text, rf"(?im)^##\s+{heading}\s*\n\s*([^\n]+)", 1))


def path_like(path: Column, glob: str) -> Column:
    """A glob in which ``*`` crosses slashes."""
    import re

    return path.rlike("^" + re.escape(glob).replace(r"\*\*", ".*").replace(r"\*", ".*").replace(r"\?", ".") + "$")


def asset_name(url: Column) -> Column:
    """``sha1(url)[:16]`` and the extension of its path, ``.bin`` where there is none."""
    ext = F.lower(F.regexp_extract(url, r"^[^?#]*/[^/?#]*(\.[A-Za-z0-9]{1,5})(?:[?#].*)?$", 1))
    return F.concat(F.substring(F.sha1(url), 1, 16), F.when(ext == "", F.lit(".bin")).otherwise(ext))


def cut_at_line(text: Column, size: int) -> Column:
    """``text`` up to ``size`` characters, cut back to the last line end within them where there is one."""
    head = F.substring(text, 1, size)
    at = F.instr(F.reverse(head), "\n")
    return F.when(F.char_length(text) <= size, text).when(at > 0, F.substr(head, F.lit(1), F.lit(size) - at)).otherwise(head)
