"""Text clean-up and text features."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailscore import constants as c

# A script, style or comment that is never closed reaches to the end of the text.
_UNCLOSED_RE = r"(?is)(?:<script[^>]*>|<style[^>]*>|<!--).*\z"


def portable(pattern: str) -> str:
    """Spell ``\\s`` and ``\\d`` so that they cover all of Unicode in Java."""
    return pattern.replace(r"\s", f"[{c.WS}]").replace(r"\d", r"\p{Nd}")


def ws_trim(text: Column) -> Column:
    """Trim every kind of white space (``trim`` removes blanks only)."""
    return F.btrim(text, F.lit(c.WS_CHARS))


def _reference_table() -> Column:
    """Named references, the common ones first, and the numbers that browsers read as Windows-1252, to their characters."""
    table = {name[1:]: char for name, char in c.HTML_ENTITIES}
    table |= {name: char for name, char in html5.items() if name.endswith(";")} | table
    table |= {f"#{i};": bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(128, 160)}
    pairs = F.lit("\x1e".join(f"{name}\x1f{char}" for name, char in table.items()))
    return F.str_to_map(pairs, F.lit("\x1e"), F.lit("\x1f"))  # folded to a constant


def decode_references(text: Column) -> Column:
    """``&eacute;``, ``&#233;`` and ``&#xE9;`` to their characters, once; anything else stays as it is."""
    pieces = F.split(text, "&", -1)
    table = _reference_table()

    def decode(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,40});", 1)
        digits = F.nullif(F.regexp_extract(name, r"^#([0-9]+)$", 1), F.lit(""))
        hexes = F.nullif(F.regexp_extract(name, r"^#[xX]([0-9A-Fa-f]+)$", 1), F.lit(""))
        code = F.coalesce(digits.cast("int"), F.conv(hexes, 16, 10).cast("int"))
        usable = (code.between(1, 0x7F) | code.between(0xA0, 0xD7FF) | code.between(0xE000, 0x10FFFF))
        numbered = F.when(usable, F.decode(F.to_binary(F.lpad(F.hex(code), 8, "0"), F.lit("hex")), "UTF-32"))
        named = F.try_element_at(table, F.concat(F.when(code.isNotNull(), F.concat(F.lit("#"), code)).otherwise(name), F.lit(";")))
        char = F.when(name == "", None).when(usable, numbered).otherwise(named)
        return F.coalesce(F.concat(char, F.substr(piece, F.length(name) + 2)), F.concat(F.lit("&"), piece))

    joined = F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(decode(p))), "")
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def strip_html(text: Column) -> Column:
    """Text of an HTML message, parts joined by a blank; text without ``<`` and ``>`` passes unchanged."""
    bare = text
    for pattern in [*c.HTML_DROP_RES[:3], _UNCLOSED_RE, *c.HTML_DROP_RES[3:]]:
        bare = F.regexp_replace(bare, pattern, " ")
    bare = decode_references(bare)
    looks_html = F.contains(text, F.lit("<")) & F.contains(text, F.lit(">"))
    return F.when(text.isNull(), F.lit("")).when(looks_html, bare).otherwise(text)


def collapse_ws(text: Column) -> Column:
    """NUL to blank, white-space runs to one blank, ends trimmed."""
    blanked = F.translate(text, "\x00" + c.WS_CHARS, " " * (1 + len(c.WS_CHARS)))
    return F.trim(F.regexp_replace(blanked, " {2,}", " "))


def normalize_text(text: Column) -> Column:
    """Bare text on one line."""
    return collapse_ws(strip_html(text))


def join_subject(subject: Column, body: Column) -> Column:
    """Subject and body as one text; a missing or empty subject adds nothing."""
    return F.when(F.length(subject) > 0, F.concat(subject, F.lit(" "), body)).otherwise(body)


# --------------------------------------------------------------------- features
def urls(text: Column, lowered: Column | None = None) -> Column:
    """All links of a text; the regular expression runs only where one can match."""
    low = F.lower(text) if lowered is None else lowered
    may_match = F.contains(low, F.lit("://")) | F.contains(low, F.lit("www."))
    found = F.regexp_extract_all(text, F.lit(c.URL_RE), F.lit(0))
    return F.when(may_match, found).otherwise(F.array().cast("array<string>"))


def url_count(found: Column) -> Column:
    """Number of links, from :func:`urls`."""
    return F.size(found)


def has_url(found: Column) -> Column:
    return (F.size(found) > 0).cast("int")


def exclamation_count(text: Column) -> Column:
    left = F.length(F.replace(text, F.lit("!"), F.lit("")))
    return F.coalesce(F.length(text) - left, F.lit(0)).cast("int")


def char_count(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0)).cast("int")


def sql_text(word: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _shortest(words: list[str]) -> list[str]:
    """The words that hold no other word of the list: enough to decide whether any occurs."""
    return [w for w in words if not any(o != w and o in w for o in words)]


# The keyword lists are long, so they are written as one SQL expression over a
# named column: a plan is built much faster that way than Column by Column.
def contains_any(lowered: str, words: list[str]) -> Column:
    hits = " OR ".join(f"contains({lowered}, {sql_text(w)})" for w in _shortest(words))
    return F.expr(f"CAST(coalesce({hits}, false) AS INT)")


def count_contained(lowered: str, words: list[str]) -> Column:
    hits = " + ".join(f"CAST(contains({lowered}, {sql_text(w)}) AS INT)" for w in words)
    return F.expr(f"coalesce({hits}, 0)")


def contained_words(lowered: str, words: list[str]) -> Column:
    """The words that occur, in list order."""
    hits = ", ".join(f"IF(contains({lowered}, {sql_text(w)}), {sql_text(w)}, NULL)" for w in words)
    return F.expr(f"array_compact(array({hits}))")


def urgent_flag(lowered: str) -> Column:
    return contains_any(lowered, c.URGENT_KEYWORDS)


def urgent_count(lowered: str) -> Column:
    return count_contained(lowered, c.URGENT_KEYWORDS)


def attachment_flag(lowered: str) -> Column:
    return contains_any(lowered, c.ATTACHMENT_KEYWORDS)


def sender_domain(text: Column) -> Column:
    """Domain of the first address in the text, else ``unknown``."""
    found = F.when(F.contains(text, F.lit("@")), F.lower(F.regexp_extract(text, c.ADDRESS_RE, 1)))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("unknown"))


def first_address(text: Column) -> Column:
    found = F.when(F.contains(text, F.lit("@")), F.regexp_extract(text, c.ADDRESS_RE, 0))
    return F.nullif(found, F.lit(""))


def link_domains(found: Column, fix_scheme_case: bool = False) -> Column:
    """Distinct domains, in order of appearance, of the links from :func:`urls`.

    The scheme is matched in lower case only, so an upper-case scheme counts as
    the domain; ``fix_scheme_case`` reads such links as well.
    """

    def domain(url: Column) -> Column:
        cut = F.regexp_extract(F.lower(url) if fix_scheme_case else url, c.LINK_DOMAIN_RE, 1)
        return F.split_part(F.lower(cut), F.lit(":"), F.lit(1))

    return F.array_distinct(F.filter(F.transform(found, domain), lambda d: d != ""))


def tokens(text: Column) -> Column:
    """Lower-cased word tokens of two characters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit(c.TOKEN_RE), F.lit(0))
