"""Message payloads: headers, bodies, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAYLOAD_SCHEMA = (
    "id string, payload struct<mimeType string, headers array<struct<name string, value string>>, "
    "body struct<data string>, parts array<struct<mimeType string, body struct<data string>>>>"
)


# Zone names that mail dates may carry.
ZONES = [
    ("UT|UTC|GMT|Z", "+0000"), ("EST|CDT", "-0500"), ("EDT|AST", "-0400"), ("CST|MDT", "-0600"),
    ("MST|PDT", "-0700"), ("PST", "-0800"),
]


def header(headers: Column, name: str) -> Column:
    """Value of a header, the last one of that name; empty if there is none."""
    named = F.filter(headers, lambda h: h["name"] == name)
    return F.coalesce(F.try_element_at(named, F.lit(-1))["value"], F.lit(""))


def decoded(data: Column) -> Column:
    """URL-safe base64 to text; foreign characters and bytes that are no UTF-8 are dropped, null if it is cut short."""
    plain = F.regexp_replace(F.translate(data, "-_", "+/"), "[^A-Za-z0-9+/=]", "")
    raw = F.try_to_binary(plain, F.lit("base64"))
    return valid_text(raw)


def valid_text(raw: Column) -> Column:
    """Bytes as text; from bytes that are no UTF-8 whatever cannot be read is dropped, valid text stays as it is."""

    def readable(text: Column) -> Column:
        return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit("")))

    return F.get(F.transform(F.array(raw.cast("string")), readable), F.lit(0))  # an array of one: the bytes are decoded once


def malformed(payload: Column) -> Column:
    """A part, or the message if it has none, lacks its type, or a plain part its body."""
    bad_part = F.exists(
        payload["parts"],
        lambda p: p["mimeType"].isNull() | ((p["mimeType"] == "text/plain") & p["body"].isNull()),
    )
    return F.coalesce(bad_part, payload["mimeType"].isNull())


def body_of(payload: Column) -> Column:
    """All plain-text parts; an HTML part only while there is no text yet.

    Parts inside parts are not read, and a message without parts counts only
    if it is plain text. Null if a part that is needed cannot be decoded.
    """

    def fold(text: Column, part: Column) -> Column:
        data = F.nullif(part["body"]["data"], F.lit(""))
        wanted = (part["mimeType"] == "text/plain") | ((part["mimeType"] == "text/html") & (text == ""))
        return F.when(text.isNull(), text).when(wanted & data.isNotNull(), F.concat(text, decoded(data))).otherwise(text)

    of_parts = F.aggregate(payload["parts"], F.lit(""), fold)
    single = F.nullif(payload["body"]["data"], F.lit(""))
    of_one = F.when((payload["mimeType"] == "text/plain") & single.isNotNull(), decoded(single)).otherwise(F.lit(""))
    return F.when(payload["parts"].isNotNull(), of_parts).otherwise(of_one)


def mail_date(text: Column, otherwise: Column | None = None) -> Column:
    """An Internet mail date as a timestamp; ``otherwise`` (default: now) if it is none."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*|\s*\([^)]*\)\s*$", "")
    for names, offset in ZONES:
        bare = F.regexp_replace(bare, rf"\s+({names})$", f" {offset}")
    bare = F.when(F.rlike(bare, F.lit(r"\s[+-]\d{4}$")), bare).otherwise(F.concat(bare, F.lit(" +0000")))
    forms = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z"]
    read = F.coalesce(*[F.try_to_timestamp(bare, F.lit(form)) for form in forms])
    return F.coalesce(read, F.current_timestamp() if otherwise is None else otherwise)
