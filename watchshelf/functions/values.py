"""Display names, codes, masks and small conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of the catalog.
EPISODE_TYPES = {0: "main", 1: "SP", 2: "OP", 3: "ED", 4: "trailer"}
COLLECTION_TYPES = {1: "wish", 2: "watched", 3: "watching", 4: "on hold", 5: "dropped"}
# The relation seen from the other side, in the feed's English and Chinese names; others are their own.
INVERSE_RELATIONS = {
    "prequel": "sequel",
    "sequel": "prequel",
    "side_story": "parent_story",
    "parent_story": "side_story",
    "spin_off": "parent_story",
    "前传": "续集",
    "续集": "前传",
    "衍生": "主线故事",
    "主线故事": "衍生",
}
#: Fields of logged parameters whose values are masked.
SECRET_FIELDS = ("password", "oldPassword", "newPassword", "code")
#: Classes of errors by the kind of exception.
ERROR_KINDS = {"CancelledError": "CLIENT_DISCONNECTED", "TimeoutError": "MODEL_TIMEOUT", "ValueError": "MODEL_RESPONSE_INVALID", "TypeError": "MODEL_RESPONSE_INVALID"}
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp")


def display_name(localized: Column, original: Column) -> Column:
    """The localized name unless it is empty."""
    return F.coalesce(F.nullif(localized, F.lit("")), original)


def label(code: Column, labels: dict[int, str]) -> Column:
    """The label of a code, null for others."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), code)


def inverse_relation(relation: Column) -> Column:
    """The relation as seen from the related side."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in INVERSE_RELATIONS.items() for x in pair]), relation), relation)


def positive_max(a: Column, b: Column) -> Column:
    """The larger of two numbers, missing ones as 0; null if that is 0."""
    return F.nullif(F.greatest(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))), F.lit(0))


def masked_json(text: Column, fields: tuple[str, ...] = SECRET_FIELDS) -> Column:
    """JSON text with the string values of secret fields replaced by ***. A string is a quote, then escapes or other characters, then a quote."""
    names, string = "|".join(fields), r'"(?:[^"\\]|\\.)*"'
    return F.regexp_replace(text, rf'("(?:{names})"\s*:\s*){string}', '$1"***"')


def encoded(message: Column) -> Column:
    """A message as JSON text; null fields stay in it."""
    return F.to_json(message, {"ignoreNullFields": "false"})


#: A stored message; its session is part of the key that it is stored under.
MESSAGE = "role string, content string, tool_calls string, created_at string"


def decoded(text: Column, schema: str = MESSAGE) -> Column:
    """The message that JSON text holds; null for what is no JSON object."""
    found = F.from_json(text, schema)
    return F.when(F.trim(text).startswith("{") & F.coalesce(*[found[f.split()[0]].isNotNull() for f in schema.split(", ")[:1]]), found)


def salted_hash(value: Column, salt: str) -> Column:
    """The first 16 hex digits of a salted SHA-256; null for null and empty values."""
    return F.substring(F.sha2(F.concat(F.lit(salt + ":"), F.nullif(value, F.lit(""))), 256), 1, 16)


def is_safe_id(value: Column) -> Column:
    return F.coalesce(F.trim(value).rlike(r"^[A-Za-z0-9._-]{1,128}$"), F.lit(False))


def url_extension(url: Column) -> Column:
    """The image extension of a URL's path in lower case, null for any other."""
    found = F.regexp_extract(F.lower(F.try_parse_url(url, F.lit("PATH"))), r"\.(" + "|".join(IMAGE_EXTENSIONS) + ")$", 1)
    return F.nullif(found, F.lit(""))


def duration(seconds: Column) -> Column:
    """Whole seconds as 1h02m03s, or 2m03s below an hour."""
    s = F.floor(seconds).cast("long")
    hours, minutes = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(s >= 3600, F.format_string("%dh%02dm%02ds", hours, minutes, s % 60)).otherwise(F.format_string("%dm%02ds", minutes, s % 60))


def error_kind(name: Column, kinds: dict[str, str] = ERROR_KINDS, other: str = "INTERNAL_ERROR") -> Column:
    """The class of an error by the name of its exception; null if there was none."""
    out = F.when(name.isNull(), None)
    for own, kind in kinds.items():
        out = out.when(name == own, kind)
    return out.otherwise(other)


def kept_fields(event: Column, allowed: list[str]) -> Column:
    """A map with the allowed keys whose values aren't null."""
    return F.map_filter(event, lambda k, v: k.isin(allowed) & v.isNotNull())


def elapsed_ms(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", start, end)


def merged_unique(a: Column, b: Column) -> Column:
    """Two lists one after the other, each value once, in the order first seen."""
    return F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))
