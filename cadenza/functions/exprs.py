"""Scalar functions, Column to Column: time, rates, ids, codec strings, labels.

Integers stay integers until a sink. Products that can pass 2**63 run in
decimal(38,0); its `div` wraps silently, so quotients are formed from what is
left after subtracting the remainder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_U32 = (1 << 32) - 1
MAX_LONG = (1 << 63) - 1
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def floor_div(a: Column, b: Column) -> Column:
    """a // b of non-negative wide integers, saturating at the largest bigint;
    null where b is 0, or either is null."""
    x, y = wide(a), wide(b)
    q = wide((x - x % y) / y)
    return F.when((y != 0) & x.isNotNull(), F.least(q, F.lit(MAX_LONG).cast("decimal(38,0)"))).cast("bigint")


def ceil_div(a: Column, b: Column) -> Column:
    return floor_div(wide(a) + wide(b) - 1, b)


def ticks_to_ms(ticks: Column, timescale: Column) -> Column:
    """Truncating."""
    return floor_div(wide(ticks) * 1000, timescale)


def duration_ms(start: Column, end: Column, timescale: Column) -> Column:
    """The difference of the two truncated times, not the truncated difference."""
    return ticks_to_ms(end, timescale) - ticks_to_ms(start, timescale)


def rounded_seconds(ticks: Column, timescale: Column) -> Column:
    """Half up."""
    return floor_div(wide(ticks) + floor_div(timescale, F.lit(2)), timescale)


def rounded_ms(ticks: Column, timescale: Column) -> Column:
    """Half up."""
    return floor_div(wide(ticks) * 1000 + floor_div(timescale, F.lit(2)), timescale)


def bitrate(size: Column, duration: Column, timescale: Column) -> Column:
    """Bits a second, rounded up; 0 for no duration. Of sums, this is the
    duration-weighted average rate."""
    return F.when(duration == 0, F.lit(0).cast("bigint")).otherwise(ceil_div(wide(size) * 8 * wide(timescale), duration))


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def seconds_text(ms: Column) -> Column:
    """1500 -> 1.500"""
    return F.format_string("%d.%03d", floor_div(ms, F.lit(1000)), ms % 1000)


def timestamp_text(ms: Column) -> Column:
    """HH:MM:SS.mmm; hours may take more digits."""
    return F.format_string("%02d:%02d:%02d.%03d", floor_div(ms, F.lit(3600000)), floor_div(ms, F.lit(60000)) % 60, floor_div(ms, F.lit(1000)) % 60, ms % 1000)


TIMESTAMP = r"^(?:\+?([0-9]+):)?\+?([0-9]+):\+?([0-9]+)\.([0-9]{3})$"


def timestamp_ms(text: Column) -> Column:
    """ms of `[h:]m:s.mmm`; null if it is no timestamp: more than 59 minutes or
    seconds, more than three fields, other than three decimals, or past 32 bits."""

    def total(fields: Column) -> Column:
        part = lambda k: F.coalesce(F.try_to_number(F.ltrim(F.try_element_at(fields, F.lit(-k)), F.lit("+")), F.lit("9" * 18)), F.lit(0)).cast("decimal(38,0)")
        return let(F.struct(part(4).alias("h"), part(3).alias("m"), part(2).alias("s"), part(1).alias("ms")), checked)

    def checked(v: Column) -> Column:
        ms = v["h"] * 3600000 + v["m"] * 60000 + v["s"] * 1000 + v["ms"]
        return F.when((v["m"] <= 59) & (v["s"] <= 59) & (ms <= MAX_U32), ms.cast("bigint"))

    return let(text, lambda t: F.when(t.rlike(TIMESTAMP), let(F.split(t, "[:.]"), total)))


def gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm in 47 steps, enough for 32-bit numbers."""
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("bigint")).otherwise(s["a"] % F.nullif(s["b"], F.lit(0).cast("bigint"))).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(47)), F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), step)["a"]


def frame_rate(timescale: Column, sample_duration: Column) -> Column:
    """`n/d` in lowest terms; null where either is 0 or missing."""
    g = gcd(timescale, sample_duration)
    return F.when((timescale > 0) & (sample_duration > 0), F.concat_ws("/", floor_div(timescale, g), floor_div(sample_duration, g)))


def frame_rate_value(ratio: Column) -> Column:
    """`n/d` as a number with three decimals; null unless both parts are positive."""
    n, d = (F.try_to_number(F.nullif(F.regexp_extract(ratio, r"^\+?([0-9]{1,10})/\+?([0-9]{1,10})$", k), F.lit("")), F.lit("9" * 10)).cast("double") for k in (1, 2))
    return F.when((n > 0) & (d > 0) & (n <= MAX_U32) & (d <= MAX_U32), F.round(n / F.nullif(d, F.lit(0.0)), 3))


def uuid5_url(name: Column) -> Column:
    """The version-5 UUID of name in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63)).bitwiseOR(128)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def avc_codec(profile: Column, constraints: Column, level: Column) -> Column:
    return F.format_string("avc1.%02x%02x%02x", profile, constraints, level)


def hevc_codec(entry: str, space: Column, profile: Column, compatibility: Column, tier_high: Column, level: Column, constraints: Column) -> Column:
    """constraints: array of the six constraint bytes, trailing zeros dropped.
    The compatibility bits are written in reverse order, in hex."""
    reversed_bits = F.lower(F.conv(F.reverse(F.lpad(F.bin(compatibility), 32, "0")), 2, 16))
    letter = F.element_at(F.array(F.lit(""), F.lit("A"), F.lit("B"), F.lit("C")), (space + 1).cast("int"))
    last = F.aggregate(F.sequence(F.lit(1), F.size(constraints)), F.lit(0), lambda n, i: F.when(F.element_at(constraints, i) != 0, i).otherwise(n))
    tail = F.array_join(F.transform(F.slice(constraints, F.lit(1), last), lambda b: F.format_string(".%02x", b)), "")
    return F.concat(F.lit(f"{entry}."), letter, profile.cast("string"), F.lit("."), reversed_bits, F.when(tier_high, ".H").otherwise(".L"), level.cast("string"), tail)


def av1_codec(profile: Column, level: Column, tier_high: Column, depth: Column) -> Column:
    return F.format_string("av01.%d.%02d%s.%02d", profile, level, F.when(tier_high, "H").otherwise("M"), depth)


def aac_codec(profile: Column) -> Column:
    return F.concat(F.lit("mp4a.40."), profile.cast("string"))


def sample_entry(codec: Column) -> Column:
    """What stands before the first dot."""
    return F.substring_index(codec, ".", 1)


# Roles, their labels, and the characteristics tags they bear.
ROLE_LABELS = {
    "main": "Main",
    "alternate": "Alternate",
    "commentary": "Commentary",
    "dub": "Dub",
    "description": "Audio Description",
    "enhanced-audio-intelligibility": "Enhanced Dialogue",
    "subtitle": "Subtitles",
    "caption": "Captions",
    "forced-subtitle": "Forced Subtitles",
}
ROLE_CHARACTERISTICS = {
    "description": "public.accessibility.describes-video",
    "enhanced-audio-intelligibility": "public.accessibility.enhances-speech",
    "caption": "public.accessibility.transcribes-spoken-dialog,public.accessibility.describes-music-and-sound",
}
# English names of languages, by two- and three-letter code.
LANGUAGES = {
    "ar": "Arabic", "ara": "Arabic", "da": "Danish", "dan": "Danish", "de": "German", "deu": "German", "el": "Modern Greek (1453-)", "ell": "Modern Greek (1453-)",
    "en": "English", "eng": "English", "es": "Spanish", "spa": "Spanish", "fi": "Finnish", "fin": "Finnish", "fr": "French", "fra": "French",
    "he": "Hebrew", "heb": "Hebrew", "hi": "Hindi", "hin": "Hindi", "it": "Italian", "ita": "Italian", "ja": "Japanese", "jpn": "Japanese",
    "ko": "Korean", "kor": "Korean", "nl": "Dutch", "nld": "Dutch", "no": "Norwegian", "nor": "Norwegian", "pl": "Polish", "pol": "Polish",
    "pt": "Portuguese", "por": "Portuguese", "ru": "Russian", "rus": "Russian", "sv": "Swedish", "swe": "Swedish", "tr": "Turkish", "tur": "Turkish",
    "uk": "Ukrainian", "ukr": "Ukrainian", "zh": "Chinese", "zho": "Chinese", "und": "Undetermined",
}


def choose(key: Column, table: dict[str, str], otherwise: Column | None = None) -> Column:
    """CASE over a small fixed table."""
    cases = reduce(lambda c, kv: c.when(key == kv[0], F.lit(kv[1])), list(table.items())[1:], F.when(key == next(iter(table)), F.lit(table[next(iter(table))])))
    return cases if otherwise is None else cases.otherwise(otherwise)


def language_name(tag: Column) -> Column:
    """The English name by the primary subtag, if it has 2 or 3 letters and is
    known; else the tag itself."""
    return choose(F.lower(F.substring_index(tag, "-", 1)), LANGUAGES, tag)


def rendition_name(tag: Column, role: Column, name: Column | None = None) -> Column:
    """`Language`, or `Language (Label)` where there is a role. name: that of
    the language, where it was looked up in a full table."""
    language = language_name(tag) if name is None else name
    return F.when(role.isNull(), language).otherwise(F.concat(language, F.lit(" ("), choose(role, ROLE_LABELS), F.lit(")")))


def is_forced(role: Column) -> Column:
    return F.coalesce(role == "forced-subtitle", F.lit(False))


def characteristics(role: Column) -> Column:
    return choose(role, ROLE_CHARACTERISTICS)


def dash_role(kind: Column, role: Column) -> Column:
    """The Role value, if any: a text without a role, or a caption, is a
    subtitle; described or enhanced audio is told by accessibility alone."""
    return (
        F.when((kind == "text") & (role.isNull() | (role == "caption")), "subtitle")
        .when((kind == "audio") & role.isin("description", "enhanced-audio-intelligibility"), F.lit(None))
        .otherwise(role)
    )


def dash_accessibility(kind: Column, role: Column) -> Column:
    return F.when((kind == "audio") & role.isin("description", "enhanced-audio-intelligibility"), role).when((kind == "text") & (role == "caption"), role)


def mime_type(kind: Column) -> Column:
    return choose(kind, {"video": "video/mp4", "audio": "audio/mp4", "text": "application/mp4", "thumbnail": "image/jpeg"})


def adaptation_key(kind: Column, codec: Column, timescale: Column, language: Column, role: Column, sample_rate: Column, channels: Column) -> Column:
    """What tracks of one adaptation set have in common, as text."""
    s = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    head = [kind, sample_entry(codec), s(timescale)]
    return F.when(kind == "video", F.concat_ws(":", *head)).when(kind == "audio", F.concat_ws(":", *head, s(language), s(role), s(sample_rate), s(channels))).otherwise(F.concat_ws(":", *head, s(language), s(role)))


def sprite_height(width: Column, tiles: Column, video_width: Column, video_height: Column) -> Column:
    """The scaled height, cut to a multiple of the tiles, if there are any; 0
    for a video without a width."""
    scaled = floor_div(wide(width) * wide(video_height), video_width)
    return F.when(video_width > 0, scaled - F.coalesce(scaled % F.nullif(tiles, F.lit(0)), F.lit(0))).otherwise(F.lit(0).cast("bigint"))


def sprite_bandwidth(width: Column, height: Column, duration: Column) -> Column:
    """At least 1; null for sprites of no duration."""
    rate = ceil_div(wide(width) * wide(height) * 1000, duration)
    return F.when(rate.isNotNull(), F.greatest(F.lit(1).cast("bigint"), rate))


def normalised_path(path: Column) -> Column:
    """A path without empty, `.` and `..` parts; a leading `..` falls away."""
    step = lambda out, p: F.when(p.isin("", "."), out).when(p == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, p))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
