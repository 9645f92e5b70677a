"""Column functions of the catalog: places, names, dates, measures. All stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File suffixes of formats, label names, colour names, the Earth's diameter, bands of a hash, suffixes of edits.
VIDEO_TYPES = ["mp4", "mov", "avi", "mkv", "webm", "m4v", "3gp"]
LABELS = {"red": "red", "yellow": "yellow", "green": "green", "blue": "blue", "purple": "purple", "אדום": "red", "צהוב": "yellow", "ירוק": "green", "כחול": "blue", "סגול": "purple"}
COLOURS = ["red", "orange", "yellow", "green", "cyan", "blue", "purple", "pink", "brown", "black", "white", "gray"]
EARTH_KM = 12742.0
BANDS = (0, 9, 18, 27, 36, 45, 54, 64)


def wall(seconds: Column, tz: str = "UTC") -> Column:
    """Wall-clock timestamp of unix seconds, whatever the session's time zone is."""
    utc = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return utc if tz == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def in_box(lat: Column, lng: Column, south: float, west: float, north: float, east: float) -> Column:
    """A box may cross the 180th meridian: then west is greater than east."""
    across = lng.between(west, east) if west <= east else (lng >= west) | (lng <= east)
    return lat.between(south, north) & across


def parse_coords(text: Column) -> Column:
    """struct(lat, lng) of '32.08°N 34.78°E' or '32.08, -34.78'; null when out of range or not coordinates."""
    pattern = r"^\s*(-?\d+(?:\.\d+)?)\s*°?\s*([NSns]?)[\s,;]+(-?\d+(?:\.\d+)?)\s*°?\s*([EWew]?)\s*$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    lat = part(1).try_cast("double")
    lat = F.when(F.lower(part(2)) == "s", -lat).otherwise(lat)
    lng = part(3).try_cast("double")
    lng = F.when(F.lower(part(4)) == "w", -lng).otherwise(lng)
    return F.when((F.abs(lat) <= 90) & (F.abs(lng) <= 180), F.struct(lat.alias("lat"), lng.alias("lng")))


def place_kind(south: Column, west: Column, north: Column, east: Column, least_km: float = 4.0) -> Column:
    """'box' for a place whose diagonal is long enough, else 'circle'."""
    return F.when(haversine_km(south, west, north, east) > least_km, "box").otherwise("circle")


def date_from_filename(name: Column, this_year: int) -> Column:
    """Unix seconds of a date, and of a time behind it, in a file name without its extension.

    Neither a digit before nor three digits behind may make it part of a longer number; null unless it is a real date of
    1990 to next year.
    """
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")
    pattern = r"(?<!\d)(19[89]\d|20\d\d)[-_.]?(0[1-9]|1[0-2])[-_.]?(0[1-9]|[12]\d|3[01])(?:[-_. T]?([01]\d|2[0-3])[-_.:]?([0-5]\d)[-_.:]?([0-5]\d))?(?!\d{3})"
    part = lambda i: F.regexp_extract(stem, pattern, i)
    time = F.when(part(4) != "", F.concat_ws(":", part(4), part(5), part(6))).otherwise(F.lit("00:00:00"))
    at = F.try_to_timestamp(F.concat(F.concat_ws("-", part(1), part(2), part(3)), F.lit(" "), time, F.lit(" UTC")), F.lit("yyyy-MM-dd HH:mm:ss z"))
    return F.when((part(1) >= "1990") & (part(1) <= str(this_year + 1)), F.unix_seconds(at))


def lr_time(text: Column) -> Column:
    """Unix seconds of a catalog's capture time: a day, and behind a T hours, minutes and perhaps seconds; what follows is ignored."""
    part = lambda i: F.regexp_extract(text, r"^(\d{4})-(\d{2})-(\d{2})(?:T(\d{2}):(\d{2})(?::(\d{2}))?)?", i)
    or_zero = lambda c: F.when(c == "", "00").otherwise(c)
    at = F.concat(F.concat_ws("-", part(1), part(2), part(3)), F.lit(" "), F.concat_ws(":", or_zero(part(4)), or_zero(part(5)), or_zero(part(6))), F.lit(" UTC"))
    return F.unix_seconds(F.try_to_timestamp(at, F.lit("yyyy-MM-dd HH:mm:ss z")))


#: What export tools add to the name of an edited copy.
EDIT_SUFFIXES = "edited|effects|collage|animation|mix|motion"


def media_stem(name: Column) -> Column:
    """A media name without its extension, counter and edit suffix, in lower case: what the same shot is called whatever was
    added to it. The extension is what follows the last dot if something stands on both of its sides."""
    bare = F.regexp_replace(name, r"^(?s)(.+)\.[^.]+\z", "$1")
    bare = F.regexp_replace(F.lower(bare), r"^\s+|\s+\z", "")
    bare = F.regexp_replace(bare, r"\s*\(\d+\)\z", "")
    bare = F.regexp_replace(bare, rf"[\s_-]*({EDIT_SUFFIXES})\z", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\s*\(\d+\)\z", ""), r"^\s+|\s+\z", "")


def sidecar_target(name: Column) -> Column:
    """The media name that an export's sidecar file is about; the word before .json may be cut short or numbered."""
    supplement = r"(?i)\.supplemental[\w-]*\.json\z"
    return F.when(name.rlike(supplement), F.regexp_replace(name, supplement, "")).otherwise(F.regexp_replace(name, r"(?i)\.json\z", ""))


def norm_counter(name: Column) -> Column:
    """A name without counters and white space, in lower case: 'IMG(1).jpg' and 'IMG.jpg(1)' agree."""
    return F.lower(F.regexp_replace(name, r"\(\d+\)|\s+", ""))


def folder_of(path: Column) -> Column:
    return F.when(path.rlike(r"[/\\]"), F.regexp_replace(path, r"[/\\][^/\\]*$", "")).otherwise(F.lit(""))


def ext_of(path: Column) -> Column:
    return F.upper(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def safe_component(name: Column) -> Column:
    clean = F.regexp_replace(F.trim(name), r'[<>:"/\\|?*\x00-\x1f]', "_")
    return F.when(clean == "", F.lit("_")).otherwise(clean)


def natural_key(name: Column) -> Column:
    """Sort key in which numbers of any length compare by value: IMG_2 before IMG_10. A number is its length, then its digits,
    behind a sign that sorts before all others."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))

    def number(part: Column) -> Column:
        digits = F.regexp_replace(part, r"^0+(?=\d)", "")
        return F.concat(F.lit("\x01"), F.lpad(F.length(digits).cast("string"), 5, "0"), F.lit(":"), digits)

    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), number(p)).otherwise(p)), "")


def orientation(width: Column, height: Column, tolerance: float = 0.05) -> Column:
    ratio = width / height
    return (
        F.when((F.coalesce(width, F.lit(0)) <= 0) | (F.coalesce(height, F.lit(0)) <= 0), "unknown")
        .when(ratio > 1 + tolerance, "landscape")
        .when(ratio < 1 - tolerance, "portrait")
        .otherwise("square")
    )


def megapixels(width: Column, height: Column) -> Column:
    return width * height / 1_000_000


def is_panorama(width: Column, height: Column, is_video: Column) -> Column:
    return (is_video == 0) & (width > 0) & (height > 0) & ((width >= 2 * height) | (height >= 2 * width))


def album_kind(name: Column) -> Column:
    """'year' for an export's album of a year, 'people-share' for names that list people with commas, else 'album'."""
    return F.when(name.rlike(r"(?:תמונות משנת|Photos from)\s*\d{4}"), "year").when(name.rlike(r"^[A-Za-z].*,"), "people-share").otherwise("album")


def fix_mojibake(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again; anything else as it is."""
    fits = ~text.rlike(r"[^\x{0000}-\x{00FF}]")
    raw = F.encode(F.when(fits, text), "ISO-8859-1")
    return F.when(fits & F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(text)


def is_english(text: Column) -> Column:
    return ~text.rlike(r"[\p{L}&&[^\x{0000}-\x{024F}]]")


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_band(h: Column, band: int) -> Column:
    """One of seven bands of a 64-bit hash; two hashes that differ in six bits or fewer agree in one band wholly."""
    low, high = BANDS[band], BANDS[band + 1]
    return F.shiftrightunsigned(h, low).bitwiseAND(F.lit((1 << (high - low)) - 1))


def signed_round(x: Column, digits: int) -> Column:
    """x rounded, halves away from zero; what rounds to zero keeps its sign, as it does in C and in SQL engines built on it."""
    return F.round(F.abs(x), digits) * F.signum(x)


def quality_score(sharp: Column, mean: Column, p5: Column, p95: Column, clip_dark: Column, clip_white: Column, eyes_closed: Column, width: Column, height: Column) -> Column:
    """1 to 100: sharpness, exposure (too dark, too bright, clipped) and contrast; small pictures and closed eyes count less.
    Halves go to even."""
    held = lambda c, top: F.least(F.lit(top), F.greatest(F.lit(0.0), c))
    off = F.when(mean < 70, (70 - mean) * 1.6).when(mean > 190, (mean - 190) * 1.6).otherwise(0.0)
    over = lambda clip: 120 * F.greatest(F.lit(0.0), clip - 0.15)
    # Halves are common here, so the order of the steps, which decides their last digit, is that of the SQL twins.
    exposure = held(100.0 - off - over(clip_dark) - over(clip_white), 100.0)
    total = 60.0 * held(F.ln(1 + sharp) / F.ln(F.lit(401.0)), 1.0) + 0.25 * exposure + 15.0 * held((p95 - p5) / 150, 1.0)
    total = total * F.when((width > 0) & (height > 0) & (width.cast("long") * height < 400_000), 0.9).otherwise(1.0)
    total = total * F.when(F.coalesce(eyes_closed, F.lit(0)) != 0, 0.6).otherwise(1.0)
    return F.least(F.lit(100), F.greatest(F.lit(1), F.bround(total).cast("int")))


def cleanup_category(screenshot: Column, receipt: Column, mean: Column, p95: Column, sharp: Column, phash: Column) -> Column:
    return (
        F.when(screenshot == 1, "screenshot")
        .when(receipt == 1, "receipt")
        .when((mean < 38) & (p95 < 85), "dark")
        .when((sharp < 12) & phash.isNotNull(), "blurry")
    )


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and value."""
    r, g, b = r / 255.0, g / 255.0, b / 255.0
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    turn = F.when(top == r, F.pmod((g - b) / d, F.lit(6.0))).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    return F.when(d == 0, F.lit(0.0)).otherwise(60 * turn), F.when(top == 0, F.lit(0.0)).otherwise(d / top), top


def colour_bucket(r: Column, g: Column, b: Column) -> Column:
    """One of COLOURS."""
    h, s, v = hsv(r, g, b)
    dark = lambda name, least: F.when(v > least, name).otherwise("brown")
    return (
        F.when(v < 0.18, "black").when(s < 0.14, F.when(v > 0.85, "white").otherwise("gray"))
        .when((h < 15) | (h >= 345), dark("red", 0.45)).when(h < 40, dark("orange", 0.6)).when(h < 70, dark("yellow", 0.55))
        .when(h < 165, "green").when(h < 200, "cyan").when(h < 255, "blue").when(h < 300, "purple").otherwise("pink")
    )


def redact_text(text: Column, folders: list[str] | None = None, user: str = "") -> Column:
    """Given folders (of more than three signs, with either slash), a user's name between other signs than letters and digits,
    e-mail addresses and IPv4 addresses but for 127.* and 0.0.0.* are masked."""
    out = text
    for value in sorted({f for f in folders or [] if len(f) > 3}, key=len, reverse=True):
        for form in dict.fromkeys((value, value.replace("\\", "/"), value.replace("/", "\\"))):
            out = F.replace(out, F.lit(form), F.lit("<folder>"))
    if len(user) > 2:
        out = F.regexp_replace(out, r"(?i)(?<![A-Za-z0-9])\Q" + user + r"\E(?![A-Za-z0-9])", "<user>")
    out = F.regexp_replace(out, r"(?U)[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "<email>")
    # Addresses that stay are fenced while the others are masked.
    out = F.regexp_replace(out, r"\b(127(?:\.\d{1,3}){3}|0\.0\.0\.\d{1,3})\b", "\u0001$1\u0001")
    out = F.regexp_replace(out, r"(?<!\x01)\b\d{1,3}(?:\.\d{1,3}){3}\b", "<ip>")
    return F.replace(out, F.lit("\u0001"), F.lit(""))


def parse_keywords(answer: Column, most: int = 12) -> Column:
    """Up to most different keywords of 2 to 40 signs, lower-cased, in order: of a JSON list, or of the list under 'keywords'
    (else 'tags') of a JSON object; anything else is cut at commas, semicolons and line ends."""
    strict = {"allowSingleQuotes": "false"}
    found = F.regexp_extract(answer, r"(?s)(\{.*\}|\[.*\])", 1)
    held = F.from_json(F.when(found.startswith("{"), found), "struct<keywords:string,tags:string>", strict)
    inner = F.when(found.startswith("["), found).otherwise(F.coalesce(held["keywords"], held["tags"]))
    listed = F.from_json(F.when(inner.startswith("["), inner), "array<string>", strict)
    plain = F.split(F.regexp_replace(answer, r"(?i)keywords\s*:|[`\[\]{}\"]", " "), r"[\n,;]+")
    clean = lambda x: F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"^[ .#\-*•\t\"']+|[ .#\-*•\t\"']+$", "")))
    words = F.filter(F.transform(F.coalesce(listed, plain), clean), lambda x: F.length(x).between(2, 40))
    return F.slice(F.array_distinct(words), 1, most)


def parse_score(answer: Column) -> Column:
    """1 to 100: the number behind 'score', else the first one by itself; null beyond."""
    behind = F.regexp_extract(answer, r'"?score"?\s*[:=]\s*(\d{1,3})', 1)
    value = F.when(behind != "", behind).otherwise(F.regexp_extract(answer, r"\b(\d{1,3})\b", 1)).try_cast("int")
    return F.when(value.between(1, 100), value)


def label_map(name: Column) -> Column:
    """One of five labels from its English or Hebrew name, or null."""
    pairs = [x for kv in LABELS.items() for x in map(F.lit, kv)]
    return F.element_at(F.create_map(*pairs), F.lower(F.trim(name)))
