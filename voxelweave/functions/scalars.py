"""Column functions on headers, texts, dates and geometry. All run inside the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Contrast vocabulary of the headers.
TRUE_WORDS = ["1", "true", "t", "yes", "y", "with contrast", "contrast", "enhanced", "postcontrast", "arterial", "venous", "delayed"]
FALSE_WORDS = ["0", "false", "f", "no", "n", "native", "noncontrast", "non-contrast", "unenhanced", "without contrast", "w/o contrast"]
PHASE_WITHOUT = ["native", "noncontrast", "unenhanced", "without contrast"]
PHASE_WITH = ["arterial", "venous", "delayed", "portal", "contrast", "enhanced", "post"]


def any_of(text: Column, tokens: list[str]) -> Column:
    """Whether the text holds one of the tokens."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(t)), True) for t in tokens], F.lit(False))


def first_present(*cols: Column) -> Column:
    """The first value that is neither null, empty nor "Unknown"."""
    return F.coalesce(*[F.when(~c.isin("", "Unknown"), c) for c in cols])


def parse_tristate(text: Column) -> Column:
    """True, false or null from text; a phrase counts anywhere in it, a word only alone."""
    t = F.lower(F.trim(text))
    yes = t.isin(TRUE_WORDS) | any_of(t, [w for w in TRUE_WORDS if " " in w])
    no = t.isin(FALSE_WORDS) | any_of(t, [w for w in FALSE_WORDS if " " in w])
    return F.when(t == "", None).when(yes, True).when(no, False)


def phase_contrast(phase: Column) -> Column:
    """Whether a phase name implies contrast; names of plain scans are looked for first."""
    t = F.lower(F.trim(phase))
    return F.when(any_of(t, PHASE_WITHOUT), False).when(any_of(t, PHASE_WITH), True)


def phase_normalize(phase: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(phase)), F.lit("")), F.lit("unknown"))


def is_contrast(phase: Column) -> Column:
    return any_of(phase_normalize(phase), ["arterial", "venous", "portal", "delayed", "contrast", "enhanced", "post"])


@F.pandas_udf(StringType())
def _folded(text: pd.Series) -> pd.Series:
    strip = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return text.map(lambda t: t if t.isascii() else strip(t))


def text_fold(text: Column) -> Column:
    """Lower case, in compatibility decomposition, without combining marks; null is empty. Spark has no such normal form, so Arrow batches have it done."""
    return _folded(F.lower(F.coalesce(text, F.lit(""))))


def number(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def first_number(text: Column) -> Column:
    """The first signed number in a text; a comma may be its decimal mark."""
    found = F.nullif(F.regexp_extract(text, r"[-+]?\d+(?:[.,]\d+)?", 0), F.lit(""))
    return F.replace(found, F.lit(","), F.lit(".")).try_cast("double")


def parse_sequence(text: Column, length: int) -> Column:
    """Numbers separated by backslash or comma; null unless all are numbers and their count is right."""
    parts = F.transform(F.split(text, r"[\\,]"), lambda x: F.trim(x).try_cast("double"))
    return F.when((F.size(parts) == length) & F.forall(parts, lambda x: x.isNotNull()), parts)


def name_display(name: Column, family_last: bool = False) -> Column:
    """Carets to blanks, blanks collapsed; with `family_last` the part before the first caret goes to the end."""
    parts = F.filter(F.split(name, r"\^"), lambda p: F.trim(p) != "")
    if family_last:
        size = F.size(parts)
        parts = F.when(size > 1, F.concat(F.slice(parts, 2, F.greatest(size - 1, F.lit(1))), F.slice(parts, 1, 1))).otherwise(parts)
    return F.trim(F.regexp_replace(F.concat_ws(" ", parts), r"\s+", " "))


def case_name(name: Column, accession: Column) -> Column:
    """<accession's letters and digits, or 000000>_<First><initials of later parts longer than 3>."""
    parts = F.filter(F.split(name_display(name), " "), lambda p: p != "")
    initials = F.transform(F.filter(F.slice(parts, 2, 64), lambda p: F.length(p) > 3), lambda p: F.upper(F.substring(p, 1, 1)))
    plain = F.regexp_replace(F.coalesce(accession, F.lit("")), "[^A-Za-z0-9]", "")
    return F.concat(F.coalesce(F.nullif(plain, F.lit("")), F.lit("000000")), F.lit("_"), F.initcap(F.coalesce(F.get(parts, F.lit(0)), F.lit(""))), F.concat_ws("", initials))


def storage_stem(*parts: Column, most: int = 24) -> Column:
    """Identifiers cleaned to letters, digits, dot, dash and underscore, cut, and joined by an underscore."""
    clean = [F.substring(F.regexp_replace(F.coalesce(p, F.lit("")), "[^A-Za-z0-9._-]+", "_"), 1, most) for p in parts]
    return F.concat_ws("_", *[F.nullif(c, F.lit("")) for c in clean])


def parse_timestamp(text: Column) -> Column:
    """ISO, `Y-m-d H:M:S` or `Ymd`; naive values are in the session's zone."""
    t = F.trim(text)
    return F.coalesce(t.try_cast("timestamp"), F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss")), F.when(t.rlike(r"^\d{8}$"), F.try_to_timestamp(t, F.lit("yyyyMMdd"))))


def parse_header_time(text: Column) -> Column:
    """`YmdHMS`, `YmdHM` or `HMS` by prefix after all but digits is dropped; fractions of a second don't count."""
    main = F.substring_index(F.regexp_replace(text, "[^0-9.]", ""), ".", 1)
    part = lambda n, fmt: F.when(F.length(main) >= n, F.try_to_timestamp(F.substring(main, 1, n), F.lit(fmt)))
    return F.coalesce(part(14, "yyyyMMddHHmmss"), part(12, "yyyyMMddHHmm"), F.when(F.length(main) >= 6, F.try_to_timestamp(F.concat(F.lit("19000101"), F.substring(main, 1, 6)), F.lit("yyyyMMddHHmmss"))))


def duration_seconds(text: Column) -> Column:
    """`H:M:S[.f]` to seconds; null if it has another form."""
    p = F.split(F.trim(text), ":")
    n = [F.get(p, F.lit(i)).try_cast("double") for i in range(3)]
    return F.when(F.size(p) == 3, n[0] * 3600 + n[1] * 60 + n[2])


def header_date(text: Column) -> Column:
    return F.when(F.trim(text).rlike(r"^\d{8}$"), F.to_date(F.try_to_timestamp(F.trim(text), F.lit("yyyyMMdd"))))


def age_at_study(birth: Column, study: Column) -> Column:
    """Completed years between two `YYYYMMDD` texts; null if one is bad or the order is wrong."""
    b, s = header_date(birth), header_date(study)
    before = (F.month(s) * 100 + F.dayofmonth(s)) < (F.month(b) * 100 + F.dayofmonth(b))
    return F.when(b <= s, F.year(s) - F.year(b) - before.cast("int"))


def dot(a: Column, b: Column, n: int = 3) -> Column:
    out = F.get(a, F.lit(0)) * F.get(b, F.lit(0))
    for i in range(1, n):
        out = out + F.get(a, F.lit(i)) * F.get(b, F.lit(i))
    return out


def slice_normal(orientation: Column) -> Column:
    """Unit normal of six direction cosines: row cross column; null where it has no length."""
    o = [F.get(orientation, F.lit(i)) for i in range(6)]
    n = F.array(o[1] * o[5] - o[2] * o[4], o[2] * o[3] - o[0] * o[5], o[0] * o[4] - o[1] * o[3])
    length = F.sqrt(dot(n, n))
    return F.when(length > 0, F.transform(n, lambda x: x / length))


def angle_between(a: Column, b: Column) -> Column:
    """Angle in degrees between two unit vectors, either way round."""
    c = F.abs(dot(a, b))
    return F.when(c.isNotNull(), F.degrees(F.acos(F.least(F.lit(1.0), c))))


def affine_world(affine: Column, x: Column, y: Column, z: Column) -> Column:
    """World coordinates of a voxel index by a row-major 4 x 4 affine of 16 numbers."""
    a = lambda i: F.get(affine, F.lit(i))
    return F.array(*[a(4 * r) * x + a(4 * r + 1) * y + a(4 * r + 2) * z + a(4 * r + 3) for r in range(3)])


def axis_code(affine: Column, row: int) -> Column:
    """The array axis (0 to 2) that runs most along a world axis, and whether it runs up it: struct(axis, positive)."""
    v = [F.get(affine, F.lit(4 * row + c)) for c in range(3)]
    top = F.greatest(*[F.abs(x) for x in v])
    axis = F.when(F.abs(v[0]) == top, 0).when(F.abs(v[1]) == top, 1).otherwise(2)
    return F.struct(axis.alias("axis"), (F.when(axis == 0, v[0]).when(axis == 1, v[1]).otherwise(v[2]) >= 0).alias("positive"))


def canonical_signature(*cols: Column) -> Column:
    """sha256 of the compact JSON of the values in a fixed order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def acquisition_id(members: Column) -> Column:
    """`acq_` and the first 16 hex digits of the signature of the sorted member list."""
    return F.concat(F.lit("acq_"), F.substring(F.sha2(F.to_json(F.array_sort(members)), 256), 1, 16))


def json_true(text: Column, path: str) -> Column:
    """Whether the value at a dotted path is there and true: not false, 0, empty or null."""
    v = F.get_json_object(text, f"$.{path}")
    return F.coalesce(~v.isin("false", "0", "0.0", "", "null", "[]", "{}"), F.lit(False))


def bmi(kg: Column, metres: Column) -> Column:
    ok = metres.between(0.8, 2.5) & kg.between(20, 400)
    return F.when(ok, kg / (metres * metres))


def smi(area_cm2: Column, metres: Column) -> Column:
    return F.when(metres.between(0.8, 2.5), area_cm2 / (metres * metres))


def kvp_backfill(tags: Column, legacy: Column) -> Column:
    return F.coalesce(F.nullif(tags, F.lit("Unknown")), F.nullif(legacy, F.lit("Unknown")), F.lit("Unknown"))


def text_gate(text: Column, least: int) -> Column:
    """struct(text, flagged): white space collapsed per line, empty lines dropped; flagged from `least` ASCII letters and digits on."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")
    clean = F.array_join(lines, "\n")
    return F.struct(clean.alias("text"), (F.length(F.regexp_replace(clean, "[^A-Za-z0-9]", "")) >= least).alias("flagged"))


def body_surface(cm: Column, kg: Column) -> Column:
    return F.round(F.sqrt(cm * kg / 3600), 2)


def pdff_band(percent: Column) -> Column:
    return F.when(percent < 5, "normal").when(percent < 15, "mild").when(percent < 30, "moderate").when(percent >= 30, "severe")


def format_date(text: Column) -> Column:
    """`YYYYMMDD` to `DD/MM/YYYY`; anything else as it is."""
    return F.when(F.length(text) == 8, F.concat_ws("/", F.substring(text, 7, 2), F.substring(text, 5, 2), F.substring(text, 1, 4))).otherwise(text)


def format_number(value: Column, digits: int, locale: str = "en_US") -> Column:
    """Grouped digits; pt_BR swaps the marks."""
    text = F.format_number(value, digits)
    return F.translate(text, ",.", ".,") if locale == "pt_BR" else text


def case_id_parse(row_json: Column, name: Column, date: Column, accession: Column) -> Column:
    """The case id told in the row's JSON, else name, date and accession joined by underscores."""
    told = F.nullif(F.get_json_object(row_json, "$.case_id"), F.lit(""))
    return F.coalesce(told, F.concat_ws("_", name, date, accession))


def reconstruction_preference(text: Column) -> Column:
    """One up for each soft-tissue word in the text, one down for each sharp or projected one."""
    t = F.lower(F.coalesce(text, F.lit("")))
    score = F.lit(0)
    for w in ("soft", "standard", "body", "mediast"):
        score = score + F.contains(t, F.lit(w)).cast("int")
    for w in ("lung", "pulmao", "bone", "mip", "sharp"):
        score = score - F.contains(t, F.lit(w)).cast("int")
    return score


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def effective_thickness(z_spacing: Column, between: Column, thickness: Column) -> Column:
    """The first of three spacings that is positive."""
    return F.coalesce(positive(z_spacing), positive(between), positive(thickness))


def requested_modules(text: Column) -> Column:
    """Comma-separated names, trimmed and distinct, in their order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))


def event_payload(case_id: Column, study: Column, occurred: Column, received: Column) -> Column:
    """struct(event_key, occurred_at, payload) of a notification."""
    key = F.concat(F.lit("patient_identified:"), F.coalesce(study, case_id))
    at = F.coalesce(occurred, received)
    return F.struct(key.alias("event_key"), at.alias("occurred_at"), F.to_json(F.struct(case_id.alias("case_id"), study.alias("study"))).alias("payload"))


def _replaced(name: str, value: str):
    return lambda k, v: F.when(k == name, F.lit(value)).otherwise(v)


def deidentify(tags: Column, drop: list[str], pseudonyms: dict[str, str], remap: list[str], salt: str) -> Column:
    """A tag map without direct identifiers: listed tags dropped, some replaced, identifiers remapped the same way everywhere."""
    kept = F.map_filter(tags, lambda k, v: ~k.isin(drop))
    for name, value in pseudonyms.items():
        kept = F.transform_values(kept, _replaced(name, value))
    new = lambda v: F.concat(F.lit("2.25."), F.conv(F.substring(F.sha2(F.concat(F.lit(salt), v), 256), 1, 15), 16, 10))
    return F.transform_values(kept, lambda k, v: F.when(k.isin(remap) & (v != ""), new(v)).otherwise(v))


def profile_merge(base: Column, override: Column) -> Column:
    """The policy value that a case submits, else the profile's."""
    return F.coalesce(override, base)


def epoch_s(at: Column) -> Column:
    """Seconds since 1970 of a timestamp with or without zone."""
    return at.cast("timestamp").cast("double")
