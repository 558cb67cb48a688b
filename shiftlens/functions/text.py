"""Cleaning and reading of text fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clean_value(text: Column) -> Column:
    """Trim, drop one pair of surrounding quotes, turn control characters and runs of
    blanks into one blank."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\s\x00]+|[\s\x00]+$", ""))
    unquoted = F.regexp_replace(trimmed, r"""^(["'])(.*)\1$""", "$2")
    return F.trim(F.regexp_replace(unquoted, r"[\s\x0B]+", " "))


def first_filled(*texts: Column, default: Column | None = None) -> Column:
    """First value that is not blank after cleaning; else the default.  Every text is named
    once, which keeps the plans of wide feeds small."""
    filled = F.array_remove(F.array(*[clean_value(t) for t in texts]), "")
    value = F.try_element_at(filled, F.lit(1))
    return value if default is None else F.coalesce(value, default)


def zero_as_missing(text: Column) -> Column:
    """For the fields where a bare 0 means 'none' (ticket, priority)."""
    return F.nullif(F.nullif(F.trim(text), F.lit("")), F.lit("0"))


def parse_decimal(text: Column) -> Column:
    """Comma or point decimal; the longest leading number counts, blank is 0."""
    number = F.regexp_extract(
        F.replace(F.coalesce(text, F.lit("")), F.lit(","), F.lit(".")),
        r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)",
        1,
    )
    return F.coalesce(number.try_cast("double"), F.lit(0.0))


def _leading_int(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def parse_clock_minutes(text: Column) -> Column:
    """``H:MM`` -> minutes; anything without a colon is 0."""
    parts = F.split(F.coalesce(text, F.lit("")), ":")
    return F.when(
        F.size(parts) >= 2,
        _leading_int(F.element_at(parts, 1)) * 60 + _leading_int(F.element_at(parts, 2)),
    ).otherwise(F.lit(0))


def parse_duration_minutes(text: Column) -> Column:
    """``12m``, ``12``, ``1:05`` and ``1h 5m`` -> minutes."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    hours = F.regexp_extract(t, r"(\d+)\s*h", 1).try_cast("int")
    minutes = F.regexp_extract(t, r"(\d+)\s*m", 1).try_cast("int")
    return (
        F.when(t.contains("h"), F.coalesce(hours, F.lit(0)) * 60 + F.coalesce(minutes, F.lit(0)))
        .when(t.contains("m"), _leading_int(t))
        .when(t.contains(":"), parse_clock_minutes(t))
        .otherwise(_leading_int(t))
    )


# The characters Windows-1252 puts where ISO-8859-1 has the control
# characters 0x80-0x9F (0x81, 0x8D, 0x8F, 0x90 and 0x9D are not assigned).
_C1_CODES = [
    0x80, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x8B, 0x8C, 0x8E,
    0x91, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0x9B, 0x9C, 0x9E, 0x9F,
]
_CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def repair_encoding(latin1: Column) -> Column:
    """Text that was read byte for byte as ISO-8859-1: valid UTF-8 bytes are decoded as
    UTF-8, all others as Windows-1252."""
    raw = F.encode(latin1, "ISO-8859-1")
    as_utf8 = F.try_validate_utf8(raw.cast("string"))
    as_cp1252 = F.translate(latin1, "".join(chr(c) for c in _C1_CODES), _CP1252)
    return F.coalesce(as_utf8, as_cp1252)


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def match_key(text: Column) -> Column:
    """Join key for names: letter case, accents and trailing blanks do not matter."""
    folded = F.translate(F.lower(text), _ACCENTED, _PLAIN)
    return F.trim(folded)


_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def map_category(text: Column, mapping: dict[str, str], default: str) -> Column:
    """Look a label up in a fixed map, default when unknown."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.trim(text)), F.lit(default))


# Category labels of the feeds.
ABSENCE_TYPES = {
    "Ferie": "ferie",
    "Permessi": "permessi",
    "ROL": "rol",
    "Permessi ex festività": "ex_festivita",
    "Malattia": "malattia",
}
ABSENCE_STATES = {
    "Approvata": "approved",
    "Rifiutata": "rejected",
    "Annullamento approvato": "cancelled",
    "In attesa": "pending",
}
PROJECT_STATES = {
    "Attivo": "active",
    "Sospeso": "suspended",
    "Completato": "completed",
    "Cancellato": "cancelled",
}
PRIORITIES = {"Alta": "high", "Media": "medium", "Bassa": "low", "Critica": "critical"}


def absence_type(text: Column) -> Column:
    return map_category(text, ABSENCE_TYPES, "permessi")


def absence_state(text: Column) -> Column:
    return map_category(text, ABSENCE_STATES, "pending")


def project_state(text: Column) -> Column:
    return map_category(text, PROJECT_STATES, "active")


def priority(text: Column) -> Column:
    return map_category(text, PRIORITIES, "medium")


# Severities from lowest to highest; they sort by this order.
SEVERITIES = ["low", "medium", "high", "critical"]


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


# Legal forms and suffixes left out of a short company name, in order.
def short_company_name(name: Column) -> Column:
    def drop(*parts: str) -> Column:
        out = name
        for part in parts:
            out = F.replace(out, F.lit(part), F.lit(""))
        return out

    low = F.lower(name)
    return (
        F.when(low.contains("s.r.l."), drop(" S.r.l.", " S.R.L."))
        .when(low.contains("s.p.a."), drop(" S.p.A.", " S.P.A."))
        .when(low.contains("solutions"), drop(" Solutions"))
        .when(low.contains("corp"), drop(" Corp"))
        .when(low.contains("group"), drop(" Group"))
        .otherwise(F.substring(name, 1, 20))
    )
