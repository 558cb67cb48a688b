"""Person names: validity, splitting and issue classes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shiftlens.functions.text import byte_length, match_key

# Words that are never a person.
NAME_BLACKLIST = [
    "Punto", "Fiesta", "Peugeot", "Auto", "Veicolo",
    "Info", "System", "Admin", "Test", "User", "Guest", "TRUE", "FALSE", "NULL",
    "Aurora", "Reminder", "Meeting", "Riunione", "Supporto", "Backup",
    "Cliente", "Fornitore", "Ufficio", "Sede", "Filiale",
]
VEHICLE_NAMES = ["Punto", "Fiesta", "Peugeot"]
SYSTEM_NAMES = ["Info", "System", "Admin", "Test", "Aurora"]
# Separators of several people in one field, in the order they are tried.
PEOPLE_SEPARATORS = ["/", ",", ";", "&", "+", " e ", " and ", " with ", " con "]
# Separators looked for in stored names.
STORED_SEPARATORS = ["/", ",", ";", "-", "+", "&"]
# Forms that rule a person's name out (an at sign, digits only, a first
# character that is no letter, host names, domain names), as one pattern.
NOT_A_PERSON = (
    r"(?i)@|^\d+$|^[^a-zA-ZÀ-ÿ\s'-]|^(?:pc|nb|server|host|www|http|ftp)|\.(?:com|it|org|net|gov)$"
)


def is_valid_person_name(name: Column, allow_empty: bool = False) -> Column:
    """Name rules that need no table; the vehicle list is an anti join (see operators)."""
    n = F.trim(F.coalesce(name, F.lit("")))
    ok = (
        ~F.lower(n).isin([w.lower() for w in NAME_BLACKLIST])
        & byte_length(n).between(2, 50)
        & ~n.rlike(NOT_A_PERSON)
    )
    return (ok | (n == "")) if allow_empty else ok


def split_people(name: Column) -> Column:
    """The names in a multi-person field: split at the first separator, in fixed order,
    that leaves two or more non-blank parts; otherwise the field itself."""

    def parts(sep: str) -> Column:
        # a literal separator, quoted for the regular expression of split()
        pieces = F.split(name, "\\Q" + sep + "\\E")
        trimmed = F.transform(pieces, lambda p: F.trim(p))
        return F.filter(trimmed, lambda p: p != "")

    choices = [F.when(F.size(parts(s)) > 1, parts(s)) for s in PEOPLE_SEPARATORS]
    return F.coalesce(*choices, F.array(name))


def first_and_rest(name: Column) -> tuple[Column, Column]:
    """``First Rest of name`` -> (First, Rest of name); one word leaves the rest blank."""
    t = F.trim(name)
    return F.substring_index(t, " ", 1), F.when(
        t.contains(" "), F.substring(t, F.instr(t, " ") + 1, F.length(t))
    ).otherwise(F.lit(""))


def surname_first(name: Column) -> tuple[Column, Column]:
    """``Surname, Name`` -> (Name, Surname); NULLs without the comma form."""
    parts = F.split(name, ", ")
    has = F.size(parts) >= 2
    return F.when(has, F.element_at(parts, 2)), F.when(has, F.element_at(parts, 1))


def split_full_name(name: Column) -> tuple[Column, Column]:
    """Name and surname of a new person: ``Surname, Name``, else first word and rest."""
    t = F.trim(name)
    given, family = surname_first(t)
    first, rest = first_and_rest(t)
    return F.coalesce(given, first), F.coalesce(family, rest)


def _is_in(column: Column, words: list[str]) -> Column:
    return F.lower(F.trim(column)).isin([w.lower() for w in words])


def _is_digits(column: Column) -> Column:
    return column.rlike(r"^[0-9]+$")


def name_issue(given: Column, family: Column) -> Column:
    """Issue class of a stored person; the first that fits, ``VALIDO`` when none does."""
    return (
        F.when(_is_in(given, VEHICLE_NAMES), "VEICOLO")
        .when(_is_in(given, SYSTEM_NAMES), "SISTEMA")
        .when((F.trim(family) == "") & (byte_length(given) < 3), "NOME_CORTO")
        .when(given.contains("@") | family.contains("@"), "EMAIL")
        .when((byte_length(given) > 50) | (byte_length(family) > 50), "TROPPO_LUNGO")
        .when(_is_digits(given) | _is_digits(family), "SOLO_NUMERI")
        .otherwise("VALIDO")
    )


def name_pattern(given: Column, family: Column) -> Column:
    """Pattern class of a stored person."""

    def either(sep: str) -> Column:
        return given.contains(sep) | family.contains(sep)

    return (
        F.when(either("/"), "SEPARATORE_SLASH")
        .when(either(","), "SEPARATORE_VIRGOLA")
        .when(either(";"), "SEPARATORE_PUNTO_VIRGOLA")
        .when((byte_length(given) == 0) | (byte_length(family) == 0), "CAMPO_VUOTO")
        .when(given.rlike("[0-9]") | family.rlike("[0-9]"), "CONTIENE_NUMERI")
        .otherwise("NORMALE")
    )


def stored_separators(given: Column, family: Column) -> Column:
    """The separators a stored name holds, as an array in fixed order."""
    found = [
        F.when(given.contains(s) | family.contains(s), F.lit(s)) for s in STORED_SEPARATORS
    ]
    return F.filter(F.array(*found), lambda s: s.isNotNull())
