"""Scalar functions: ages in words, display names, paths, labels, enumerations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of an age and their seconds, largest first.
AGE_UNITS = (("year", 31_536_000), ("month", 2_592_000), ("week", 604_800), ("day", 86_400), ("hour", 3_600), ("minute", 60))
#: Roles by number, and languages that a profile may have.
ROLES = {1: "User", 2: "Guest", 3: "Admin", 4: "Manager", 5: "Superuser"}
LANGUAGES = {"en": "English", "es": "Spanish"}
#: Between a number and its unit stands a space that does not break.
SPACE = "\u00a0"
SAFE_METHODS = ("GET", "HEAD", "OPTIONS")


def _leap_years(before: Column) -> Column:
    """The number of leap years from 1 up to a year, itself not included."""
    y = before - 1
    return F.floor(y / 4) - F.floor(y / 100) + F.floor(y / 400)


def age_in_words(since: Column, as_of: Column) -> Column:
    """The age in its largest unit and the next smaller one if that is not zero: ``2 days, 3 hours``.

    The times are subtracted to the microsecond and the rest of a second is dropped. Years have 365 and months 30 days; the
    leap days between are taken off first: one for each leap year from the first year up to the last, the last not included;
    if there is any, one less if the first year is a leap year, else one more if the last one is. Under a minute, and for times that
    are still to come, ``0 minutes``. Years are those of the session's time zone.
    """
    first, last = F.year(since), F.year(as_of)
    leap = lambda y: (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    days = _leap_years(last) - _leap_years(first)
    days = F.when(days == 0, days).when(leap(first), days - 1).when(leap(last), days + 1).otherwise(days)
    seconds = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / 1_000_000)

    def words(left: Column) -> Column:
        said = F.lit(f"0{SPACE}minutes")
        for (unit, size), following in reversed(list(zip(AGE_UNITS, [*AGE_UNITS[1:], None]))):
            n = F.floor(left / size)
            told = _counted(n, unit)
            if following:
                m = F.floor((left - n * size) / following[1])
                told = F.when(m > 0, F.concat(told, F.lit(", "), _counted(m, following[0]))).otherwise(told)
            said = F.when(n > 0, told).otherwise(said)
        return said

    # The seconds are the variable of a lambda, so that they are worked out once and not in each of the branches.
    left = F.array(F.greatest(seconds - days * 86_400, F.lit(0)))
    return F.when(seconds.isNotNull(), F.element_at(F.transform(left, words), 1))


def _counted(n: Column, unit: str) -> Column:
    return F.concat(n.cast("string"), F.lit(SPACE + unit), F.when(n == 1, "").otherwise("s"))


def display_name(first: Column, last: Column) -> Column:
    """``first last``; an absent last name shows as ``None``."""
    return F.concat(first, F.lit(" "), F.coalesce(last, F.lit("None")))


def static_path(name: Column, root: str = "static/") -> Column:
    return F.concat(F.lit(root), name)


def percent(ratio: Column) -> Column:
    return ratio * 100


def component_label(number: Column, prefix: str = "PC") -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def enum_name(code: Column, names: Mapping) -> Column:
    """The name of a code; null for a code without one."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), code)


def may_access(method: Column, role: Column, needed: int, owner: Column | None = None, user: Column | None = None) -> Column:
    """Reading is open to all; other methods need the role, and the owner where one is given. Null never matches."""
    allowed = F.coalesce(role == needed, F.lit(False))
    if owner is not None:
        allowed = allowed & F.coalesce(owner == user, F.lit(False))
    return F.coalesce(method.isin(*SAFE_METHODS), F.lit(False)) | allowed


#: What an address may have before the last @, as words joined by single dots or as one quoted text, and the labels of a
#: host after it, the last of two characters or more; letters of any script may stand in labels.
_USER = r"""[-!#$%&'*+/=?^_`{}|~0-9A-Za-z]+(\.[-!#$%&'*+/=?^_`{}|~0-9A-Za-z]+)*"""
_QUOTED = r"""\"([\x01-\x08\x0B\x0C\x0E-\x1F!#-\[\]-\x7F]|\\[\x01-\x09\x0B\x0C\x0E-\x7F])*\""""
_LABEL = r"[\p{L}\p{M}\p{Nd}]"
_HOST = rf"({_LABEL}(({_LABEL}|-){{0,61}}{_LABEL})?\.)+({_LABEL}|-){{1,62}}{_LABEL}"
_BYTE = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IP4 = rf"{_BYTE}(\.{_BYTE}){{3}}"
_IP6 = r"([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[^:]*+(:[^:]++)*+::([^:]++(:[^:]++)*+)?$)(?!([^:]*:){8})(([0-9A-Fa-f]{1,4})?(:|$)){2,9}"


def is_email(address: Column) -> Column:
    """Whether a text has the form of an email address; null has not.

    What stands before the last @ is words joined by single dots, or a quoted text; what follows is ``localhost``, a host
    name of two labels or more (no label begins or ends with a hyphen), or an IP address in brackets.
    """
    user, host = F.regexp_extract(address, r"(?s)^(.*)@", 1), F.regexp_extract(address, r"(?s)@([^@]*)$", 1)
    literal = F.regexp_extract(host, r"^\[([A-Fa-f0-9:.]+)\]$", 1)
    user_fits = user.rlike(rf"\A({_USER})\z") | user.rlike(rf"\A({_QUOTED})\z")
    host_fits = (F.lower(host) == "localhost") | host.rlike(rf"\A({_HOST})\z") | literal.rlike(rf"\A({_IP4})\z") | literal.rlike(rf"\A({_IP6})\z")
    return F.coalesce(address.contains("@") & user_fits & host_fits, F.lit(False))
