"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_size(n: Column) -> Column:
    """Bytes for people: steps of 1024; no decimals for bytes, one for KB and MB, two above. Rounded as printf does, half to
    even of the exact value (format_string rounds the shortest digits of a double, half up)."""
    def scaled(power: int, decimals: int, unit: str) -> Column:
        x, steps = n.cast("double") / float(1024**power), 10**decimals
        behind = ((x % 1.0) * float(2**52)).cast("long") * steps
        down, rest = F.shiftright(behind, 52), behind % 2**52
        digits = down + ((rest > 2**51) | ((rest == 2**51) & (down % 2 == 1))).cast("long")
        whole = (x - x % 1.0 + F.floor(digits / steps)).cast("decimal(38,0)")
        return F.concat(whole.cast("string"), F.lit("."), F.lpad((digits % steps).cast("string"), decimals, "0"), F.lit(f" {unit}"))

    return (
        F.when(n < 0, "0 B").when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, scaled(1, 1, "KB"))
        .when(n < 1024**3, scaled(2, 1, "MB")).when(n < 1024**4, scaled(3, 2, "GB")).otherwise(scaled(4, 2, "TB"))
    )


def drive_letter(mount: Column) -> Column:
    """The upper-case letter of a mount like ``c:`` or ``C:\\``, else null."""
    letter = F.regexp_extract(mount, r"^([A-Za-z]):[\\/]?$", 1)
    return F.when(letter != "", F.upper(letter))


def strict_u64(text: Column) -> Column:
    """A decimal without sign, leading zero or overflow, else null."""
    return F.when(text.rlike(r"^(0|[1-9][0-9]{0,19})$"), text.try_cast("decimal(20,0)"))


def valid_key(key: Column) -> Column:
    """Object keys: segments of letters, digits and ``-_.``, none of them empty or made of dots."""
    return key.rlike(r"^[A-Za-z0-9_.\-]+(/[A-Za-z0-9_.\-]+)*$") & ~key.rlike(r"(^|/)\.{1,2}(/|$)") & (F.octet_length(key) <= 1024)


def label(raw: Column, most: int = 256) -> Column:
    """UTF-16LE bytes as a label: control characters go, at most so many bytes of whole characters stay, never empty."""
    text = F.regexp_replace(F.decode(raw, "UTF-16LE"), r"[\x00-\x1F\x7F]", "")
    fits = F.filter(F.sequence(F.lit(0), F.least(F.length(text), F.lit(most))), lambda k: F.octet_length(F.left(text, k)) <= most)
    cut = F.left(text, F.array_max(fits))
    return F.when(cut == "", ".").otherwise(cut)


def fingerprint(*fields: Column) -> Column:
    """Fields with their length in bytes before them, so that no two lists of fields give one text."""
    return F.concat(*(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f, F.lit(";")) for f in fields))


def percent_encoded(text: Column) -> Column:
    """UTF-8 bytes other than letters, digits and ``-_.:`` as ``%`` and two lower-case hexadecimal digits."""
    digits = F.hex(F.encode(text, "UTF-8"))
    pairs = F.transform(F.filter(F.sequence(F.lit(0), F.length(digits).cast("int") - 2, F.lit(2)), lambda k: F.length(digits) > 0), lambda k: F.substring(digits, k + 1, 2))
    plain = lambda p: F.decode(F.unhex(p), "US-ASCII")
    shown = F.transform(pairs, lambda p: F.when(plain(p).rlike("^[A-Za-z0-9_.:-]$"), plain(p)).otherwise(F.concat(F.lit("%"), F.lower(p))))
    return F.when(F.length(text) == 0, "").otherwise(F.array_join(shown, ""))


def percent_decoded(text: Column) -> Column:
    """The text that percent_encoded() was given."""
    return F.url_decode(text)
