"""Musical keys as columns.  A key is a pitch class, 0 (C) to 11 (B), and a flag for minor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the pitch classes.
NOTES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]


def pitch_class(index: Column) -> Column:
    return F.pmod(index, F.lit(12))


def standard(pitch: Column, minor: Column) -> Column:
    """Note name, and m for minor."""
    return F.concat(F.element_at(F.array(*map(F.lit, NOTES)), (pitch_class(pitch) + 1).cast("int")), F.when(minor, "m").otherwise(""))


def wheel_number(pitch: Column, minor: Column) -> Column:
    """1 to 12: a fifth up is one step on; minor keys stand with their relative major."""
    return F.pmod(pitch * 7 + F.when(minor, 4).otherwise(7), F.lit(12)) + 1


def camelot(pitch: Column, minor: Column) -> Column:
    return F.concat(wheel_number(pitch, minor).cast("string"), F.when(minor, "A").otherwise("B"))


def open_key(pitch: Column, minor: Column) -> Column:
    return F.concat(wheel_number(pitch, minor).cast("string"), F.when(minor, "m").otherwise("d"))


def code_number(code: Column) -> Column:
    """The leading digits of a code as 0 to 255; 0 if there are none, they overflow, or the code is shorter than two bytes."""
    n = F.regexp_extract(code, "^([0-9]+)", 1).try_cast("int")
    return F.when((F.octet_length(code) >= 2) & n.between(0, 255), n).otherwise(0)


def code_letter(code: Column) -> Column:
    return F.right(code, F.lit(1))


def _code(n: Column, letter: Column) -> Column:
    return F.when(n.between(1, 12) & letter.isin("A", "B"), F.concat(n.cast("string"), letter)).otherwise("")


def compatible(code: Column) -> Column:
    """[same, one up, one down, other letter]; what is no code on the wheel is '' there, and no number gives []."""
    n, letter = code_number(code), code_letter(code)
    up, down = F.when(n == 12, 1).otherwise(n + 1), F.when(n == 1, 12).otherwise(n - 1)
    other = F.when(letter == "A", "B").otherwise("A")
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array(_code(n, letter), _code(up, letter), _code(down, letter), _code(n, other)))
