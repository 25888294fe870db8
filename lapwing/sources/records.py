"""Length-prefixed comment records and the validity of their texts, as column expressions over binary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lapwing.functions.signal import let
from lapwing.sources.packets import MAGIC, little_endian

#: The kind of a comment record, and bytes before its first length.
KIND, HEAD = 3, 7
#: One character of UTF-8 as bytes, or a run of ASCII: no overlong forms, no surrogates, nothing beyond U+10FFFF.
_CHARACTER = "[\\x00-\\x7F]+|[\\xC2-\\xDF][\\x80-\\xBF]|\\xE0[\\xA0-\\xBF][\\x80-\\xBF]|[\\xE1-\\xEC\\xEE\\xEF][\\x80-\\xBF]{2}|\\xED[\\x80-\\x9F][\\x80-\\xBF]|\\xF0[\\x90-\\xBF][\\x80-\\xBF]{2}|[\\xF1-\\xF3][\\x80-\\xBF]{3}|\\xF4[\\x80-\\x8F][\\x80-\\xBF]{2}"


def valid_up_to(data: Column) -> Column:
    """How many bytes from the start are whole characters of UTF-8: the offset of the first bad byte sequence, or the size if there is none.

    Bytes are read as characters of one byte, and the automaton of a character runs again and again from where it stopped.
    """
    found = F.regexp_extract_all(F.decode(data, "ISO-8859-1"), F.lit(f"(?s)\\G(?:{_CHARACTER})"), F.lit(0))
    return F.aggregate(found, F.lit(0), lambda n, c: n + F.length(c))


def decoded(data: Column) -> Column:
    """The text of valid UTF-8, null for any other bytes."""
    return F.when(valid_up_to(data) == F.octet_length(data), F.decode(data, "UTF-8"))


def _row(**fields: Column) -> Column:
    return F.named_struct(*[c for name, value in fields.items() for c in (F.lit(name), value)])


def _number(size: Column) -> Column:
    return F.concat(*[F.lpad(F.hex(F.shiftright(size.cast("long"), 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(4)])


def comment_record(vendor: Column, comments: Column) -> Column:
    """A record of a vendor and an array of comments, as binary."""
    field = lambda text: F.concat(_number(F.octet_length(text)), F.hex(F.encode(text, "UTF-8")))
    head = F.concat(F.lit(f"{KIND:02X}"), F.hex(F.encode(F.lit(MAGIC), "UTF-8")))
    return F.unhex(F.concat(head, field(vendor), _number(F.size(comments)), F.array_join(F.transform(comments, field), ""), F.lit("01")))


def parsed_comments(data: Column) -> Column:
    """(vendor, comments) of a comment record; null if it is of another kind, a length reaches beyond its end, a text isn't UTF-8 or the last bit isn't set.

    Fields are walked one after the other, each from where the one before ended. A count that the bytes left can't hold is refused before the walk.
    """
    size = F.octet_length(data)
    at = lambda o: little_endian(data, o, 4)
    fits = lambda o: o + 4 <= size
    field = lambda o, n: F.substring(data, (o + 5).cast("int"), n.cast("int"))

    def step(s: Column, _: Column) -> Column:
        def read(n: Column) -> Column:
            text = let(field(s.o, n), decoded)
            moved = let(text, lambda t: _row(o=F.when(t.isNotNull(), s.o + 4 + n), found=F.when(t.isNotNull(), F.concat(s.found, F.array(t))).otherwise(s.found)))
            return F.when(n.isNotNull() & (s.o + 4 + n <= size), moved).otherwise(_row(o=F.lit(None).cast("long"), found=s.found))

        return F.when(s.o.isNull(), s).otherwise(let(F.when(fits(s.o), at(s.o)), read))

    def walked(v: Column) -> Column:
        count_at = F.lit(HEAD + 4).cast("long") + v
        count = F.when(fits(count_at), at(count_at))
        start = _row(o=count_at + 4, found=F.array().cast("array<string>"))
        possible = count.isNotNull() & (count <= F.floor((size - count_at - 4) / 4))
        steps = F.when(possible & (count > 0), F.sequence(F.lit(1), count.cast("int"))).otherwise(F.array().cast("array<int>"))
        done = F.aggregate(steps, start, step)
        vendor = decoded(field(F.lit(HEAD), v))

        def closed(s: Column) -> Column:
            framed = (s.o < size) & (F.conv(F.hex(F.substring(data, (s.o + 1).cast("int"), F.lit(1))), 16, 10).cast("int") % 2 == 1)
            return F.when(possible & s.o.isNotNull() & framed, s.found)

        return let(_row(vendor=vendor, comments=let(done, closed)), lambda r: F.when(r.vendor.isNotNull() & r.comments.isNotNull(), r))

    head = F.hex(F.substring(data, 1, HEAD)) == F.concat(F.lit(f"{KIND:02X}"), F.hex(F.encode(F.lit(MAGIC), "UTF-8")))
    length = F.when(head & fits(F.lit(HEAD)), at(F.lit(HEAD)))
    return let(F.when(F.lit(HEAD + 4) + length <= size, length), lambda v: F.when(v.isNotNull(), walked(v)))
