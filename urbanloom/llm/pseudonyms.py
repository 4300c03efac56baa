"""Format-preserving pseudonyms: validated numbers, dates and secrets are permuted by a keyed Feistel network.

Everything is a column expression: one pattern finds the values of a text, each is replaced by its image under
a permutation of all values of its format, and the text is put together again. Equal values have equal images
in all documents and different values different ones; nothing is shuffled or held in a table.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The key of the registered query alone; every other caller passes its own secret.
KEY = "urbanloom-demo-key"
ROUNDS = 8
DIGITS, HEX = "0123456789", "0123456789abcdef"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: All printable ASCII characters but blank and quotation mark: the alphabet of secrets with marks.
PRINTABLE = "".join(chr(c) for c in range(33, 127) if c != 34)

#: The formats that are looked for, in order of precedence.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PATTERNS = {
    "email": r"(?<![\p{L}\p{M}0-9._%+-])[\p{L}\p{M}0-9._%+-]++@[\p{L}\p{M}0-9-]+(?:\.[\p{L}\p{M}0-9-]+)+",
    "secret": r"(?i:password|passwd|pwd|token|secret|api[_-]?key)(?i:[_-]?key|[_-]\w{1,20})?\s?[=:]\s?\"?[^\s\"]{6,}+",
    "access": r"\bAKIA[0-9A-Z]{16}",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d/-]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?!\d)",
}
ANY = "|".join(PATTERNS.values())
#: Dates are permuted within spans of years, all of whose days have years of four digits: 400 years each from 200
#: on, and what is left of 1 to 9999 before and after them. First day, and the two factors of the number of days.
EPOCH = "1800-01-01"
CYCLE, CYCLE_A, CYCLE_B = 146_097, 189, 773
HEAD, HEAD_A, HEAD_B = "0001-01-01", 13, 5_591
TAIL, TAIL_A, TAIL_B = "9800-01-01", 184, 397
#: Areas and serials of social security numbers: 001 to 899 without 666, with groups 01 to 99; 0001 to 9999.
AREAS, GROUPS, SERIALS = 898, 99, 9_999
#: Characters of a secret that are permuted at once; what is done for each grows with their square.
PIECE = 1024


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _draw(key: str, tweak: Column, i: Column, x: Column, below: Column) -> Column:
    """The round function: 60 bits of a keyed digest, below `below`."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), x.cast("string"), F.lit(key)), 256)
    return F.pmod(F.conv(F.substr(digest, F.lit(1), F.lit(15)), 16, 10).cast("long"), below)


def _rounds(a: Column, b: Column, below_a: Column, below_b: Column, key: str, tweak: Column) -> Column:
    """struct<a, b> after ROUNDS rounds, which change a by b and b by a in turn."""

    def step(s: Column, i: Column) -> Column:
        even = F.struct(F.pmod(s["a"] + _draw(key, tweak, i, s["b"], below_a), below_a).alias("a"), s["b"].alias("b"))
        odd = F.struct(s["a"].alias("a"), F.pmod(s["b"] + _draw(key, tweak, i, s["a"], below_b), below_b).alias("b"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.alias("a"), b.alias("b")), step)


def permuted(value: Column, alphabet: str, key: str, kind: str | Column) -> Column:
    """The image of a string over `alphabet`, of equal length; each kind and length has its own permutation.

    Longer strings go in blocks whose halves fit a long; a block's permutation depends on what is before it.
    """
    radix = len(alphabet)
    kind = F.lit(kind) if isinstance(kind, str) else kind
    width = 2 * int(math.log(4e18) / math.log(radix))

    def number(s: Column) -> Column:
        return F.aggregate(F.split(s, ""), F.lit(0).cast("long"), lambda n, c: n * radix + F.greatest(F.position(c, F.lit(alphabet)) - 1, F.lit(0)).cast("long"))

    def power(n: Column) -> Column:
        return F.aggregate(F.array_repeat(F.lit(radix).cast("long"), n), F.lit(1).cast("long"), lambda a, x: a * x)

    def string(n: Column, size: Column) -> Column:
        start = F.struct(n.alias("n"), F.lit("").alias("s"))

        def step(s: Column, _: Column) -> Column:
            place = F.pmod(s["n"], F.lit(radix).cast("long"))
            return F.struct(F.call_function("div", s["n"], F.lit(radix).cast("long")).alias("n"), F.concat(F.substr(F.lit(alphabet), (place + 1).cast("int"), F.lit(1)), s["s"]).alias("s"))

        return F.aggregate(F.array_repeat(F.lit(0), size), start, step)["s"]

    def block(i: Column) -> Column:
        b = F.substr(value, i * width + 1, F.lit(width))
        tweak = F.concat(kind, F.lit("|"), F.length(value).cast("string"), F.lit("|"), F.substr(value, F.lit(1), i * width))
        u = F.floor(F.length(b) / 2).cast("int")
        v = (F.length(b) - u).cast("int")
        done = _rounds(number(F.substr(b, F.lit(1), u)), number(F.substr(b, u + 1, v)), power(u), power(v), key, tweak)
        return _let(done, lambda d: F.concat(string(d["a"], u), string(d["b"], v)))

    blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(value) / width).cast("int") - 1, F.lit(0)))
    return F.when(F.length(value) == 0, F.lit("")).otherwise(F.array_join(F.transform(blocks, block), ""))


def refilled(value: Column, members: str, image: Column) -> Column:
    """value with its characters of the class `members` (as in a pattern) replaced by those of image, in order."""

    def at(i: Column) -> Column:
        c = F.substr(value, i, F.lit(1))
        place = F.length(F.regexp_replace(F.substr(value, F.lit(1), i), f"[^{members}]", ""))
        return F.when(c.rlike(f"[{members}]"), F.substr(image, place, F.lit(1))).otherwise(c)

    return F.when(F.length(value) == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), at), ""))


def _each_class(value: Column, key: str, kind: str | Column) -> Column:
    """value with its digits, small and capital letters permuted, each class in its places."""
    kind = F.lit(kind) if isinstance(kind, str) else kind

    def change(out: Column, name: str, members: str, alphabet: str) -> Column:
        only = F.regexp_replace(value, f"[^{members}]", "")
        both = F.struct(out.alias("o"), permuted(only, alphabet, key, F.concat(kind, F.lit(f"-{name}"))).alias("p"))
        return _let(both, lambda x: refilled(x["o"], members, x["p"]))

    out = change(value, "d", "0-9", DIGITS)
    out = change(out, "l", "a-z", LOWER)
    return change(out, "u", "A-Z", UPPER)


def luhn_sum(digits: Column, double_last: bool) -> Column:
    """Sum of the digits, every other one doubled (less 9 above 9), starting with the last or the one before it."""
    reverse = F.reverse(digits)
    places = F.sequence(F.lit(1), F.length(digits))

    def add(n: Column, i: Column) -> Column:
        d = F.substr(reverse, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return n + F.when(i % 2 == int(double_last), twice).otherwise(d)

    return F.aggregate(places, F.lit(0), add)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _card(m: Column, key: str) -> Column:
    """Valid check digit: the digits between the first and the last are permuted, the check digit follows."""
    digits = _digits(m)
    middle = permuted(F.substr(digits, F.lit(2), F.length(digits) - 2), DIGITS, key, "card")
    body = F.concat(F.substr(digits, F.lit(1), F.lit(1)), middle)
    full = _let(body, lambda b: F.concat(b, F.pmod(10 - F.pmod(luhn_sum(b, True), F.lit(10)), F.lit(10)).cast("string")))
    return F.when(F.pmod(luhn_sum(digits, False), F.lit(10)) == 0, _let(full, lambda d: refilled(m, "0-9", d))).otherwise(m)


def _iban(m: Column, key: str) -> Column:
    """Valid check digits: what follows them is permuted by class in its places, and they are worked out anew."""

    def remainder(text: Column) -> Column:
        """The account number with its first four characters last, letters as 10 to 35, modulo 97."""

        def add(n: Column, c: Column) -> Column:
            value = F.position(c, F.lit(DIGITS + UPPER)) - 1
            return F.pmod(n * F.when(value > 9, 100).otherwise(10) + value, F.lit(97)).cast("int")

        turned = F.concat(F.substr(text, F.lit(5), F.length(text)), F.substr(text, F.lit(1), F.lit(4)))
        return F.aggregate(F.split(turned, ""), F.lit(0), lambda n, c: F.when(c == "", n).otherwise(add(n, c)))

    plain, country = F.regexp_replace(m, " ", ""), F.substr(m, F.lit(1), F.lit(2))

    def image(body: Column) -> Column:
        check = F.lpad((98 - remainder(F.concat(country, F.lit("00"), body))).cast("string"), 2, "0")
        return refilled(m, "0-9A-Z", F.concat(country, check, body))

    body = _each_class(F.substr(plain, F.lit(5), F.length(plain)), key, F.concat(F.lit("iban-"), country))
    return F.when(remainder(plain) == 1, _let(body, image)).otherwise(m)


def _date(m: Column, key: str) -> Column:
    """Days of a span of years are permuted, so images have four-digit years; what is no date of the calendar stays.

    Dates with slashes have the month first; those that only the day-first reading makes a date (days from 13 on)
    are permuted among themselves, by taking images until one has such a day.
    """
    year, a, b = F.substr(m, F.lit(7), F.lit(4)), F.substr(m, F.lit(1), F.lit(2)), F.substr(m, F.lit(4), F.lit(2))
    month_first = F.concat_ws("-", year, a, b)
    day_first = m.contains("/") & (b.cast("int") <= 12) & (a.cast("int") > 12)
    iso = F.when(m.rlike("^....-"), m).when(m.contains(".") | day_first, F.concat_ws("-", year, b, a)).otherwise(month_first)
    date = F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date")

    def image(d: Column) -> Column:
        """The image of d, both in days since EPOCH."""
        day, head, tail = F.lit(EPOCH).cast("date"), F.lit(HEAD).cast("date"), F.lit(TAIL).cast("date")
        first, low, high = F.datediff(head, day), F.datediff(F.lit("0200-01-01").cast("date"), day), F.datediff(tail, day)
        cycle = F.floor(d / CYCLE) * CYCLE
        start = F.when(d < low, first).when(d >= high, high).otherwise(cycle).cast("long")
        a = F.when(d < low, HEAD_A).when(d >= high, TAIL_A).otherwise(CYCLE_A).cast("long")
        b = F.when(d < low, HEAD_B).when(d >= high, TAIL_B).otherwise(CYCLE_B).cast("long")

        def moved(x: Column) -> Column:
            place = d - x["start"]
            rest = F.pmod(place, x["b"])
            done = _rounds(F.call_function("div", place, x["b"]), rest, x["a"], x["b"], key, F.lit("date"))
            return _let(done, lambda y: y["a"] * x["b"] + y["b"] + x["start"])

        return _let(F.struct(start.alias("start"), a.alias("a"), b.alias("b")), moved)

    def dated(d: Column) -> Column:
        return F.date_add(F.lit(EPOCH).cast("date"), d.cast("int"))

    def walked(d: Column) -> Column:
        """One image in three has a day up to 12: after 96 of them the chance that none was later is 1e-39."""
        more = F.sequence(F.lit(1), F.lit(96))
        return F.aggregate(more, image(d), lambda x, _: F.when(F.dayofmonth(dated(x)) > 12, x).otherwise(_let(x, image)))

    def shown(d: Column) -> Column:
        other = F.when(day_first, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy"))
        return F.when(m.rlike("^....-"), F.date_format(d, "yyyy-MM-dd")).when(m.contains("."), F.date_format(d, "dd.MM.yyyy")).otherwise(other)

    date = F.when(date >= F.lit(HEAD).cast("date"), date)
    days = F.coalesce(F.datediff(date, F.lit(EPOCH).cast("date")), F.lit(0)).cast("long")
    return F.when(date.isNull(), m).otherwise(_let(_let(days, lambda d: F.when(day_first, walked(d)).otherwise(image(d))), lambda d: shown(dated(d))))


def _ip(m: Column, key: str) -> Column:
    """Four octets as eight hexadecimal digits, so images are addresses too."""
    octets = F.transform(F.split(m, r"\."), lambda o: F.lpad(F.lower(F.hex(o.cast("int"))), 2, "0"))
    image = permuted(F.array_join(octets, ""), HEX, key, "ip")
    parts = F.sequence(F.lit(0), F.lit(3))
    return _let(image, lambda h: F.array_join(F.transform(parts, lambda i: F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10)), "."))


def _phone(m: Column, key: str) -> Column:
    """The last ten digits (all, if fewer) are permuted; a country code before them stays."""
    digits = _digits(m)
    kept = F.greatest(F.length(digits) - 10, F.lit(0))
    image = F.concat(F.substr(digits, F.lit(1), kept), permuted(F.substr(digits, kept + 1, F.lit(10)), DIGITS, key, "phone"))
    return _let(image, lambda d: refilled(m, "0-9", d))


def _email(m: Column, key: str) -> Column:
    """Letters and digits before the @ are permuted in their places; the domain stays.

    A name with letters beyond a to z becomes 24 digits of a keyed digest: it has no small alphabet of its own.
    """
    at = F.instr(m, "@")
    name = F.substr(m, F.lit(1), at - 1)
    digest = F.substr(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), name, F.lit(key)), 256), F.lit(1), F.lit(24))
    image = F.when(name.rlike(r"[^\x00-\x7F]"), digest).otherwise(_each_class(name, key, "email"))
    return F.concat(image, F.substr(m, at, F.length(m)))


def _ssn(m: Column, key: str) -> Column:
    """Numbers that can be assigned are permuted among themselves; others stay."""
    area, group, serial = (F.substr(m, F.lit(a), F.lit(n)).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = (area - F.when(area > 666, 2).otherwise(1)) * GROUPS + group - 1
    bounds = (F.lit(AREAS * GROUPS).cast("long"), F.lit(SERIALS).cast("long"))

    def shown(x: Column) -> Column:
        high = F.call_function("div", x["a"], F.lit(GROUPS).cast("long"))
        parts = ((high + F.when(high >= 665, 2).otherwise(1), 3), (F.pmod(x["a"], F.lit(GROUPS)) + 1, 2), (x["b"] + 1, 4))
        return F.concat_ws("-", *[F.lpad(n.cast("string"), width, "0") for n, width in parts])

    return F.when(valid, _let(_rounds(place, serial - 1, *bounds, key, F.lit("ssn")), shown)).otherwise(m)


def _secret(m: Column, key: str) -> Column:
    """What follows the = or : is replaced whole: a hexadecimal number (in capitals too) by one, letters and digits by
    class, other printable ASCII by a permutation of all printable characters, and a value with any other character
    by a keyed digest of equal length.

    A long value goes in pieces of PIECE characters, each under a permutation that depends on all before it.
    """
    head = F.regexp_extract(m, r"^[\w-]+\s?[=:]\s?\"?", 0)
    body = F.substr(m, F.length(head) + 1, F.length(m))

    def piece(i: Column) -> Column:
        start = i * PIECE
        before = F.sha2(F.substr(body, F.lit(1), start), 256)
        kind = F.when(i == 0, F.lit("secret")).otherwise(F.concat(F.lit("secret@"), before))
        return F.struct(F.substr(body, start + 1, F.lit(PIECE)).alias("b"), kind.alias("k"))

    def digest(x: Column) -> Column:
        """Hexadecimal digits of keyed digests, as many as the piece has characters."""
        each = F.transform(F.sequence(F.lit(0), F.floor(F.length(x["b"]) / 64).cast("int")), lambda i: F.sha2(F.concat_ws("|", F.lit(key), x["k"], i.cast("string"), x["b"], F.lit(key)), 256))
        return F.substr(F.array_join(each, ""), F.lit(1), F.length(x["b"]))

    def image(x: Column) -> Column:
        number = permuted(F.lower(x["b"]), HEX, key, x["k"])
        marks = permuted(x["b"], PRINTABLE, key, F.concat(x["k"], F.lit("-marks")))
        return (
            F.when(body.rlike("^[0-9a-f]+$"), number).when(body.rlike("^[0-9A-F]+$"), F.upper(number))
            .when(body.rlike("^[0-9A-Za-z]+$"), _each_class(x["b"], key, x["k"]))
            .when(body.rlike(r"^[\x21\x23-\x7E]+$"), marks).otherwise(digest(x))
        )

    places = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(body) / PIECE).cast("int") - 1, F.lit(0)))
    return F.concat(head, F.array_join(F.transform(F.transform(places, piece), image), ""))


def image_of(m: Column, key: str) -> Column:
    """The pseudonym of one match of ANY; values that fail their check stay as they are."""
    access = F.concat(F.lit("AKIA"), _each_class(F.substr(m, F.lit(5), F.length(m)), key, "access"))
    return (
        F.when(m.contains("@") & m.rlike(f"^(?:{PATTERNS['email']})$"), _email(m, key))
        .when(m.rlike(f"^(?:{PATTERNS['secret']})$"), _secret(m, key))
        .when(m.rlike(f"^(?:{PATTERNS['access']})$"), access)
        .when(m.rlike(f"^(?:{PATTERNS['ip']})$"), _ip(m, key))
        .when(m.rlike(f"^(?:{PATTERNS['date']})$"), _date(m, key))
        .when(m.rlike(f"^(?:{PATTERNS['ssn']})$"), _ssn(m, key))
        .when(m.rlike(f"^(?:{PATTERNS['iban']})$"), _iban(m, key))
        .when(m.rlike(f"^(?:{PATTERNS['card']})$"), _card(m, key))
        .otherwise(_phone(m, key))
    )


def pseudonymised(text: Column, key: str) -> Column:
    """struct<text, n>: the text with its values replaced, and how many changed. Null stays null with 0.

    Texts without a match, most of them, are left after one pass of the pattern.
    """
    gaps, found = F.split(text, ANY, -1), F.regexp_extract_all(text, F.lit(ANY), 0)

    def put_together(x: Column) -> Column:
        images = F.transform(x["found"], lambda m: image_of(m, key))
        changed = _let(images, lambda im: F.struct(
            F.concat(F.array_join(F.zip_with(F.slice(x["gaps"], 1, F.size(x["found"])), im, lambda g, i: F.concat(g, i)), ""), F.element_at(x["gaps"], -1)).alias("text"),
            F.size(F.filter(F.zip_with(x["found"], im, lambda a, b: a != b), lambda c: c)).cast("long").alias("n"),
        ))
        return changed

    same = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))
    return F.when(text.rlike(ANY), _let(F.struct(gaps.alias("gaps"), found.alias("found")), put_together)).otherwise(same)


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """docs with `text` replaced by its pseudonymised form, columns and their order as before.

    `key` is the secret that fixes all permutations; the same key links values over runs. With `count`, a column of that name (replacing one that clashes) says how many values changed. Null texts
    stay null; rows may repeat; every column may have nulls.
    """
    rows, (at,) = common.by_place(docs, text)
    done = rows.withColumn("done", pseudonymised(F.col(at), key))
    kept = [(c, name) for c, name in zip(rows.columns, docs.columns, strict=True) if name != count]
    columns = [F.col("done.text") if c == at else F.col(c) for c, _ in kept]
    return done.select(*columns, *([F.col("done.n")] if count else [])).toDF(*[name for _, name in kept], *([count] if count else []))


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with its values replaced, under the demonstration key."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pseudonymise(docs.select("doc_id", "text"), KEY, count="n_replaced")
