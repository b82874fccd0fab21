"""Format-preserving pseudonyms for personal numbers, dates and addresses."""

from __future__ import annotations

import string
from calendar import isleap

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.columns import let, whole

# What is looked for, in order of precedence at one place of the text.
PATTERNS = {
    "secret": r"[0-9A-Fa-f]{32,}(?![0-9A-Za-z])",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![0-9A-Za-z])",
    "date": r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4})(?![0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"\+(?:1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
    r"|(?!1[ .(-])[0-9]{1,3}[ -]?\(?[0-9]{2,4}\)?(?:[ -]?[0-9]{2,4}){2,4})(?![0-9])",
    "national": r"\([2-9][0-9]{2}\)[ -]?[2-9][0-9]{2}-[0-9]{4}(?![0-9])",
}
START = r"(?<![0-9A-Za-z.+_%-])"
ANY = START + "(?:" + "|".join(PATTERNS.values()) + ")"
POSSIBLE = "[0-9@]|[A-Fa-f]{32}"

ALPHABETS = (string.digits, string.ascii_lowercase, string.ascii_uppercase)
HEX = (string.digits, "abcdef", "ABCDEF")
ROUNDS = 8
YEARS = range(1850, 2178)  # of dates that are permuted


class _Cipher:
    """Keyed permutations of a value within its format. ``restore`` runs them backwards."""

    def __init__(self, key: str, restore: bool):
        self.key, self.sign = key, -1 if restore else 1
        rounds = range(ROUNDS)
        self.rounds = F.array(*[F.lit(r) for r in (reversed(rounds) if restore else rounds)])
        self.restore = restore

    def _digest(self, kind: str | Column, r: Column, half: Column) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.sha2(F.concat_ws("|", F.lit(self.key), kind, r, half), 512)

    def _run(self, left: Column, right: Column, shifted) -> Column:
        """The Feistel rounds over two halves; ``shifted(x, r, other)`` adds the round's key stream to x."""
        start = F.struct(left.alias("l"), right.alias("r"))

        def step(s: Column, r: Column) -> Column:
            if self.restore:
                return F.struct(shifted(s["r"], r, s["l"]).alias("l"), s["l"].alias("r"))
            return F.struct(s["r"].alias("l"), shifted(s["l"], r, s["r"]).alias("r"))

        return F.aggregate(self.rounds, start, step)

    def text(
        self, value: Column, kind: str, alphabets: tuple[str, ...] = ALPHABETS, fold: bool = False
    ) -> Column:
        """Every character moves within its own alphabet; others stay. With ``fold`` values that differ in the case of
        A-Z move alike, so their pseudonyms differ in case only."""

        def byte(digest: Column, i: Column) -> Column:
            return F.conv(F.substring(digest, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")

        def moved(c: Column, k: Column) -> Column:
            out = c
            for letters in alphabets:
                at = F.instr(F.lit(letters), c)
                turned = F.substring(F.lit(letters), F.pmod(at - 1 + self.sign * k, F.lit(len(letters))) + 1, F.lit(1))
                out = F.when(at > 0, turned).otherwise(out)
            return out

        def shifted(x: Column, r: Column, other: Column) -> Column:
            return let(
                self._digest(kind, r, F.lower(other) if fold else other),
                lambda digest: F.array_join(
                    F.transform(F.split(x, ""), lambda c, i: F.when(c == "", "").otherwise(moved(c, byte(digest, i)))), ""
                ),
            )

        middle = F.floor(F.char_length(value) / 2).cast("int")
        halves = self._run(
            F.substring(value, F.lit(1), middle),
            F.substring(value, middle + 1, F.char_length(value)),
            shifted,
        )
        return let(halves, lambda s: F.concat(s["l"], s["r"]))

    def number(self, value: Column, sides: tuple[int | Column, int | Column], kind: str | Column) -> Column:
        """A permutation of 0 .. sides[0] * sides[1] - 1."""
        a, b = (F.lit(side).cast("long") if isinstance(side, int) else side.cast("long") for side in sides)

        def shifted(x: Column, r: Column, other: Column) -> Column:
            # The left half goes first: rounds with even numbers move it.
            side = F.when(r % 2 == 0, a).otherwise(b)
            stream = F.conv(F.substring(self._digest(kind, r, other.cast("string")), 1, 15), 16, 10).cast("long")
            return F.pmod(x + self.sign * (stream % side), side)

        value = value.cast("long")
        halves = self._run(F.floor(value / b).cast("long"), F.pmod(value, b), shifted)
        return let(halves, lambda s: s["l"] * b + s["r"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _filled(layout: Column, value: Column) -> Column:
    """``value`` written into the places of letters and digits of ``layout``."""
    places = F.sequence(F.lit(1), F.char_length(layout))

    def char(i: Column) -> Column:
        here = F.substring(layout, i, F.lit(1))
        nth = F.char_length(F.regexp_replace(F.substring(layout, F.lit(1), i), "[^0-9A-Za-z]", ""))
        return F.when(F.rlike(here, F.lit("[0-9A-Za-z]")), F.substring(value, nth, F.lit(1))).otherwise(here)

    return F.array_join(F.transform(places, char), "")


def luhn_digit(payload: Column) -> Column:
    """The check digit that follows ``payload``."""
    doubled = F.transform(
        F.split(F.reverse(payload), ""),
        lambda c, i: F.when(i % 2 == 0, F.element_at(F.array(*[F.lit(int(x)) for x in "0246813579"]), c.cast("int") + 1)).otherwise(c.cast("int")),
    )
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda s, x: s + x), F.lit(10)).cast("string")


def _iban_rest(iban: Column) -> Column:
    """The number modulo 97 with the first four characters moved to the end."""
    moved = F.concat(F.substring(iban, F.lit(5), F.char_length(iban)), F.substring(iban, 1, 4))
    values = F.transform(
        F.split(moved, ""),
        lambda c: F.when(F.rlike(c, F.lit("[0-9]")), c.try_cast("int")).otherwise(F.ascii(c) - 55),
    )
    return F.aggregate(
        values, F.lit(0), lambda s, v: F.when(v < 10, s * 10 + v).otherwise(s * 100 + v) % 97
    )


def _secret(m: Column, cipher: _Cipher) -> Column:
    return cipher.text(m, "secret", HEX, fold=True)


def _email(m: Column, cipher: _Cipher) -> Column:
    """The name before the ``@``; the domain, which says who runs the mailbox, stays."""
    name = cipher.text(F.substring_index(m, "@", 1), "email", fold=True)
    return F.concat(name, F.lit("@"), F.substring_index(m, "@", -1))


def _iban(m: Column, cipher: _Cipher) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))

    def written_anew(p: Column) -> Column:
        rest = cipher.text(F.substring(p, F.lit(5), F.char_length(p)), "iban")

        def checked(body: Column) -> Column:
            country = F.substring(p, 1, 2)
            check = F.lpad((98 - _iban_rest(F.concat(country, F.lit("00"), body))).cast("string"), 2, "0")
            return _filled(m, F.concat(country, check, body))

        return let(rest, checked)

    return let(plain, lambda p: F.when((F.char_length(p) >= 15) & (_iban_rest(p) == 1), written_anew(p)))


def _numbers(values) -> Column:
    return F.array(*[F.lit(value) for value in values])


def _moved_date(y: Column, m: Column, d: Column, cipher: _Cipher) -> Column:
    """A date of the same class: its month has one digit or two, and as many days, as before; its day is below
    10, below 13 or above. So each layout, read from the new date, is the one of the old date, and
    a date has one pseudonym in all layouts. A class is years and months times days."""
    leap = F.day(F.last_day(F.make_date(y, F.lit(2), F.lit(1)))) == 29
    february = m == 2
    years = (
        F.when(february & leap, _numbers(y for y in YEARS if isleap(y)))
        .when(february, _numbers(y for y in YEARS if not isleap(y)))
        .otherwise(_numbers(YEARS))
    )
    months = (
        F.when(february, _numbers([2]))
        .when(m.isin(4, 6, 9), _numbers([4, 6, 9]))
        .when(m < 10, _numbers([1, 3, 5, 7, 8]))
        .when(m == 11, _numbers([11]))
        .otherwise(_numbers([10, 12]))
    )
    first = F.when(d < 10, 1).when(d < 13, 10).otherwise(13)
    n_days = F.when(d < 10, 9).when(d < 13, 3).otherwise(F.day(F.last_day(F.make_date(y, m, F.lit(1)))) - 12)

    def moved(c: Column) -> Column:
        n_months = F.size(c["months"])
        month = (F.array_position(c["years"], y) - 1) * n_months + F.array_position(c["months"], m) - 1
        kind = F.concat_ws("|", F.lit("date"), F.get(c["months"], F.lit(0)), F.size(c["years"]), c["first"])
        new = cipher.number(month * c["n"] + d - c["first"], (F.size(c["years"]) * n_months, c["n"]), kind)
        return let(
            new,
            lambda v: F.struct(
                F.get(c["years"], F.floor(v / (c["n"] * n_months)).cast("int")).alias("y"),
                F.get(c["months"], F.pmod(F.floor(v / c["n"]), n_months).cast("int")).alias("m"),
                (F.pmod(v, c["n"]) + c["first"]).cast("int").alias("d"),
            ),
        )

    return let(F.struct(years.alias("years"), months.alias("months"), first.alias("first"), n_days.alias("n")), moved)


def _date(m: Column, cipher: _Cipher) -> Column:
    """A date with slashes has its month first, unless that cannot be; one with dots has its day first."""
    iso = F.rlike(m, F.lit("^[0-9]{4}-"))
    dots = F.instr(m, ".") > 0
    mark = F.when(iso, "-").when(dots, ".").otherwise("/")

    def rewritten(p: Column) -> Column:
        a, b, c = (F.get(p, F.lit(i)) for i in range(3))
        day_first = ~iso & (dots | (a.cast("int") > 12))
        year = F.when(iso, a).otherwise(c)
        month = F.when(iso | day_first, b).otherwise(a)
        day = F.when(iso, c).when(day_first, a).otherwise(b)
        date = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")
        valid = date.isNotNull() & F.year(date).between(YEARS[0], YEARS[-1])

        def shown(new: Column) -> Column:
            # Numbers of one digit stay such, and so does a zero before them.
            mo = F.lpad(new["m"].cast("string"), F.char_length(month), F.lit("0"))
            d = F.lpad(new["d"].cast("string"), F.char_length(day), F.lit("0"))
            return (
                F.when(iso, F.concat_ws("-", new["y"], mo, d))
                .when(day_first, F.concat(d, mark, mo, mark, new["y"]))
                .otherwise(F.concat(mo, mark, d, mark, new["y"]))
            )

        return F.when(valid, let(_moved_date(F.year(date), F.month(date), F.day(date), cipher), shown))

    return let(F.split(m, "[-./]"), rewritten)


def _ssn(m: Column, cipher: _Cipher) -> Column:
    area, group, serial = (F.substring(m, at, n).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    nth = area - 1 - (area > 666).cast("int")
    value = (nth * 99 + group - 1).cast("long") * 9999 + serial - 1

    def shown(v: Column) -> Column:
        n = F.floor(v / (99 * 9999)).cast("int")
        parts = (
            (n + 1 + (n >= 665).cast("int"), 3),
            (F.pmod(F.floor(v / 9999), F.lit(99)).cast("int") + 1, 2),
            (F.pmod(v, F.lit(9999)).cast("int") + 1, 4),
        )
        return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in parts])

    return F.when(valid, let(cipher.number(value, (898 * 99, 9999), "ssn"), shown))


def _ip(m: Column, cipher: _Cipher) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    plain = ~F.rlike(m, F.lit(r"(^|\.)0[0-9]"))
    value = F.aggregate(octets, F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    valid = plain & F.forall(octets, lambda x: x <= 255)

    def shown(v: Column) -> Column:
        return F.concat_ws(".", *[F.pmod(F.shiftright(v, n), F.lit(256)).cast("string") for n in (24, 16, 8, 0)])

    return F.when(valid, let(cipher.number(value, (65536, 65536), "ip"), shown))


def _card(m: Column, cipher: _Cipher) -> Column:
    def rewritten(d: Column) -> Column:
        payload = F.substring(d, F.lit(1), F.char_length(d) - 1)
        valid = (F.right(d, F.lit(1)) == luhn_digit(payload)) & (F.translate(d, "0", "") != "")
        new = let(cipher.text(payload, "card"), lambda p: _filled(m, F.concat(p, luhn_digit(p))))
        return F.when(valid, new)

    return let(_digits(m), rewritten)


def _phone(m: Column, cipher: _Cipher) -> Column:
    """The country code stays: the digits up to the first separator, else the first one."""
    code = F.regexp_extract(m, r"^\+([0-9]{1,3})[ .(-]", 1)
    keep = F.when(code == "", F.lit(1)).otherwise(F.char_length(code))

    def rewritten(d: Column) -> Column:
        known, own = F.substring(d, F.lit(1), keep), F.substring(d, keep + 1, F.char_length(d))
        return F.when(
            F.char_length(d).between(8, 15), _filled(m, F.concat(known, cipher.text(own, "phone")))
        )

    return let(_digits(m), rewritten)


def _national(m: Column, cipher: _Cipher) -> Column:
    """Area code and exchange begin with 2 to 9."""

    def rewritten(d: Column) -> Column:
        value = (F.substring(d, 1, 3).cast("long") - 200) * 8_000_000 + F.substring(d, 4, 7).cast("long") - 2_000_000

        def shown(v: Column) -> Column:
            area, rest = F.floor(v / 8_000_000) + 200, F.pmod(v, F.lit(8_000_000)) + 2_000_000
            return _filled(m, F.concat(area.cast("string"), rest.cast("string")))

        return let(cipher.number(value, (80_000, 80_000), "national"), shown)

    return let(_digits(m), rewritten)


KINDS = {
    "secret": _secret, "email": _email, "iban": _iban, "date": _date,
    "ssn": _ssn, "ip": _ip, "card": _card, "phone": _phone, "national": _national,
}


def _pseudonym(m: Column, cipher: _Cipher) -> Column:
    """The pseudonym of one match; NULL when it is no valid value of its kind."""
    out = F.lit(None).cast("string")
    for kind in reversed(PATTERNS):
        # A number that fits two forms, as a card or a phone, belongs to the first.
        out = F.when(F.rlike(m, F.lit(f"^(?:{PATTERNS[kind]})$")), KINDS[kind](m, cipher)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, restore: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, text, n_replaced.

    Card numbers (Luhn), IBANs (mod 97), social security numbers, IPv4 addresses,
    phone numbers with country code or like ``(212) 555-0123``, calendar dates from 1850 to 2177, the local part of mail
    addresses (domains stay) and long hexadecimal secrets are replaced by a keyed Feistel permutation
    within their format: a card stays a valid card with its separators, a date a
    date. Equal values get equal pseudonyms in all documents and layouts, addresses and secrets also when they differ in
    case; different values get different ones. Numbers that fail their check stay. ``restore`` with the same
    key gives the texts back.

    All work is within the row. Texts without digit, ``@`` or such a secret are passed on unseen. NULL
    text stays NULL, with 0 replaced. Repeated rows each get a row. An empty
    table gives an empty result. Other columns are ignored.
    """
    cipher = _Cipher(key, restore)

    def replaced(found: Column) -> Column:
        return let(
            F.transform(found, lambda m: F.struct(m.alias("old"), _pseudonym(m, cipher).alias("new"))),
            lambda pairs: F.struct(
                F.array_join(
                    F.zip_with(
                        F.split(whole(), ANY, -1),
                        F.transform(pairs, lambda p: F.coalesce(p["new"], p["old"])),
                        lambda gap, m: F.concat(gap, F.coalesce(m, F.lit(""))),
                    ),
                    "",
                ).alias("text"),
                F.size(F.filter(pairs, lambda p: p["new"].isNotNull())).cast("long").alias("n"),
            ),
        )

    found = F.regexp_extract_all(whole(), F.lit(ANY), F.lit(0))
    done = F.when(
        F.rlike(whole(), F.lit(POSSIBLE)),
        let(found, lambda m: F.when(F.size(m) > 0, replaced(m))),
    )
    return docs.select("doc_id", "text", done.alias("done")).select(
        "doc_id",
        F.coalesce("done.text", "text").alias("text"),
        F.coalesce("done.n", F.lit(0).cast("long")).alias("n_replaced"),
    )
