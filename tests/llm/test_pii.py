"""Pseudonyms: formats, checks, links between documents, and an exact way back."""

import datetime
import hashlib
import re

import pytest
from newsloom.llm.pii import pseudonymise

KEY = "test key"


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()]
    return sum(sum(divmod(d * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0


def changed(docs_of, texts, key=KEY):
    return [r.text for r in pseudonymise(docs_of(texts), key).orderBy("doc_id").collect()]


FORMS = {
    "4111 1111 1111 1111": r"\d{4} \d{4} \d{4} \d{4}",
    "378282246310005": r"\d{15}",
    "2024-02-29": r"\d{4}-\d\d-\d\d",
    "29.02.2024": r"\d\d\.\d\d\.\d{4}",
    "3/7/1999": r"\d{1,2}/\d{1,2}/\d{4}",
    "123-45-6789": r"\d{3}-\d\d-\d{4}",
    "192.0.2.17": r"(\d{1,3}\.){3}\d{1,3}",
    "+1 (212) 555-0199": r"\+1 \(\d{3}\) \d{3}-\d{4}",
    "+49 30 1234 5678": r"\+49 \d\d \d{4} \d{4}",
    "ann.b99@mail.example.com": r"[a-z]{3}\.[a-z]\d\d@mail\.example\.com",
    "DE89 3704 0044 0532 0130 00": r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d",
    "0123456789abcdef0123456789abcdef": r"[0-9a-f]{32}",
}


@pytest.mark.parametrize("value, form", FORMS.items())
def test_forms_and_links(docs_of, value, form):
    one, two = changed(docs_of, [f"see {value}.", f"{value}, {value}"])
    new = re.fullmatch(r"see (.*)\.", one)[1]
    assert new != value and re.fullmatch(form, new) and two == f"{new}, {new}"
    assert changed(docs_of, [f"see {value}."], "other")[0] != one


def test_values_stay_valid(docs_of):
    text = " ".join(changed(docs_of, ["4111111111111111", "5500-0055-5555-5559", "2000-01-31", "GB82WEST12345698765432"]))
    cards = re.findall(r"\b\d{16}\b|\d{4}-\d{4}-\d{4}-\d{4}", text)
    assert len(cards) == 2 and all(map(luhn, cards))
    datetime.date.fromisoformat(re.search(r"\d{4}-\d\d-\d\d(?!\d|-)", text.replace(cards[1], ""))[0])
    iban = re.search(r"GB\w{20}", text)[0]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def test_layouts_share_a_pseudonym(docs_of):
    plain, spaced = changed(docs_of, ["4111111111111111", "4111 1111 1111 1111"])
    assert spaced.replace(" ", "") == plain
    iso, german = changed(docs_of, ["1987-06-05", "05.06.1987"])
    assert german == ".".join(iso.split("-")[::-1])


def test_different_values_differ(docs_of):
    days = [str(datetime.date(1970, 1, 1) + datetime.timedelta(n)) for n in range(2000)]
    addresses = [f"10.0.{n // 200}.{n % 200}" for n in range(2000)]
    numbers = [f"{100 + n // 90}-{10 + n % 90}-1234" for n in range(2000)]
    new = changed(docs_of, [" ".join(x) for x in (days, addresses, numbers)])
    for old, text in zip((days, addresses, numbers), new):
        assert len(set(text.split())) == len(set(old)) == 2000


def test_invalid_values_stay(docs_of):
    texts = ["4111111111111112", "300.1.1.1", "2024-02-30", "000-12-3456", "DE88370400440532013000", "version 4.0",
             "1234567890123456789012", "12:30", "a@b", "", "plain"]
    got = pseudonymise(docs_of([*texts, None]), KEY).orderBy("doc_id").collect()
    assert [r.text for r in got] == [*texts, None] and {r.n_replaced for r in got} == {0}


def test_there_and_back(documents, docs_of):
    texts = [*FORMS, " ".join(FORMS), "x" * 100_000 + " 4111111111111111 " + "y" * 100_000, "\n4111111111111111\n"]
    for docs in (documents, docs_of(texts, done=["x"] * len(texts))):
        new = pseudonymise(docs, KEY)
        back = {r.doc_id: r.text for r in pseudonymise(new, KEY, restore=True).collect()}
        assert back == {r.doc_id: r.text for r in docs.collect()}
        assert new.filter("n_replaced > 0").count() > 0


LAYOUTS = {
    "iso": lambda d: d.isoformat(),
    "dots": lambda d: f"{d.day:02}.{d.month:02}.{d.year}",
    "bare dots": lambda d: f"{d.day}.{d.month}.{d.year}",
    "month first": lambda d: f"{d.month:02}/{d.day:02}/{d.year}",
    "bare month first": lambda d: f"{d.month}/{d.day}/{d.year}",
    "mixed": lambda d: f"{d.month:02}/{d.day}/{d.year}",
    "day first": lambda d: f"{d.day:02}/{d.month:02}/{d.year}" if d.day > 12 else None,
    "bare day first": lambda d: f"{d.day}/{d.month}/{d.year}" if d.day > 12 else None,
}


def date_of(text, layout):
    a, b, c = map(int, re.split("[-./]", text))
    return datetime.date(*((a, b, c) if layout == "iso" else (c, b, a) if "dots" in layout or "day" in layout else (c, a, b)))


def test_dates_of_every_layout_are_permuted_and_restored(docs_of):
    """2000 days in each layout: one pseudonym per date whatever its layout, no two alike, and the way back."""
    days = [datetime.date(1998, 12, 1) + datetime.timedelta(n) for n in range(2000)]
    days += [datetime.date(y, m, 28) for y in (1850, 1900, 2024, 2177) for m in range(1, 13)]
    texts = {name: [show(d) for d in days if show(d)] for name, show in LAYOUTS.items()}
    docs = docs_of([" ".join(x) for x in texts.values()])
    new = [r.text.split() for r in pseudonymise(docs, KEY).orderBy("doc_id").collect()]
    moved = {}
    for (name, old), got in zip(texts.items(), new):
        assert len(set(got)) == len(set(old)) == len(got)
        for x, y in zip(old, got):
            assert moved.setdefault(date_of(x, name), date_of(y, name)) == date_of(y, name)
    assert len(set(moved.values())) == len(moved) and sum(x == y for x, y in moved.items()) < 20
    back = pseudonymise(docs_of([" ".join(x) for x in new]), KEY, restore=True).orderBy("doc_id").collect()
    assert [r.text.split() for r in back] == list(texts.values())


def test_case_and_national_numbers(docs_of):
    mails = ["John.Doe@x.org", "john.doe@x.org", "JOHN.DOE@X.org", "jane@smith-family.com"]
    secret = "DEADBEEF" * 4
    texts = [*mails, secret, secret.lower(), "call (212) 555-0123 now", "(212)555-0123", "(112) 555-0123"]
    new = changed(docs_of, texts)
    assert len({m.lower() for m in new[:3]}) == 1 and len(set(new[:3])) == 3
    assert new[3].endswith("@smith-family.com") and new[3] != mails[3]
    assert re.fullmatch("[0-9A-F]{32}", new[4]) and new[4].lower() == new[5]
    assert re.fullmatch(r"call \([2-9]\d\d\) [2-9]\d\d-\d{4} now", new[6]) and new[6] != texts[6]
    assert new[7] == new[6][5:-4].replace(") ", ")") and new[8] == texts[8]
    back = pseudonymise(docs_of(new), KEY, restore=True).orderBy("doc_id").collect()
    assert [r.text for r in back] == texts


def feistel(value, sides, kind, key=KEY):
    """The permutation of numbers once more, in plain Python."""
    left, right = divmod(value, sides[1])
    for r in range(8):
        stream = int(hashlib.sha512(f"{key}|{kind}|{r}|{right}".encode()).hexdigest()[:15], 16)
        left, right = right, (left + stream % sides[r % 2]) % sides[r % 2]
    return left * sides[1] + right


def test_equals_the_cipher_in_plain_python(docs_of):
    addresses = [f"{n % 256}.{n * 7 % 256}.{n * 13 % 256}.{n * 31 % 256}" for n in range(1, 60)]
    (new,) = changed(docs_of, [" ".join(addresses)])
    for old, got in zip(addresses, new.split()):
        value = feistel(int.from_bytes(map(int, old.split("."))), (65536, 65536), "ip")
        assert got == ".".join(map(str, value.to_bytes(4)))
    # A date of class: January, 1 to 9, among the five months of 31 days and one digit.
    months, years = [1, 3, 5, 7, 8], range(1850, 2178)
    (new,) = changed(docs_of, ["1999-05-04"])
    value = feistel(((1999 - 1850) * 5 + 2) * 9 + 3, (len(years) * 5, 9), "date|1|328|1")
    month, day = divmod(value, 9)
    assert new == f"{1850 + month // 5}-{months[month % 5]:02}-{day + 1:02}"


def test_repeated_rows_each_get_a_row(spark):
    rows = [(1, "see 2000-01-31"), (1, "see 2000-01-31"), (None, "see 2000-01-31"), (None, None)]
    got = [tuple(r) for r in pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()]
    assert len(got) == 4 and len({text for _, text, n in got if n}) == 1


def test_empty_table(spark):
    assert pseudonymise(spark.createDataFrame([], "doc_id long, text string"), KEY).count() == 0
