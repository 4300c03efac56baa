import re

from pyspark.sql import functions as F

from urbanloom.llm import pseudonyms as ps

HEAD = re.compile(r'\w+\s?[=:]\s?"?')


def images(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", ps.pseudonymised(F.col("t"), "k").alias("p")).collect()
    return [r.p for r in sorted(rows)]


def test_any_case_and_no_digit(spark):
    """Keywords in any case, values with or without digits; capital hexadecimal numbers stay such numbers."""
    texts = ['TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B', "Token: Zz9-Qq8_w7", "API_KEY=abc123def", "password=correcthorsebattery", 'PASSWORD = "correcthorse"']
    for text, p in zip(texts, images(spark, texts), strict=True):
        head = HEAD.match(text)[0]
        assert p.n == 1 and len(p.text) == len(text) and p.text.startswith(head), p
        assert p.text[len(head) :] != text[len(head) :]
    small, capital = images(spark, [texts[0].replace("9233A8ECF7C5B09FE5949719B6B82BC439E9329B", v("9233A8ECF7C5B09FE5949719B6B82BC439E9329B")) for v in (str.lower, str.upper)])
    assert re.fullmatch('TOKEN = "[0-9A-F]{40}', capital.text) and small.text[9:].upper() == capital.text[9:]


def test_values_of_any_length(spark):
    """Nothing of a long value stays, wherever its first digit is, and a change in it changes what is after it."""
    bodies = ["a1B2c3D4" * 40, "a" * 200 + "1", "0123456789abcdef" * 150, "aZ09-" * 5000]
    other = "b" + bodies[3][1:]
    got = images(spark, [f'token = "{b}" end' for b in [*bodies, other]])
    for body, p in zip([*bodies, other], got, strict=True):
        assert p.n == 1 and p.text.startswith('token = "') and p.text.endswith('" end')
        image = p.text[9:-5]
        assert len(image) == len(body)
        for i in range(0, len(body), 100):
            assert len(body[i : i + 100]) < 50 or image[i : i + 100] != body[i : i + 100], i
    assert re.fullmatch("[0-9a-f]+", got[2].text[9:-5])
    for i in range(1024, len(other), 1024):
        assert len(other[i:]) < 50 or got[3].text[9 + i : 9 + i + 1024] != got[4].text[9 + i : 9 + i + 1024]


def test_values_of_any_character_and_prefixed_names(spark):
    """Nothing of a value with marks or letters beyond ASCII stays; equal values have equal images."""
    texts = [
        "password: пароль-секрет", "api_key=漢字漢字漢字漢字", "pwd=!!!###$$$", "access_token=abcdefgh1", "client_secret: abcdefgh1",
        "SECRET_KEY=abcdefgh1", "AUTHTOKEN=abcdefgh1", "pwd=!!!###$$%", "secretary: abcdefgh1", "token = \"" + "é!" * 1500, "API-KEY: p@ss-w0rd/1",
    ]
    got = images(spark, texts)
    for text, p in zip(texts, got, strict=True):
        value = text.rpartition(" ")[2].rpartition("=")[2].strip('"')
        if text.startswith("secretary"):
            assert p.n == 0 and p.text == text
            continue
        image = p.text[len(text) - len(value) :]
        assert p.n == 1 and len(p.text) == len(text) and p.text.startswith(text[: len(text) - len(value)]), p
        assert image.isascii() and sum(a == b for a, b in zip(image, value, strict=True)) < len(value) / 2
    assert got[2].text != got[7].text and images(spark, texts[:3])[2].text == got[2].text
    assert {got[i].text[-9:] for i in (3, 4, 5, 6)} == {got[3].text[-9:]}


def test_mail_names_and_domains(spark):
    texts = ["to josé@example.com.", "to anna@müller.de.", "to anna@example.com."]
    got = images(spark, texts)
    assert all(p.n == 1 for p in got) and got[0].text.endswith("@example.com.") and got[1].text.endswith("@müller.de.")
    assert "jos" not in got[0].text and "anna" not in got[1].text
    assert got[1].text.split("@")[0] == got[2].text.split("@")[0]  # one name, one pseudonym


def test_day_first_dates(spark):
    """A date that only the day-first reading allows becomes another such date, different ones differently."""
    import datetime

    days = [datetime.date(2020, 1, 1) + datetime.timedelta(i) for i in range(0, 730)]
    values = [f"{d:%d/%m/%Y}" for d in days if d.day > 12]
    got = [p.text for p in images(spark, values)]
    assert len(set(got)) == len(values) and sum(a == b for a, b in zip(got, values, strict=True)) < 3
    for x in got:
        assert datetime.datetime.strptime(x, "%d/%m/%Y").day > 12
    assert [p.text for p in images(spark, ["99/99/2020", "31/02/2020", "13/13/2020"])] == ["99/99/2020", "31/02/2020", "13/13/2020"]


def test_account_numbers(spark):
    """International account numbers keep country, places and valid check digits; invalid ones stay."""
    def valid(x):
        x = x.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1

    good = ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "FR1420041010050500013M02606", "DE89370400440532013000"]
    bad = ["DE88370400440532013000", "AB12CDEFGHIJKLMNOPQRS"]
    got = [p.text for p in images(spark, [f"on {x}." for x in good + bad])]
    for x, p in zip(good, got, strict=False):
        image = p[3:-1]
        assert image != x and image[:2] == x[:2] and valid(image) and re.sub(r"\d", "0", re.sub("[A-Z]", "A", image)) == re.sub(r"\d", "0", re.sub("[A-Z]", "A", x))
    assert got[0][3:-1].replace(" ", "") == got[3][3:-1] and got[4:] == [f"on {x}." for x in bad]
