import pytest

from loomline.llm import pii

TEXTS = ["mail ann.bell@post.example", "jürgen_o'hara [at] x [dot] test or una-lise+notes@x.example", "dorn dot bo at mail dot test"]
PARTS = {p for x in TEXTS for p, _ in pii.name_parts(x)} | {pii.fold(w) for w in ("Una-Lise", "O'Hara", "Jürgen")}
NAMES = pii.Names(pii.Parts(PARTS, len(PARTS)))


def kinds(text):
    return [(s.kind, text[s.start : s.end]) for s in pii.find(text, NAMES)]


@pytest.mark.parametrize("text", ["a.b+c@x-y.example", "A_B@X.TEST", "ab [at] x [dot] test", "ann dot bell at mail dot example", "ann underscore b at um post dot x dot test", "mailto:a@b.example", "<a@b.example>"])
def test_emails(text):
    assert [k for k, _ in kinds(f"Write to {text} please")] == ["email"]


@pytest.mark.parametrize("text", ["+1 555 555 0133", "+1-555-555-0150", "(555) 555-0100", "555.555.0184", "555-0171", "+44 7700 900581", "+447700900193", "07700 900 514", "020 7946 0749", "(020) 79460429", "double five five, oh one uh six three", "plus four four seven seven oh oh, nine oh oh nine seven one"])
def test_phones(text):
    assert [k for k, _ in kinds(f"Call me on {text} today")] == ["phone"]


@pytest.mark.parametrize("text", ["passport no. Q31837251", "passport x six seven one zero three oh nine", "driving licence ZZ-7412-8694", "tax ID 00-7201133", "social security number 997825345", "934-57-8542", "QQ 13 56 89 B", "insurance number q one two double three four five"])
def test_id_numbers(text):
    assert [k for k, _ in kinds(f"It says {text} there")] == ["id_number"]


@pytest.mark.parametrize("text", ["46 Miller's Cross Lane, 20245 Gristholm", "197 Tannery Ave", "Flat 11, 117 Lantern Road, Gristholm", "Calle Lantern 180c", "Juniperstraße 156", "25, Saltmarket Avenue", "sixty-six harrow gate street", "_175 Miller's Cross St_"])
def test_addresses(text):
    assert [k for k, _ in kinds(f"She lives at {text} now.")] == ["address"]


@pytest.mark.parametrize("text", ["Ann Bell", "ann bell", "ANN BELL", "Bell, Ann", "Ann K. Bell", "Mr Tiller", "Dr. Bo Dorn", "Una-Lise O'Hara", "Jürgen Bell", "Ann um, Bell"])
def test_names(text):
    found = kinds(f"I spoke with {text} about it")
    assert [k for k, _ in found] == ["name"]


@pytest.mark.parametrize(
    "text",
    ["Room 12 on Lantern Street was too small.", "The ticket is 7700-900-12-B here.", "The split was 20 40 60 80 over days.", "We are on version 10.4.2.1 now.", "Press 5 5 5 on it.", "Invoice INV-2291-004 is open.", "Mention @design here.", "Meet me at the dot on the map.", "We counted one two three four and started.", "The reference is 2024-0611-77.", "The file is notes-2024-555.md.", "Lantern Street Choir sings at 7.", "Ann was here.", "The Ann Bell Bridge was closed.", "Order 900 was cancelled, order 901 was not.", "", "x" * 50_000],
)
def test_nothing_there(text):
    assert kinds(text) == []


def test_checks():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    assert pii.check_letter("12345678Z") and not pii.check_letter("12345678A") and pii.check_letter("X1234567L")
    assert pii.check_eleven("86095742719") and not pii.check_eleven("86095742710")
    assert pii.spoken_digits("double five, oh one") == "5501"


def test_accounts_and_cards_are_no_phones():
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 is ours, call 555-0171") == [("phone", "555-0171")]
    assert kinds("pay with 4539 5787 6362 1486 or +1 555 555 0133") == [("phone", "+1 555 555 0133")]
    assert kinds("passport number 4539578763621") == [("id_number", "4539578763621")]


def test_the_filter_errs_once_in_a_million():
    parts = pii.Parts((f"name{i}" for i in range(20_000)), 20_000)
    assert all(f"name{i}" in parts for i in range(20_000)) and sum(f"word{i}" in parts for i in range(100_000)) <= 2
    with pytest.raises(ValueError):
        pii.Parts([], pii.MAX_PARTS + 1)


def test_long_texts_are_searched_whole():
    one = "Ann Bell, ann.bell@post.example or 555-0171 at 46 Miller's Cross Lane, and on. "
    text = one * 500
    found = [s.kind for s in pii.find(text, NAMES)]
    assert found == [s.kind for s in pii.find(one, NAMES)] * 500 and {text[s.start : s.end] for s in pii.find(text, NAMES) if s.kind == "name"} == {"Ann Bell"}
    assert {p for p, _ in pii.name_parts(text)} == {"ann", "bell", "annbell"} and sum(1 for w, m, _ in pii.uses(text, NAMES) if m) == 1000


@pytest.mark.parametrize("text", ["dot at " * 4000, "a dot " * 4000 + "at x dot com", "one " * 6000, "0 " * 20_000, "12 a b c street " * 2000, "calle de la " * 3000 + "12", "twenty " * 4000 + "street", "[at] " * 6000 + "[dot] x", "tax id 1 " * 3000, "x" * 50_000])
def test_hostile_texts_end(text):
    assert isinstance(pii.find(text, NAMES), list) and isinstance(list(pii.name_parts(text)), list) and isinstance(list(pii.uses(text + " A a", NAMES)), list)


def test_role_accounts_teach_no_names(spark):
    role = ["support@firm.example", "team@firm.example", "data.science@firm.example", "Ada Roe", "jane.roe (at) example (dot) org", "mick.hollis@firm.example"]
    said = ["Ask our support team about it.", "The data science meeting is at noon.", "Then Jane Roe called, and Mick came.", "They said jane roe called.", "We asked mick hollis again."]
    df = spark.createDataFrame([(f"Write to {x} today", "") for x in role] + [(x, "") for x in said], "x string, part string")
    got = {r.x: r.redacted for r in pii.scan(df, "x", pii.learn_names(df, "x")).collect()}
    assert [got[x] for x in said] == ["Ask our support team about it.", "The data science meeting is at noon.", "Then [NAME] called, and Mick came.", "They said [NAME] called.", "We asked [NAME] again."]
    low = spark.createDataFrame([("our support team has the data science meeting", ""), *[(f"Write to {x} today", "") for x in role[:3]]], "x string, part string")
    assert pii.scan(low, "x", pii.learn_names(low, "x")).filter("x LIKE 'our%'").first().redacted == "our support team has the data science meeting"


def test_readable_result(spark):
    df = spark.createDataFrame([("1", "Ask Ann Bell, ann.bell@post.example or 555-0171.", "s"), ("2", None, "t"), ("3", "", None)], "spans_ string, x string, c0 string")
    bits = pii.learn_names(df, "x", spark.createDataFrame([("Cy Dane",), (None,)], "name string"))
    got = {r.spans_: r for r in pii.scan(df, "x", bits).collect()}
    assert got["1"].redacted == "Ask [NAME], [EMAIL] or [PHONE]." and got["2"].redacted is None and got["3"].spans == []
    assert pii.scan(df.limit(0), "x", bits).count() == 0
    found = pii.scan(df, "x", bits, only_found=True)
    assert found.columns == ["spans_", "c0", "spans"] and [(r.spans_, [x.kind for x in r.spans]) for r in found.collect()] == [("1", ["name", "email", "phone"])]
