"""No surrogate equals its original, in any script or language."""

from loomgraph.llm import pii

KEY = b"a key of the user's own"


def test_first_names_are_deranged():
    for names in pii.NAMES.values():
        got = [pii.surrogate(x, "name", KEY) for x in names]
        assert sorted(got) == sorted(names) and all(a != b for a, b in zip(names, got))
    assert sorted(pii.derange(i, 300, KEY, "t") for i in range(300)) == list(range(300))


def test_every_letter_changes_script_wise():
    for name in ("Müßig", "Éluard", "李", "محمد"):
        got = pii.surrogate(name, "name", KEY)
        assert got != name and len(got) == len(name)
    assert len({pii.surrogate(chr(0x4E00 + i), "name", KEY) for i in range(256)}) == 256


def test_names_of_all_languages():
    for text in ("Herr Özil kam.", "Frau Julia Weiß kam.", "Mme Élodie Petit vient.", "Señora Ángela Ruiz"):
        assert [k for k, *_ in pii.replace(text, KEY)[1]] == ["name"]
    assert pii.surrogate("John Smith", "name", KEY).split()[1] == pii.surrogate("Smith", "name", KEY)


def test_patterns_that_cannot_match_are_not_missed():
    """The quick tests give the same entities as all patterns at once, on texts made of pieces that nearly match."""
    import random
    import re

    from loomgraph.llm import pii

    whole = re.compile("|".join(f"(?P<{k}>{p})" for k, p in pii.PATTERNS))
    pieces = ["a@b.de", "token = \"abcdEFGH12\"", "AKIA" + "A1B2" * 4, "f" * 40, "DE44 5001 0517 5407 3249 31", "123-45-6789", "10.0.0.1", "4111 1111 1111 1111", "+49 30 1234567", "(030) 123-4567", "+1 (212) 555-1234",
              "212.555.1234", "Mr. John Smith", "Frau Müller", "M. Le", "12", "1.2", "x = 3", "@", "key", "Sra. Ñandú", "word"]
    rng = random.Random(1)
    for _ in range(3000):
        text = rng.choice(["", " ", "\n"]).join(rng.choice(pieces) + rng.choice(["", " ", ", "]) for _ in range(rng.randint(1, 4)))
        assert [(m.lastgroup, m.span()) for m in pii.entities(text)] == [(m.lastgroup, m.span()) for m in whole.finditer(text)], text


def test_one_number_in_two_notations():
    digits = lambda s: "".join(c for c in s if c.isdigit())
    for kind, a, b in (("phone", "+49 30 1234567", "+4930-1234567"), ("phone", "212.555.1234", "212-555-1234"), ("card", "4111 1111 1111 1111", "4111111111111111"), ("iban", "DE44 5001 0517 5407 3249 31", "DE44500105175407324931")):
        x, y = pii.surrogate(a, kind, KEY), pii.surrogate(b, kind, KEY)
        assert digits(x) == digits(y) != digits(a)
        assert [c for c in x if not c.isalnum()] == [c for c in a if not c.isalnum()]
    assert pii.surrogate("+49 30 1234567", "phone", KEY).startswith("+49 ")
    assert pii.surrogate("+4930 1234567", "phone", KEY).startswith("+49")


def test_check_digits_keep_their_state_and_distinctness():
    rights = lambda n: pii._luhn(n[:-1]) == n[-1]
    cards = [f"41111111111{i:05d}" for i in range(3000)]
    got = [pii.surrogate(c, "card", KEY) for c in cards]
    assert len(set(got)) == len(cards) and [rights(c) for c in cards] == [rights(c) for c in got]
    right = lambda n: pii.iban_check(n) == int(n[2:4])
    ibans = ["GB29NWBK60161331926819", "FR1420041010050500013M02606", *(f"DE{c:02d}5001051754073249{i:02d}" for c in range(100) for i in range(20))]
    got = [pii.surrogate(c, "iban", KEY) for c in ibans]
    assert right(got[0]) and right(got[1]) and got[0][:2] == "GB"
    assert len(set(got)) == len(ibans) and [right(c) for c in ibans] == [right(c) for c in got] and not set(ibans) & set(got[:2])
    ips = [f"{a}.{b}.1.01" for a in (1, 10, 255, 256, 999) for b in range(300)] + [f"{a}.{b}.1.1" for a in (1, 10, 255, 256, 999) for b in range(300)]
    got = [pii.surrogate(x, "ip", KEY) for x in ips]
    assert len(set(got)) == len(ips) and [pii._valid_ip(x) for x in ips] == [pii._valid_ip(x) for x in got]


def test_names_are_followed_through_the_text():
    text = "Mr. John O'Brien met Mme Anne-Laure de Kervella. O'Brien left; Kervella, John's friend, and Smith stayed. Brienne too."
    new, spans = pii.replace(text, KEY)
    assert not any(w in new for w in ("John", "Brien ", "Kervella", "Laure"))
    assert " and Smith stayed" in new and "Brienne" in new and "'s friend" in new and " de " in new
    last = pii.surrogate("Kervella", "name", KEY)
    assert new.count(last) == 2 and last[-1] == "a" and [c in pii.VOWELS for c in last] == [c in pii.VOWELS for c in "Kervella"]
    assert pii.replace("Mr. Smith. The end. Smithy.", KEY)[0].endswith(". The end. Smithy.")
    words = [a + b + c for a in "BCDFG" for b in "aeiou" for c in "lmnrst"]
    assert len({pii.surrogate(w, "name", KEY) for w in words}) == len(words)
    for names in pii.NAMES.values():
        assert len(set(names)) == len(names)
    assert not set(pii.NAMES["f"]) & set(pii.NAMES["m"])


def test_spans_cut_the_text_apart():
    """Replaced spans are in order, do not overlap, and the rest of the text is untouched."""
    import random

    pieces = ["Mr. John Smith", "Smith", "John", "smith@Smith.example.com", "Frau Julia Weiß", "Weiß", "Smith's", "X-Smith", "10.0.0.1", "word", "M. J. Petit"]
    rng = random.Random(2)
    for _ in range(1000):
        text = rng.choice([" ", "\n", ", "]).join(rng.choice(pieces) for _ in range(rng.randint(1, 8)))
        new, spans = pii.replace(text, KEY)
        at, out = 0, []
        for kind, a, b, s in spans:
            assert at <= a < b and s == pii.surrogate(text[a:b], kind, KEY)
            out += [text[at:a], s]
            at = b
        assert new == "".join([*out, text[at:]])
