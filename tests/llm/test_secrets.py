"""Values in credential contexts that have no digit, or that follow a second key."""

import itertools
import math
import time

import pytest

from handbill.llm import secrets


def guesses(text):
    return [text[a:b] for kind, a, b in secrets.scan(text) if kind == "guess"]


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("pwd=kqzvxwpjfhtm", "kqzvxwpjfhtm"),
        ("passphrase: kf$qz!vw#xptm", "kf$qz!vw#xptm"),
        ("secret passphrase: Xk93$vTq2zR", "Xk93$vTq2zR"),
        ("secret: passphrase: Xk93$vTq2zR", "Xk93$vTq2zR"),
        ("the token is password=Xk93$vTq2zR", "Xk93$vTq2zR"),
        ("bearer qzxvkwpjfhtmbl", "qzxvkwpjfhtmbl"),
        ("pass: changeme pwd: Xk93$vTq2zR", "Xk93$vTq2zR"),
        ("password is gukozemiravopu", "gukozemiravopu"),
        ("bearer kezuvoxapilomeduri", "kezuvoxapilomeduri"),
    ],
)
def test_value_is_found(text, value):
    assert guesses(text) == [value]


def test_prose_is_left_alone():
    assert not guesses("a secret bandwagon, the token kangaroos; pass legislation")
    assert not guesses("a secret ingredient, the token embeddings and the bearer certificates; the password is required here")


@pytest.mark.parametrize("value", ["getElementById2", "UserAccountManager", "ConfigurationService", "Thursday-meeting2", "changeme2024", "qwertyuiopasdfghjkl", "abcdefghijkl" * 30])
def test_names_dates_walks_and_repeats_are_left_alone(value):
    assert not guesses(f"token: {value}")


def brute_cost(value):
    """The least cost over all ways to cut a value, each piece costed by itself from the definitions."""

    def one(piece):
        low, costs = piece.lower(), [math.log10(secrets.alphabet(piece))] if len(piece) == 1 else []
        plain = low.translate(secrets.LEET)
        for form in (plain, low):
            if len(piece) >= 2 and form in secrets.WORDS:
                costs.append(math.log10(secrets.WORDS[form] + 1) + secrets.case_cost(piece) + 0.7 * (low != plain))
        costs += [cost for pattern, cost in secrets.DATES if pattern.fullmatch(piece)]
        if len(piece) >= 3 and all(b in secrets.BESIDE.get(a, ()) for a, b in zip(low, low[1:])):
            costs.append(math.log10(len(secrets.BESIDE) * len(piece)) + 0.1 * len(piece))
        for unit in range(1, len(piece) // 2 + 1):
            times = len(piece) // unit
            if piece == piece[:unit] * times and times >= (3 if unit == 1 else 2):
                costs.append(brute_cost(piece[:unit]) + math.log10(times))
        return min(costs, default=math.inf)

    return min(
        sum(one(value[a:b]) for a, b in zip((0, *cuts), (*cuts, len(value))))
        for k in range(len(value))
        for cuts in itertools.combinations(range(1, len(value)), k)
    )


@pytest.mark.parametrize("value", ["monkey1999", "Dragon77x", "abcabcabc!", "x1y2z3", "p4ssw0rd!!!", "qwe123qwe123", "20240131aaa", "zxcvbzxcvb", "Secretsecret", "ababababcc"])
def test_guess_cost_against_all_segmentations(value):
    assert secrets.guess_cost(value) == pytest.approx(brute_cost(value))


def test_long_values_are_costed_whole():
    assert secrets.guess_cost("a" * 5000 + "b") < 7
    assert secrets.guess_cost("".join(map(chr, range(0x4E00, 0x4E00 + 300))) * 2) > 500
    assert secrets.guess_cost("kqzvxwpjhgtymnbrd") > 10
    value = "".join(chr(97 + i * i * 7 % 26) for i in range(100_000))
    assert secrets.scan(f"secret={value}")[-1] == ("guess", 7, 100_007)


@pytest.mark.parametrize("value", ["!@$%^&*", "k#9$x!", "Zq7#vT2!kf"])
def test_short_values_are_costed(value):
    assert bool(guesses(f"pwd={value}")) == (secrets.guess_cost(value) >= secrets.GUESSES)
    assert guesses("pwd=!@$%^&*") == ["!@$%^&*"]


def test_hostile_texts_take_linear_time():
    """Each value is costed once, however many keys its run holds; keys are looked for once."""
    for text in ("pass:x" * 20_000, "pass:k7Q#" * 10_000, "token: " + "ab1" * 30_000, "password=password=" * 5_000, "pass" + " " * 100_000 + "pass:", "secret=" + "qw" * 40_000, "://a:" * 20_000):
        began = time.process_time()
        secrets.scan(text)
        assert time.process_time() - began < 20, text[:20]


def test_a_later_key_in_the_run_of_a_cheap_value_is_found():
    assert guesses("pass:changeme;pwd:Xk93$vTq2zR") == ["Xk93$vTq2zR"]
    assert guesses("token=aaaa/password=Xk93$vTq2zR")[-1].endswith("Xk93$vTq2zR")
    costs = secrets.suffix_costs("monkey1999aaaaaZq7", secrets.WORDS, max(map(len, secrets.WORDS)))
    assert all(c == pytest.approx(brute_cost("monkey1999aaaaaZq7"[i:])) for i, c in enumerate(costs[:-1]) if i > 4)


def test_a_unit_is_known_whatever_the_length_of_the_value():
    """Repeats of one unit cost the same shape at every size: a switch by length would show here."""
    unit = "kqzvxwpjhgtymnbrd7Q#" * 3
    costs = [secrets.guess_cost(unit * n) - math.log10(n * 3) for n in (1, 2, 4, 5, 9, 30)]
    assert max(costs) - min(costs) < 1e-9


def test_words_of_the_corpus_are_no_secrets(spark):
    rows = [(i, f"note {i}: zyxgarten und qvwkessel stehen hier") for i in range(8)] + [(100, "passphrase: zyxgartenqvwkessel"), (101, "passphrase: kqzvxwpjhgtymnbrd"), (None, None)]
    rows += [(200 + i, "copies of one text hold mnbkqzwxvjp") for i in range(9)] + [(300, "pwd=mnbkqzwxvjp")]
    got = {r.doc_id: [s.kind for s in r.spans] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == [] and got[101] == ["guess"] and got[300] == ["guess"] and got[None] == []
