"""How many random strings of each alphabet are found, and how many names made of words are reported."""

import random
import string

import pytest

from sievewright.llm import secret_scan
from tests.llm.test_secret_parts import PROSE, WORDS

ALPHABETS = {
    "base36": string.ascii_lowercase + string.digits, "BASE36": string.ascii_uppercase + string.digits, "base62": string.ascii_letters + string.digits,
    "base64": string.ascii_letters + string.digits + "+/", "letters": string.ascii_letters, "HEX": "0123456789ABCDEF",
}


def reported(text, novelty):
    return [text[a:b] for kind, a, b, _ in secret_scan.spans_of(text, novelty) if kind == "novel"]


@pytest.mark.parametrize("around", ["", PROSE])
@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_recall(alphabet, around):
    novelty, rng, found, n = secret_scan.Novelty(), random.Random(alphabet), 0, 0
    for length in (16, 24, 32, 40, 64):
        for _ in range(40):
            key = "".join(rng.choices(ALPHABETS[alphabet], k=length))
            found += reported(f"{around} bearer header is {key} {around}", novelty) == [key]
            n += 1
    assert found >= 0.9 * n


@pytest.mark.parametrize("around", ["", PROSE])
def test_names_of_words(around):
    novelty, rng, wrong = secret_scan.Novelty(), random.Random(6), 0
    for k in range(300):
        words = rng.sample(WORDS, 5)
        name = ["_".join(words), "-".join(words), "".join(w.capitalize() for w in words), "/".join(words) + "1", "_".join(words).upper()][k % 5]
        wrong += bool(reported(f"{around} bearer header is {name} {around}", novelty))
    assert wrong <= 0.05 * 300


def test_many_spans_in_one_text():
    """Known spans are looked up, not searched, for each candidate."""
    rng = random.Random(7)
    text = " ".join(f'token = "{rng.getrandbits(96):024x}"' for _ in range(4000))
    assert len(secret_scan.spans_of(text, secret_scan.Novelty())) >= 4000
