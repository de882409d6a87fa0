"""Secrets without digits, of several parts, and before the word that makes them sensitive."""

import random
import string

import pytest

from sievewright.llm import secret_scan

WORDS = """the of and to in that was it for on with as his they at be this from had by word but what some we can out other were
all there when up use your how said an each she which do their time if will way about many then them write would like so these
her long make thing see him two has look more day could go come did number sound no most people my over know water than call
first who may down side been now find any new work part take get place made live where after back little only round man year
came show every good me give our under name very through just form sentence great think say help low line differ turn cause""".split()
PROSE = " ".join(random.Random(0).choices(WORDS, k=300)) + "."
BASE64 = string.ascii_letters + string.digits + "+/"


def found(text):
    spans = secret_scan.spans_of(text, secret_scan.Novelty())
    return [text[a:b] for kind, a, b, _ in spans if kind == "novel"], secret_scan.redacted(text, spans)


def test_letters_alone():
    rng = random.Random(1)
    keys = ["".join(rng.choices(string.ascii_letters, k=24)) for _ in range(40)]
    assert sum(found(f"{PROSE}The bearer is {k} here. {PROSE}")[0] == [k] for k in keys) >= 38
    for name in ("authenticationProviderConfiguration", "internationalization", "session_storage_configuration", "getElementByIdentifier"):
        assert found(f"{PROSE}The bearer is {name} here. {PROSE}")[0] == []


@pytest.mark.parametrize("join", ["\n", "\r\n", "\n    ", "\\"])
def test_pem_key(join):
    rng = random.Random(2)
    lines = ["".join(rng.choices(BASE64, k=64)) for _ in range(24)] + ["Zk3+aQ=="]
    got, clean = found(f"{PROSE}\n-----BEGIN RSA PRIVATE KEY-----{join}{join.join(lines)}{join}-----END RSA PRIVATE KEY-----\n{PROSE}")
    assert got == lines and not any(x in clean for x in lines) and clean.count(PROSE) == 2


def test_token_of_three_parts():
    rng = random.Random(3)
    parts = ["".join(rng.choices(BASE64, k=n)) for n in (36, 90, 43)]
    assert found(f"{PROSE}Authorization: Bearer {'.'.join(parts)} {PROSE}")[0] == parts


def test_word_after_the_string():
    rng = random.Random(4)
    key = "".join(rng.choices(BASE64[:62], k=32))
    assert found(f"{PROSE}{key} is the password. {PROSE}")[0] == [key]
    assert found(f"{PROSE}{key} is what they said long ago when nobody asked for a password. {PROSE}")[0] == []


def test_each_candidate_once():
    rng = random.Random(5)
    key, other = ("".join(rng.choices(BASE64[:62], k=32)) for _ in range(2))
    assert found(f"{PROSE}password {key} token {other} secret {PROSE}")[0] == [key, other]
