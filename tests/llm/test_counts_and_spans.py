"""Operators 3, 5, 7, 8 against plain versions."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievewright.llm import decontam, secret_scan, tokencount, url_filter

DOCS = "doc_id long, text string, items string, chunk string, score double"


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "i", "c", 0.5) for k, t in enumerate(texts)], DOCS)


# --- 8: token counts ---

ALPHABET = ["a", "b", " ", "  ", "'", "re", "'re", "'s", "é", "ß", "\n", "\t", "中", "²", "٣", "\x1c", "\x85", "​", "　", "😀", "<|endoftext|>", "<|endof", "1", "99", "__", "!!", "ǅ", "Ⅷ", "é", "the", " the", "ing"]


@pytest.fixture(scope="module")
def bpe():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(public.path("byte_bpe_50k.json"))), tokencount.PrefixCounter(str(public.path("byte_bpe_50k.json")))


def test_prefix_counts_match_the_library(bpe):
    library, counter = bpe

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.sampled_from(ALPHABET), max_size=14).map("".join) | st.text(max_size=20))
    def check(text):
        n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
        assert counter.count(text) == n(text)
        assert counter.prefix_counts(text).tolist() == [n(text[:k]) for k in range(len(text) + 1)]
        cut = counter.truncate(text, 3)
        assert n(cut) <= 3 and all(n(text[:k]) > 3 for k in range(len(cut) + 1, len(text) + 1))

    check()


def test_token_counts(spark, bpe):
    library, _ = bpe
    texts = [None, "", "the end <|endoftext|> x", "the end <|endoftext|> x", "word " * 30000, "aaaa" * 5000]
    rows = tokencount.token_counts(docs(spark, texts), "byte_bpe_50k.json").orderBy("id").collect()
    assert [r["n_tokens"] for r in rows] == [0 if not t else len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [r["n_bytes"] for r in rows] == [len((t or "").encode()) for t in texts]
    cut = tokencount.truncated(docs(spark, texts), "byte_bpe_50k.json", 4).orderBy("doc_id").collect()
    assert cut[0]["text"] is None and cut[2]["text"].startswith("the end") and cut[2]["chunk"] == "c"
    assert tokencount.token_counts(docs(spark, []), "byte_bpe_50k.json").count() == 0


# --- 7: decontamination ---

def brute_hits(items, text, window=10):
    words = decontam.bench_words(text)
    hit, found = [False] * len(words), set()
    for item, t in items:
        w = decontam.bench_words(t)
        size = min(window, len(w))
        for a in range(len(w) - size + 1 if size else 0):
            for k in range(len(words) - size + 1):
                if words[k : k + size] == w[a : a + size]:
                    hit[k : k + size] = [True] * size
                    found.add(item)
    return hit, sorted(found)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=4), st.lists(st.sampled_from("abcd"), max_size=25), st.integers(1, 4))
def test_automaton(items, words, window):
    import numpy as np

    named = [(str(k), " ".join(x)) for k, x in enumerate(items)]
    found = set()
    hit = np.zeros(len(words), dtype=bool)
    decontam.ItemAutomaton([(i, decontam.bench_words(t)) for i, t in named], window).scan(decontam.bench_words(" ".join(words)), hit, found)
    want, names = brute_hits(named, " ".join(words), window)
    assert hit.tolist() == want and sorted(found) == names


def test_contamination(spark):
    item = "One two three, four five six seven eight nine ten eleven!"
    bench = spark.createDataFrame([("10", item), ("9", "short Ünit"), ("8", None), (None, "x y"), ("7", "..."), ("10", item)], "item_id string, text string")
    texts = [None, "", "pre " + item.upper() + " post", "a SHORT ÜnIT b short Ünit c d e f", "one two three four five six seven eight nine", "x y", "long " * 20000 + item]
    want = []
    for t in texts:
        hit, names = brute_hits([("10", item), ("9", "short Ünit")], t)
        want.append((len(hit), sum(hit), names))
    for shard in (100_000, 3):
        rows = decontam.contamination(docs(spark, texts), bench, shard_words=shard).orderBy("id").collect()
        assert [(r["n_words"], r["n_hit"], r["items"]) for r in rows] == want
    kept = {r["doc_id"]: r for r in decontam.decontaminate(docs(spark, texts).withColumn("n_chars", F.length("text").cast("long")), bench).collect()}
    assert set(kept) == {0, 1, 3, 4, 5, 6}  # 2 is mostly the item
    assert kept[6]["text"].strip("! ").endswith("long") and kept[6]["n_chars"] == len(kept[6]["text"]) and kept[4]["text"] == texts[4]
    assert kept[3]["text"] == "a  b  c d e f"
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(docs(spark, texts), empty).agg(F.sum("n_hit")).first()[0] == 0
    assert decontam.contamination(docs(spark, []), bench).count() == 0


# --- 5: secrets ---

def brute_base(text):
    found = []
    word = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", re.I | re.A)
    value = re.compile("[A-Za-z0-9+/_.=-]+")
    at = 0
    while m := word.search(text, at):
        # the key's longest leftmost match, then a value; back off as the pattern would
        whole = re.compile(word.pattern + "(" + value.pattern + ")", re.I | re.A).search(text, at)
        if not whole:
            break
        if len(whole[2]) >= 12:
            found.append(("assign", whole.start(), whole.end()))
        at = whole.end()
    for kind, pattern, least in (("access", "AKIA[A-Z0-9]+", 18), ("hex", "[0-9a-f]+", 16)):
        found += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return sorted(found, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "Token", "api_key", "APIKEY", "ſecret", '"', "'", " ", ":", "=", "abcdef0123456789", "AKIA", "ABCDEFGH12345678", "x", "é", "0", "secret", "\n"]), max_size=15).map("".join))
def test_base_spans(text):
    assert sorted(secret_scan.base_spans(text), key=lambda s: (s[1], secret_scan.KINDS.index(s[0]))) == brute_base(text)


def test_novelty(spark):
    rng = random.Random(5)
    key = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=32))
    prose = "the quick brown fox jumps over a lazy dog and runs through the forest until it is dark again. " * 6
    texts = [None, "", f"{prose}The bearer header is {key} here. {prose}", f"{prose}The bearer header is authentication_token_validator22 here. {prose}", f"{prose}A code {key} without context. {prose}", 'password = "abcdefghijklmn"', "x" * 200_000]
    rows = secret_scan.scan(docs(spark, texts)).orderBy("id").collect()
    assert [[(s["kind"], texts[k][s["start"] : s["end"]]) for s in r["spans"]] for k, r in enumerate(rows)] == [[], [], [("novel", key)], [], [], [("assign", 'password = "abcdefghijklmn')], []]
    clean = secret_scan.redact(docs(spark, texts)).orderBy("doc_id").collect()
    assert key not in clean[2]["text"] and "[SECRET]" in clean[2]["text"] and clean[3]["text"] == texts[3] and clean[0]["text"] is None and len(clean) == len(texts)


# --- 3: URLs ---

def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest, re.S)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :], re.S)[0]


URLS = [None, "", "nothing", "http://Example.ORG/es/1", "https://a.example.org/es", "http://example.org/en/12?x#y", "http://x.org", "http://x.org/", "http://notexample.org/es/2", "http://y.com/fr/1", "http://y.com/de/1", "http://com/fr/", "http://z.net/a?b", "http://ÄB.net/\n/x#f", "http://k.net#/p", "a://b://c/d"]


def test_url_parts_and_rules(spark):
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(URLS)], "page_id long, url string, host string")
    rows = url_filter.filter_urls(pages).orderBy("id").collect()
    assert [(r["host"], r["path"]) for r in rows] == [brute_url(u) for u in URLS]
    rules = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    for r in rows:
        fits = [x for x in rules if (lambda h, p: (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith("/" + p))(*x.split("/", 1))]
        best = max(fits, key=len, default=None)
        assert r["rule"] == best and (best is None or r["verdict"] == rules[best]) and r["verdict"] in ("allow", "block")
        assert best or r["verdict"] == ("allow" if r["log_ratio"] >= r["threshold"] else "block")
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_markov_probabilities_sum_to_one():
    m = url_filter.MarkovModel([b"abcab", b"abd", b""], 3)
    for context in (b"", b"a", b"ab", b"zab", b"zzz"):
        assert sum(m.prob(context, s) for s in range(257)) == pytest.approx(1.0)


def test_ratio_separates():
    good, bad = [f"http://news{k}.org/story/{k}".encode() for k in range(80)], [f"http://casino{k}.biz/win/{k}".encode() for k in range(80)]
    m = url_filter.RatioModel(good[::2], bad[::2])
    m.calibrate(good[1::2], bad[1::2])
    assert all(m.ratio(u) >= m.threshold for u in good) and all(m.ratio(u) < m.threshold for u in bad)


def test_digest_of_items_is_of_sorted_strings(spark):
    bench = spark.createDataFrame([(10, "aa bb"), (9, "bb cc")], "item_id long, text string")
    row = decontam.contamination(docs(spark, ["aa bb cc"]), bench).select(F.sha2(F.concat_ws(",", "items"), 256).alias("h")).first()
    assert row["h"] == hashlib.sha256(b"10,9").hexdigest()
