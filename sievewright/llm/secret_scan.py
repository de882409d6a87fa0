"""Secret scan: fixed patterns, and strings whose marginal compressed size shows that nothing around predicts them."""

from __future__ import annotations

import bisect
import random
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import texts_of

KINDS = ("assign", "access", "hex", "novel")

# The base patterns, each with the group whose length counts and its least length.
_CASED = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key")) + ")"
BASE = {
    "assign": (re.compile(_CASED + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]{16,}"), 0, 16),
}

#: A candidate of the method: letters and digits of secrets, of a length that words seldom have.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: What makes the text before a candidate sensitive; any case.
SENSITIVE = re.compile(r"(?i:passphrase|password|passwd|pwd|secret|token|api.?key|access.?key|private.?key|auth|bearer|credential|signature|client.?id|session|cookie|ssh-(?:rsa|ed25519))")
#: What parts the lines or sections of one string: blanks, dots, quotes and the like, or a plus of string constants.
JOIN = re.compile(r"[^A-Za-z0-9+/_=-]{1,40}(?:\+[^A-Za-z0-9+/_=-]{1,40})?")
#: The last line of a PEM block, if it is too short for a candidate.
PEM_TAIL = re.compile(r"[^A-Za-z0-9+/_=-]{1,40}([A-Za-z0-9+/=]{1,15})(?=[^A-Za-z0-9+/_=-]{1,40}-----END)")
#: Characters between a candidate and a sensitive word before or after it, and around it that compression may draw on.
CONTEXT, SURROUNDING = 40, 512
#: Share of a random string's marginal compressed bytes from which a candidate is reported; the same for further parts of
#: a reported string; and for strings of letters of one case alone, since words of any language come near random ones.
NOVELTY, CARRIED, LETTERS = 0.85, 0.8, 1.06
#: Random strings of a candidate's length and alphabet that it is held against.
REFERENCES = 3

#: Stands before a candidate whose surroundings are short, so that letters have the frequencies of ordinary text.
PLAIN = (
    "When the weather turned we walked along the river, past the old mill and the market where farmers sell bread, apples and "
    "cheese. Most people here know each other by name; children play until late, and somebody always has a story about the great "
    "flood. Le soir, les voisins se parlent devant leurs maisons et regardent passer les bateaux. Am Morgen ist es still, nur die "
    "Hunde bellen. Nothing much happens, yet every year brings a few guests who ask for directions, buy a map, and stay longer than "
    "they had planned.\n"
)

#: What code and configuration are full of; it primes the compressor, so that such strings cost few bytes.
IDENTIFIERS = " ".join(
    """access_token accessToken account address algorithm append application argument arguments array assert async attribute
    authenticate authentication authorization authorizationHeader base64 begin boolean branch buffer build bytes callback
    certificate character charset class client client_id client_secret clientSecret close cluster code column command commit
    company compile config configuration connect connection connectionString console const constructor container content
    context continue control controller cookie copyright count create created credential credentials current customer data
    database dataset date debug decode default delete description destination development device directory disabled document
    domain driver element email enabled encode encoding encrypt encryption endpoint engine entity environment error event
    example exception execute export expression extends extension factory false field file filename filter final finally
    float format function generate getElementById github global group handle handler hash header headers helper hostname
    html http https identifier identity implements import include index information init initialize input insert instance
    integer interface internal iterator java javascript json kernel key keyword lambda language length library license line
    link list listener load local localhost location logger login machine manager manifest master memory message metadata
    method middleware migration mode model module monitor mutable name namespace network node null number object offset
    option options order output override package page parameter parameters parent parse parser partition password path
    pattern payload permission pipeline placeholder platform plugin pointer policy port position prefix print private
    privateKey process processor production profile program project property protected protocol provider proxy public
    publicKey python query queue random range reader receive record redirect reference refresh_token refreshToken region
    register registry release remote remove render replace repository request require required reset resource response
    restore result return role root route router runtime sample schema schedule scheduler scope script search secret
    secret_key secretKey section security select self sequence serial serialize server service session sessionId setting
    settings setup signature simple size snapshot socket source spark split stack standard start state static status
    storage stream string struct structure style subject submit subscribe success suffix summary super switch symbol system
    table target task template temporary terminal test text thread throw time timeout timestamp title token tokenizer
    transaction transform true type undefined union unique unit update upload user user_id username utils valid validate
    validation value variable vector verify version view virtual visible void volume warning webhook widget window worker
    workspace wrapper write writer yield your_api_key_here changeme placeholder xxxxxxxxxxxxxxxx 0123456789abcdef
    0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ""".split()
).encode()

_LOWER, _UPPER, _DIGITS, _HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base pattern that are long enough, in code points."""
    return [(kind, m.start(), m.end()) for kind, (pattern, group, least) in BASE.items() for m in pattern.finditer(text) if len(m[group]) >= least]


class Novelty:
    """Marginal compressed bytes of strings, given what stands around them and an identifier dictionary, against random ones."""

    def __init__(self, identifiers: bytes = IDENTIFIERS) -> None:
        primer = zstandard.ZstdCompressionDict(identifiers, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.pack = zstandard.ZstdCompressor(level=19, dict_data=primer, write_content_size=False, write_checksum=False, write_dict_id=False)

    def _size(self, text: str) -> int:
        return len(self.pack.compress(text.encode("utf-8", "replace")))

    def ratio(self, candidate: str, before: str, after: str) -> float:
        """Marginal compressed bytes of the candidate over those of random strings of its length and alphabet there.

        Marginal bytes are the compressed size of the surroundings with a string less that without it. What the
        dictionary or the surroundings hold costs next to nothing; a new word costs what its letters cost in such
        text; a random string costs what any of its alphabet does. Capitals alone are measured as small letters.
        """
        if candidate == candidate.upper():
            candidate = candidate.lower()
        if len(before) + len(after) < SURROUNDING:
            before = PLAIN + before
        least = self._size(before + after)
        others = [self._size(before + x + after) - least for x in references(candidate)]
        return max(0, self._size(before + candidate + after) - least) * len(others) / max(1, sum(others))


def references(candidate: str, n: int = REFERENCES) -> list[str]:
    """Random strings, the same ones for candidates of one length and alphabet."""
    kinds = [any(c in kind for c in candidate) for kind in (_LOWER, _UPPER, _DIGITS)]
    alphabet = "".join(kind for kind, there in zip((_LOWER, _UPPER, _DIGITS), kinds, strict=True) if there)
    if kinds == [True, False, True] and all(c in _HEX for c in candidate):
        alphabet = _HEX
    rng = random.Random(f"{len(candidate)} {alphabet}")
    return ["".join(rng.choices(alphabet or "+/_=-", k=len(candidate))) for _ in range(n)]


def bar_of(candidate: str, least: float = NOVELTY) -> float:
    """What ratio a candidate needs: letters of one case alone need more."""
    letters = [c for c in candidate if c.isalpha()]
    one_case = not any(c.isdigit() for c in candidate) and (candidate == candidate.lower() or candidate == candidate.upper())
    return max(least, LETTERS) if letters and one_case else least


def _runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Candidates in a sensitive context, each once, those that are parts of one string together.

    A candidate counts if a sensitive word stands within CONTEXT characters before or after it, or if only JOIN
    parts it from one that counts.
    """
    done, back, size = 0, "", len(text)
    for word in SENSITIVE.finditer(text):
        back = back or text[::-1]
        # before the word on the reversed text, so the nearest comes first
        before = [(size - b, size - a) for a, b in reversed(_near(back, size - word.start(), size - done))]
        after = _near(text, max(word.end(), done), size, word.end())
        for side in (before, after):
            run: list[tuple[int, int]] = []
            for a, b in side:
                if run and not JOIN.fullmatch(text, run[-1][1], a):
                    yield run
                    run = []
                run.append((a, b))
                done = max(done, b)
            if run:
                yield run


def _near(text: str, at: int, end: int, place: int | None = None) -> list[tuple[int, int]]:
    """Candidates from `at` that start within CONTEXT of `place`, and those that JOIN alone parts from them."""
    last = min(end, (at if place is None else place) + CONTEXT)
    found: list[tuple[int, int]] = []
    while at <= last and (m := CANDIDATE.search(text, at, min(end, last + 16))):
        while m:
            m = CANDIDATE.match(text, m.start(), end)
            at = m.end()
            found.append((m.start(), at))
            gap = JOIN.match(text, at, end)
            m = gap and CANDIDATE.match(text, gap.end(), end)
    return found


def novel_spans(text: str, known: list[Span], novelty: Novelty, least: float = NOVELTY) -> list[tuple[int, int, float]]:
    """Candidates in a sensitive context, apart from known spans, whose novelty reaches their bar.

    Parts of one string are measured against what stands around all of them, since random lines beside it would
    make a random line look ordinary; beside a reported part CARRIED is enough. A shorter last line of a PEM block goes with a reported line before it.
    """
    found = []
    covered: list[tuple[int, int]] = []  # the known spans as disjoint ones, in order
    for _, a, b in sorted(known, key=lambda k: k[1:]):
        if covered and a <= covered[-1][1]:
            covered[-1] = (covered[-1][0], max(b, covered[-1][1]))
        else:
            covered.append((a, b))
    starts = [a for a, _ in covered]

    def free(a: int, b: int) -> bool:
        k = bisect.bisect_left(starts, b) - 1
        return k < 0 or covered[k][1] <= a

    for run in _runs(text):
        before, after = text[max(0, run[0][0] - SURROUNDING) : run[0][0]], text[run[-1][1] : run[-1][1] + SURROUNDING]
        parts = [(a, b) for a, b in run if free(a, b)]
        values = [novelty.ratio(text[a:b], before, after) for a, b in parts]
        sure = any(v >= bar_of(text[a:b], least) for (a, b), v in zip(parts, values, strict=True))
        for (a, b), value in zip(parts, values, strict=True):
            if value >= (min(least, CARRIED) if sure else bar_of(text[a:b], least)):
                found.append((a, b, value))
                if (a, b) == run[-1] and (tail := PEM_TAIL.match(text, b)):
                    found.append((*tail.span(1), value))
    return found


def spans_of(text: str | None, novelty: Novelty, least: float = NOVELTY) -> list[tuple[str, int, int, float | None]]:
    """All spans by start and then kind; novel ones with their novelty (see Novelty.ratio)."""
    if not text:
        return []
    base = base_spans(text)
    found = [(*s, None) for s in base] + [("novel", *s) for s in novel_spans(text, base, novelty, least)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


_SPANS = "array<struct<kind:string,start:int,end:int,novelty:double>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.float64())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = NOVELTY) -> DataFrame:
    """Rows (id, spans) of all whole texts; a null or clean text has no spans. Repeated rows stay."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "novelty"), s, strict=True)) for s in spans_of(x, novelty, least)] for x in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW)], ["id", "spans"])

    chosen = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")
    return chosen.mapInArrow(run, f"id {kind}, spans {_SPANS}")


def redacted(text: str, spans: list, mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by the mark; of an assignment its name goes too."""
    out, at = [], 0
    for _, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[SECRET]", least: float = NOVELTY) -> DataFrame:
    """The documents, of the same columns and rows, with their secrets replaced; `length_col` is counted anew there."""
    counted = length_col if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            found = [spans_of(x, novelty, least) for x in texts]
            if any(found):
                texts = [redacted(x, s, mark) if s else x for x, s in zip(texts, found, strict=True)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
                if counted:
                    k = batch.schema.get_field_index(counted)
                    lengths = [len(x) if s else n for x, s, n in zip(texts, found, batch.column(k).to_pylist(), strict=True)]
                    batch = batch.set_column(k, batch.schema.field(k), pa.array(lengths, batch.schema.field(k).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
