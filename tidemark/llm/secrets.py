"""Secret scans (4): zstandard novelty of strings in sensitive contexts.

Candidates are what stands where a secret would: the whole quoted or bare value
that a name such as password or token is given, also behind a type; the part of
a URL before its host; the body of a private key; strings of an issuer's form.
A candidate's novelty is what it adds to the compressed size of the text around
it, divided by its length, with zstandard primed by a dictionary of identifiers:
words, names and repeated values add little, random strings about all their
bytes.  Novel candidates are reported.

The dictionary has identifiers that code has anyway and those that most
documents of the corpus have, counted over all of it.  It holds only names made
of words, so that no random string, however often it was copied, gets in.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, ready
from .words import CHUNK_BYTES, slices, strings

#: Least length of a value that is assigned to a name and of one that only follows it or has an issuer's form, bytes of text around a candidate, and least novelty of a reported one.
ASSIGNED, LENGTH, AROUND, NOVELTY = 8, 16, 256, 0.6
#: Learned identifiers: how many, and in how many documents at least.
LEARNED, LEAST = 1000, 3
IDENTIFIERS = (
    "username password passwd pwd secret token api_key apikey access_key secret_key client_secret client_id auth authorization bearer "
    "credential private_key public_key session cookie signature config configuration default example changeme placeholder your_api_key_here "
    "xxxxxxxxxxxxxxxx 0000000000000000 1234567890123456 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789abcdef "
    "import from return function class public static void const export environment production development staging localhost "
    "application controller repository service manager factory handler listener context request response exception interface "
    "get_current_user set_password reset_token refresh_token access_token token_type expires_in max_length min_length "
    "http:// https:// www. .com .org .net /usr/local/bin /etc/ssl/certs -----BEGIN PRIVATE KEY----- -----END PRIVATE KEY-----"
)
#: Names of several words: snake_case and camelCase without digits.
_IDENTIFIER = r"\b(?:[A-Z]?[a-z]{2,24}|[A-Z]{2,24})(?:_{1,2}(?:[A-Z]?[a-z]{2,24}|[A-Z]{2,24})|[A-Z][a-z]{2,24}){1,8}\b"
#: Between texts, so that nothing is found across two.
_GAP = b"\0\0\0\0"
#: Forms: what each begins with, in lower case where names are, and the rest.
_FORMS = [
    ("private_key", [b"-----BEGIN "], re.compile(rb"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:\s|\\[rn]|[\w-]+: [^\n\0]*\n)*(?P<value>[A-Za-z0-9+/=](?:[A-Za-z0-9+/=\s]|\\[rn])*)")),
    ("issued", [b"AKIA", b"ASIA", b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_", b"xox", b"AIza", b"sk_live_", b"sk-", b"eyJ"], re.compile(rb"(?<![A-Za-z0-9+/_-])(?P<value>(?P<kind>AKIA|ASIA)[0-9A-Z]{16}|(?P<kind1>gh[pousr]_)[0-9A-Za-z]{30,}|(?P<kind2>xox[abpr]-)[0-9A-Za-z-]{10,}|(?P<kind3>AIza)[0-9A-Za-z_-]{35}|(?P<kind4>sk_live_|sk-)[0-9A-Za-z]{16,}|(?P<kind5>eyJ)[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_.-]{10,})(?![A-Za-z0-9+/_])")),
    ("url", [b"://"], re.compile(rb"(?<=[A-Za-z0-9])://[^\s/:@\0\"'<>]*:(?P<value>[^\s/@\0\"'<>]+)@")),
    ("named", [b"pass", b"pwd", b"secret", b"token", b"api", b"access", b"auth", b"bearer", b"credential", b"private", b"client"], re.compile(
        rb"(?P<name>pass(?:word|wd|phrase|code|(?![a-z]))|pwd|secret(?!ar)|token(?!i[sz])|api[_-]?key|access[_-]?key|auth(?!or(?!iz))(?:orization)?|bearer|credentials?|private[_-]?key|client[_-]?secret)"
        rb"[\w-]{0,64}[\"'\]]{0,2}\s{0,3}(?:(?P<sign>(?::\s{0,3}[A-Za-z_][\w\[\], |.]{0,40}\s{0,3}=(?!=)|[:=]{1,2}>?))|\s)\s{0,3}"
        rb"(?:(?P<quote>[\"'`])(?P<value>(?:(?!(?P=quote))[^\n\0])+)(?P=quote)|(?P<bare>[^\s\0\"'`,;<>(){}\[\]]+))", re.I)),
]
#: What is made of words isn't random: names, dotted paths, calls.
_WORDS = re.compile(rb"[$%]?(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}|[._/-])+")
_own: dict = {}


def _compressor(dictionary: bytes):
    if dictionary not in _own:
        import zstandard

        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        _own[dictionary] = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_dict_id=False)
    return _own[dictionary]


def marginal(candidate: bytes, before: bytes, after: bytes, dictionary: bytes = IDENTIFIERS.encode()) -> int:
    """Compressed bytes that the candidate adds to the text around it, from which its other occurrences are taken."""
    c = _compressor(dictionary)
    around = before.replace(candidate, b"") + after.replace(candidate, b"")
    return len(c.compress(around + candidate)) - len(c.compress(around))


def shaped(value: bytes, least: int) -> bool:
    """Long enough, and no word of natural language: a short value has signs of three kinds, a long one digits or capitals within."""
    if len(value) < least or _WORDS.fullmatch(value):
        return False
    kinds = [re.search(x, value) for x in (rb"[a-z]", rb"[A-Z]", rb"\d", rb"[^A-Za-z0-9]")]
    if len(value) < LENGTH:
        return sum(map(bool, kinds)) >= 3
    return bool(kinds[2]) or bool(kinds[0] and re.search(rb"[A-Z]", value[1:]))


def _places(data: bytes, anchors: list[bytes]) -> list[int]:
    out = []
    for a in anchors:
        at = data.find(a)
        while at >= 0:
            out.append(at)
            at = data.find(a, at + 1)
    return sorted(out)


def candidates(data: bytes) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the candidates in texts joined by _GAP; where two overlap, the first of the first form that has one."""
    taken: list[tuple[int, int]] = []
    lower = data.lower()
    for form, anchors, pattern in _FORMS:
        found = []
        at = 0
        for place in _places(lower if form == "named" else data, anchors):
            m = pattern.match(data, place) if place >= at else None
            if m is None:
                continue
            group = "bare" if form == "named" and m["bare"] is not None else "value"
            start, end = m.span(group)
            at = m.end()
            value = data[start:end]
            kind = form
            if form == "named":
                kind = m["name"].decode().lower()
                if group == "bare":
                    value = value.rstrip(b".-/:!?")
                if not shaped(value, ASSIGNED if m["sign"] else LENGTH):
                    # The value may itself be a name, as in Authorization: Bearer.
                    at = max(start, m.end("name"))
                    continue
            elif form == "issued":
                kind = next(v for k, v in m.groupdict().items() if k.startswith("kind") and v).decode()
                value = value.rstrip(b".-")
            elif form == "private_key":
                value = value.rstrip()
            if form in ("url", "private_key") and not shaped(value, ASSIGNED if form == "url" else LENGTH):
                continue
            found.append((start, start + len(value), kind))
        if found:
            begins = [a for a, _ in taken]
            for start, end, kind in found:
                k = bisect_right(begins, start)
                if (k and taken[k - 1][1] > start) or (k < len(taken) and taken[k][0] < end):
                    continue
                yield start, end, kind
            taken = sorted(taken + [(a, b) for a, b, _ in found])


def scan(texts: pa.Array, dictionary: bytes = IDENTIFIERS.encode()) -> Iterator[tuple[int, int, int, str, int, float, str]]:
    """(row, start, end, kind, marginal bytes, novelty, SHA-256) of the secrets in each text, in order; start and end in characters."""
    texts = strings(texts)
    for i, j in slices(texts, CHUNK_BYTES):
        rows = texts.slice(i, j - i).cast(pa.binary()).to_pylist()
        data = _GAP.join(rows)
        begins = [0]
        for r in rows:
            begins.append(begins[-1] + len(r) + len(_GAP))
        for s, e, kind in sorted(candidates(data)):
            row = bisect_right(begins, s) - 1
            lo, hi = begins[row], begins[row + 1] - len(_GAP)
            candidate = data[s:e]
            added = marginal(candidate, data[max(lo, s - AROUND) : s], data[e : min(hi, e + AROUND)], dictionary)
            novelty = added / len(candidate)
            if novelty >= NOVELTY:
                start = len(data[lo:s].decode("utf-8", "replace"))
                yield i + row, start, start + len(candidate.decode("utf-8", "replace")), kind, added, novelty, hashlib.sha256(candidate).hexdigest()


def learn(docs: DataFrame, most: int = LEARNED, least: int = LEAST) -> bytes:
    """The dictionary: the identifiers that most documents have, ties by name, the commonest last."""
    each = narrow(docs).select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_IDENTIFIER), F.lit(0)))).alias("name"))
    top = each.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "name").limit(most)
    return " ".join([*(r["name"] for r in reversed(top.collect())), IDENTIFIERS]).encode()


def secrets(docs: DataFrame, dictionary: bytes | None = None) -> DataFrame:
    """(doc_id, start, end, kind, marginal_bytes, novelty, sha256) of every secret in the whole texts, however long.

    A secret that occurs twice is reported at both places, and in each document
    that has it; the value itself isn't given, equal values have equal hashes.
    Rows without doc_id or text have none, nor do empty texts and tables; rows
    that repeat report theirs each; other columns aren't looked at.
    """
    ready(docs.sparkSession)
    primed = learn(docs) if dictionary is None else dictionary

    def run(batches):
        for b in batches:
            found = list(scan(b.column("text"), primed))
            if found:
                row, *rest = zip(*found)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), *(pa.array(c, k) for c, k in zip(rest, kinds))], ["doc_id", "start", "end", "kind", "marginal_bytes", "novelty", "sha256"])

    return narrow(docs).mapInArrow(run, "doc_id long, start long, end long, kind string, marginal_bytes long, novelty double, sha256 string")
