"""Personal data by weak supervision: emails, IP addresses, card and phone numbers.

One pass over the texts finds candidates: the spans of four strict patterns (the base) and of looser ones (obfuscated
addresses, other notations of numbers). Labelers vote on each candidate: patterns and checksums, gazetteers (top-level
domains, card prefixes, country codes, reserved networks) and words of the context. The votes of the whole corpus are
counted by pattern, a table of bounded size, from which expectation-maximisation estimates each labeler's reliability and
the share of true spans per kind. The posteriors of at most ``SAMPLE`` candidates train a logistic span classifier over
hashed features of shape and context. Spans are the base and what the classifier adds at ``ACCEPT`` or more outside of it.

Defined cases: null and empty texts have no spans; repeated documents get rows of their own; without candidates there is
no model and nothing is added; positions are code points, ends exclusive; very long texts cost their length; an empty table
gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import draw, materialize, table, texts

KINDS = ("email", "ip", "card", "phone")
FEATURES, SAMPLE, ACCEPT = 1 << 12, 20_000, 0.9
LABELERS = 6
YES, NO, ABSTAIN = 1, 0, 2

# Possessive forms of the base patterns: they match the same spans, in linear time.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[\[(]at[\])]|[\[(]dot[\])]", re.I)
_LOOSE = {
    "email": re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}(?:@|[\x20]?[\[(]at[\])][\x20]?)[\w-]{1,63}(?:(?:\.|[\x20]?[\[(]dot[\])][\x20]?)[\w-]{1,63}){1,8}", re.I),
    "ip": re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){3,7}:?[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}([.\x20/-])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z.+-])(?:(?:\+|00)[1-9][0-9]{0,2}[\x20.-]?|0)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z-])"),
}

# Fixed values.
TLDS = {"com", "org", "net", "edu", "gov", "int", "mil", "info", "biz", "io", "co", "uk", "de", "fr", "es", "it", "nl", "ch", "at", "eu", "us", "jp", "cn", "ru", "br", "in", "au", "ca"}
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "38", "30")
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "61", "64", "65", "81", "82", "86", "90", "91")
FOR = {
    "email": {"email", "e-mail", "mail", "contact", "mailto", "write", "reach", "kontakt", "correo", "courriel"},
    "ip": {"ip", "host", "server", "address", "login", "logged", "client", "remote", "adresse"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta", "pay", "paid"},
    "phone": {"phone", "call", "tel", "telephone", "fax", "mobile", "cell", "telefon", "téléphone", "teléfono"},
}
AGAINST = {
    "email": {"npm", "version", "package"},
    "ip": {"version", "v", "release", "section", "chapter", "build"},
    "card": {"order", "isbn", "serial", "id", "token", "key", "hash", "password", "version"},
    "phone": {"isbn", "order", "serial", "id", "token", "key", "hash", "password", "version", "date", "page"},
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def base(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the strict patterns, by kind and start."""
    found, after, at = [], 0, text.find("@")
    while at >= 0:
        start = max(after, at - 1)
        while start >= after and _LOCAL_CHAR(text[start]):
            start -= 1
        start += 1
        if start < at and (m := _DOMAIN.match(text, at)):
            found.append((0, start, m.end()))
            after = m.end()
        at = text.find("@", max(after, at + 1))
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    found += [(2, *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    found += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


_LOCAL_CHAR = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-").__contains__


def votes(kind: int, span: str, left: str, right: str, strict: bool) -> list[int]:
    """One vote of each labeler."""
    name, d = KINDS[kind], _digits(span)
    near = {w.strip(".,;:!?()[]\"'").lower() for w in left.split()[-4:] + right.split()[:2]}
    context = YES if near & FOR[name] else NO if near & AGAINST[name] else ABSTAIN
    bounded = YES if (not left or not left[-1].isalnum()) and (not right or not right[0].isalnum()) else NO
    pattern = YES if strict else NO
    if name == "email":
        host = re.split(r"@|at[\])]", span, flags=re.I)[-1]
        tld = re.split(r"\.|dot[\])]", host, flags=re.I)[-1].strip().lower()
        own = [YES if tld in TLDS else NO, YES if re.match(r"[A-Za-z0-9]", span) else NO, ABSTAIN if "@" in span else YES]
    elif name == "ip":
        parts = span.split(".")
        own = [YES if ":" in span or all(p == "0" or p[:1] != "0" for p in parts) else NO, NO if parts[0] in ("0", "255") else ABSTAIN, YES if ":" in span or all(map(_small, parts)) else NO]
    elif name == "card":
        own = [YES if d.startswith(CARD_PREFIXES) else NO, YES if luhn(d) else NO, YES if len(d) in (15, 16) else ABSTAIN]
    else:
        known = d.lstrip("0").startswith(COUNTRY_CODES)
        own = [YES if span[:1] in "+0(" and known else NO, YES if "(" in span else ABSTAIN, YES if 9 <= len(d) <= 15 else NO]
    return [pattern, context, bounded, *own]


def features(kind: int, span: str, left: str, right: str, vote: list[int]) -> list[int]:
    shape = re.sub("[^\\W\\d_]+", "a", re.sub("[0-9]", "9", span))
    words = [w.lower() for w in left.split()[-2:] + right.split()[:1]]
    names = [f"k{kind}", f"s{kind}:{shape[:24]}", f"n{kind}:{len(_digits(span))}", f"l{kind}:{left[-1:]}", f"r{kind}:{right[:1]}", f"p{kind}:{span[:2]}", f"t{kind}:{span[-3:]}"]
    return sorted({zlib.crc32(x.encode("utf-8", "surrogatepass")) % FEATURES for x in names + [f"w{kind}:{w}" for w in words] + [f"v{kind}:{j}:{v}" for j, v in enumerate(vote) if j]})


def candidates(text: str) -> list[tuple[int, int, int, bool, int, list[int]]]:
    """(kind, start, end, base, vote pattern, features); no loose span overlaps a base span."""
    if not _TRIGGER.search(text):
        return []
    spans = [(k, s, e, True) for k, s, e in base(text)]
    taken = bytearray(len(text))
    for _, s, e, _ in spans:
        taken[s:e] = b"\1" * (e - s)
    for k, name in enumerate(KINDS):
        for m in _LOOSE[name].finditer(text):
            s, e = m.span()
            if taken.find(1, s, e) < 0:
                spans.append((k, s, e, False))
                taken[s:e] = b"\1" * (e - s)
    out = []
    for k, s, e, strict in spans:
        left, right = text[max(0, s - 60) : s], text[e : e + 30]
        code, vote = 0, votes(k, text[s:e], left, right, strict)
        for v in vote:
            code = code * 3 + v
        out.append((k, s, e, strict, code, features(k, text[s:e], left, right, vote)))
    return out


FOUND = "doc_id long, found array<struct<kind:int,start:int,end:int,base:boolean,votes:int,features:array<int>>>"
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32()), ("features", pa.list_(pa.int32()))])
_NAMES = ("kind", "start", "end", "base", "votes", "features")


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [[dict(zip(_NAMES, c)) for c in candidates(t)] for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(_SPAN))], names=["doc_id", "found"])


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, found) per row of docs, written once."""
    return materialize(texts(docs).mapInArrow(_find, FOUND), "spans")


def reliabilities(counts: list[tuple[int, int, int]], rounds: int = 50) -> dict[tuple[int, int], float]:
    """Posterior that a span is true by (kind, vote pattern), by expectation-maximisation over (kind, pattern, count).

    Each labeler has a chance of each vote for true and for false spans; the start trusts the votes' majority.
    """
    out: dict[tuple[int, int], float] = {}
    for kind in {k for k, _, _ in counts}:
        own = sorted((p, n) for k, p, n in counts if k == kind)
        v = np.array([[p // 3**i % 3 for i in range(LABELERS - 1, -1, -1)] for p, _ in own])
        n = np.array([c for _, c in own], float)
        yes, no = (v == YES).sum(axis=1), (v == NO).sum(axis=1)
        q = (yes + 0.5) / (yes + no + 1)
        for _ in range(rounds):
            logit = np.log((q @ n + 1) / ((1 - q) @ n + 1)) * np.ones(len(n))
            for j in range(LABELERS):
                for x in (YES, NO, ABSTAIN):
                    is_x = v[:, j] == x
                    t, f = ((w * n)[is_x].sum() + (2 if x == y else 1) for w, y in ((q, YES), (1 - q, NO)))
                    logit[is_x] += np.log(t / ((q @ n) + 4)) - np.log(f / (((1 - q) @ n) + 4))
            q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        out |= {(kind, p): float(x) for (p, _), x in zip(own, q)}
    return out


def train(examples: list[tuple[list[int], float]], epochs: int = 20, rate: float = 0.5, decay: float = 1e-4, seed: int = 3) -> np.ndarray:
    """Weights of the span classifier, the bias last, by stochastic gradient descent on soft labels."""
    w, rng = np.zeros(FEATURES + 1), np.random.default_rng(seed)
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for i in rng.permutation(len(examples)):
            f, y = examples[i]
            g = 1 / (1 + np.exp(-(w[f].sum() + w[-1]))) - y
            w[f] -= step * (g + decay * w[f])
            w[-1] -= step * 0.1 * g
    return w


def fit(found: DataFrame, sample: int = SAMPLE, seed: int = 3) -> np.ndarray | None:
    """The span classifier: votes are counted over all candidates, at most ``sample`` of them train it."""
    each = found.select("doc_id", F.explode("found").alias("c")).select("doc_id", "c.*")
    counts = [tuple(r) for r in each.groupBy("kind", "votes").count().collect()]  # 4 kinds x 3^6 patterns at most
    if not counts:
        return None
    belief = reliabilities(counts)
    drawn = draw(each.select("doc_id", "kind", "start", "votes", "features"), sample, "doc_id", "kind", "start", "votes", seed=seed).collect()
    return train([(list(r["features"]), belief[r["kind"], r["votes"]]) for r in drawn], seed=seed)


def _decide(batches: Iterator[pa.RecordBatch], weights: np.ndarray | None, accept: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for doc_id, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            strict = sorted((c["kind"], c["start"], c["end"]) for c in found if c["base"])
            every = list(strict)
            for c in found:
                if not c["base"] and 1 / (1 + np.exp(-(weights[c["features"]].sum() + weights[-1]))) >= accept:
                    every.append((c["kind"], c["start"], c["end"]))
            text = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))
            n = [sum(k == x for k, _, _ in strict) for x in range(4)]
            out.append((doc_id, *n, hashlib.sha256(text(strict).encode()).hexdigest(), text(every), len(every) - len(strict)))
        types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
        cols = zip(*out) if out else [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])


def detect(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """Per row of docs: counts and digest of the base spans, all spans as text, and how many the method added."""
    found = find(docs)
    return found.mapInArrow(partial(_decide, weights=fit(found), accept=accept), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(text: str | None, spans: str) -> str | None:
    """The text with each span of a spans string replaced by its kind in brackets."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s, e, kind in sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(","))):
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents."""
    return detect(table(spark, sf_dir, "documents"))
