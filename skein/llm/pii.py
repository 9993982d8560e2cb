"""Personal data: base patterns, and further spans by weak supervision.

Method: base matches and candidates of looser kinds are found in whole texts; regex,
gazetteer and context labelers vote on each.  Expectation-maximisation over the votes of the
whole corpus estimates how reliable every labeler is (over all kinds together, so that the
many base matches teach what the few others need) and each kind's share of personal data.
Its posteriors train a logistic span classifier over a span's characters and the words around
it, which decides the candidates.  Base spans always stay; those that the classifier
doubts are named in a column of their own.  An added span overlaps no other.

One pass over the texts leaves a small row per document (spans with their votes and hashed
features), kept in the shared checkpoint folder.  The corpus's votes are counted by
pattern (kind, votes), of which there is a bounded number, so that the estimate covers
every span of the corpus and still takes only the counts to the driver.  The classifier is
trained on at most ``SAMPLE`` spans of each kind, chosen by a hash.

Defined cases: a null or empty text has no spans; repeated rows are treated alike; an
empty table gives no rows; ties between added spans go to the earlier start, then the
longer span, then the kind's order.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import cut, map_arrow
from skein.llm.gazetteers import ACCOUNTS, Gazetteers

BASE = ("email", "ip", "card", "phone")
#: Spans of a kind that train the classifier, its hashed features, a document's text on either side of a span that labelers read.
SAMPLE, BUCKETS, AROUND = 1500, 4096, 60
#: Fixed patterns of the base kinds (card and phone are checked further).
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

#: Looser kinds, in the order that breaks ties.
EXTRA = {
    "email_spelled": re.compile(r"(?<![\w.])[A-Za-z0-9._%+-]{1,64}\s?[\[(]?\s?\bat\b\s?[\])]?\s?[A-Za-z0-9-]{1,63}(?:\s?[\[(]?\s?\bdot\b\s?[\])]?\s?[A-Za-z]{2,24}){1,4}"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "phone_local": re.compile(r"(?<![\w+(.-])\(?0?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])"),
    "mac": re.compile(r"(?<![\w:])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![\w:])"),
    "ipv6": re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![\w:])"),
    "birth_date": re.compile(r"(?<![\w./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![\w/-])"),
    "name": re.compile(r"\b(?:Mrs|Mr|Ms|Dr|Herr|Frau|Mme|M|Sra|Sr)\.? (?:[A-Z][a-z]{1,20}[ -]){0,2}[A-Z][a-z]{1,20}"),
}
_NEEDS_DIGIT = frozenset(("ssn", "iban", "phone_local", "mac", "ipv6", "birth_date"))
#: Words near a span that speak for its kind.
CONTEXT = {
    "email": frozenset("email mail e-mail contact write courriel correo adresse".split()),
    "ip": frozenset("ip address host server from client login adresse".split()),
    "card": frozenset("card visa mastercard credit debit karte carte tarjeta payment".split()),
    "phone": frozenset("tel phone call mobile fax telefon téléphone teléfono handy cell".split()),
    "email_spelled": frozenset("email mail e-mail contact write courriel correo adresse".split()),
    "ssn": frozenset("ssn social security number tax".split()),
    "iban": frozenset("iban account bank konto compte cuenta".split()),
    "phone_local": frozenset("tel phone call mobile fax telefon téléphone teléfono handy cell".split()),
    "mac": frozenset("mac device adapter ethernet".split()),
    "ipv6": frozenset("ip address host server ipv6".split()),
    "birth_date": frozenset("born birth dob birthday geboren né née nacido nacida".split()),
    "name": frozenset("dear contact signed regards ms mr patient client sincerely".split()),
}
AGAINST = frozenset("version release isbn page pages figure table section chapter example sample test edition".split())
_WORD = re.compile(r"[^\W\d_][\w-]*")


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The base kinds' spans ``(start, end, kind)`` by start, then by the kinds' order."""
    out: list[tuple[int, int, str]] = []
    at, taken = text.find("@"), 0
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            taken = m.end()
        else:
            taken = max(taken, start)  # a longer look back is never needed: "@" isn't a local character
        at = text.find("@", max(at + 1, taken))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
                out.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(m.group().count, "0123456789")) <= 15:
                    out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], BASE.index(s[2])))


#: The labelers, in the order of their votes.
LABELERS = ("form", "gazetteer", "context", "against", "glued", "monotone")


def _votes(kind: str, text: str, start: int, end: int, known: Gazetteers) -> str:
    """One character per labeler: + for, - against, 0 no opinion."""
    span = text[start:end]
    figures = _DIGIT.findall(span)
    near = {w.lower() for w in _WORD.findall(text[max(0, start - AROUND) : start])[-5:]}
    around = near | {w.lower() for w in _WORD.findall(text[end : end + AROUND])[:3]}
    form = {
        "email": lambda: len(span) <= 254 and ".." not in span and span[0] not in ".-%+",
        "ip": lambda: span.split(".")[0].lstrip("0") != "",
        "card": lambda: len(figures) in (14, 15, 16, 19), "phone": lambda: 10 <= len(figures) <= 13,
        "email_spelled": lambda: bool(re.search(r"[\[(]\s?at\s?[\])]|[\[(]\s?dot\s?[\])]", span)) or " at " in span and " dot " in span,
        "ssn": lambda: span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00",
        "iban": lambda: _iban(span), "phone_local": lambda: 9 <= len(figures) <= 12, "mac": lambda: len(set(span)) > 4, "ipv6": lambda: span.count(":") == 7,
        "birth_date": lambda: 1900 <= int(re.search("(?:19|20)[0-9]{2}", span).group()) <= 2015, "name": lambda: span.count(" ") > 1,
    }[kind]()
    listed = {
        "email": lambda: span.rsplit(".", 1)[1].lower() in known.domains,
        "ip": lambda: False if span.split(".")[0] in ("0", "10", "127", "255") or span.startswith("192.168.") else None,
        "card": lambda: figures[0] in "3456", "phone": lambda: "".join(figures[:2]) in known.calling or figures[0] in known.calling,
        "email_spelled": lambda: span.rsplit(None, 1)[-1].strip("[]()").lower() in known.domains,
        "iban": lambda: len(span.replace(" ", "")) == ACCOUNTS.get(span[:2]),
        "name": lambda: bool({w.lower() for w in _WORD.findall(span)} & known.given),
    }.get(kind, lambda: None)()
    votes = [form, listed, True if near & CONTEXT[kind] else None, False if around & AGAINST else None, False if start and text[start - 1] in "=/_#" else None, False if len(figures) > 5 and len(set(figures)) < 3 else None]
    return "".join("0" if v is None else "+" if v else "-" for v in votes)


def _features(kind: str, text: str, start: int, end: int) -> list[int]:
    """Hashed features of a span: its characters' classes, whole and in threes, its length, and the words around it, each with its kind."""
    span = text[start:end]
    shape = span.translate(_CLASSES)
    marked = f"^{shape}$"
    names = ["k", f"s{re.sub(r'(.)\1+', r'\1+', shape)}", f"n{len(span)}"]
    names += [f"c{marked[i : i + 3]}" for i in range(len(marked) - 2)]
    names += [f"l{w.lower()}" for w in _WORD.findall(text[max(0, start - AROUND) : start])[-3:]] + [f"r{w.lower()}" for w in _WORD.findall(text[end : end + AROUND])[:2]]
    names += [f"b{text[start - 1 : start]}", f"a{text[end : end + 1]}"]
    return sorted({zlib.crc32(f"{kind} {n}".encode()) % BUCKETS for n in names})


_CLASSES = {ord(c): "9" for c in "0123456789"} | {c: "a" for c in range(97, 123)} | {c: "A" for c in range(65, 91)}


def _iban(span: str) -> bool:
    s = span.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def candidates(text: str, base: list[tuple[int, int, str]], known: Gazetteers = Gazetteers()) -> list[str]:
    """Base spans, and candidates of the looser kinds that overlap none of them, as ``kind:start:end:votes:features``, by start."""
    digit = bool(_DIGIT.search(text))
    found = [(start, -end, -1, kind) for start, end, kind in base]
    ends = [e for _, e, _ in base]
    reach = np.maximum.accumulate(ends).tolist() if ends else []
    starts = [a for a, _, _ in base]
    for rank, (kind, pattern) in enumerate(EXTRA.items()):
        if kind in _NEEDS_DIGIT and not digit or kind == "email_spelled" and "dot" not in text:
            continue
        for m in pattern.finditer(text):
            k = bisect.bisect_left(starts, m.end())  # base spans that begin before the candidate ends
            if not k or reach[k - 1] <= m.start():
                found.append((m.start(), -m.end(), rank, kind))
    return [f"{kind}:{start}:{-end}:{_votes(kind, text, start, -end, known)}:{' '.join(map(str, _features(kind, text, start, -end)))}" for start, end, _, kind in sorted(found)]


def estimate(patterns: dict[tuple[str, str], int], rounds: int = 50) -> dict[tuple[str, str], float]:
    """Probability that a span of each pattern ``(kind, votes)`` is personal data, by EM over two classes.

    Each kind has a share of personal data; each labeler has a rate of saying yes in either class,
    estimated over all kinds.  No opinion is no evidence.  Pseudo-counts say that a labeler is
    right more often than wrong.
    """
    keys = sorted(patterns)
    if not keys:
        return {}
    weight = np.array([patterns[k] for k in keys], float)
    kinds = sorted({k for k, _ in keys})
    kind = np.array([kinds.index(k) for k, _ in keys])
    votes = np.array([["-0+".index(c) - 1 for c in v] for _, v in keys])
    yes, no = (votes > 0).astype(float), (votes < 0).astype(float)
    p = np.clip(0.5 + 0.2 * yes.sum(1) - 0.25 * no.sum(1), 0.05, 0.95)
    for _ in range(rounds):
        share = (np.bincount(kind, weight * p) + 1) / (np.bincount(kind, weight) + 2)
        rates = []
        for w, (a, b) in ((weight * p, (3, 1)), (weight * (1 - p), (1, 3))):
            rates.append((w @ yes + a) / (w @ (yes + no) + a + b))
        log = np.log(share / (1 - share))[kind] + yes @ np.log(rates[0] / rates[1]) + no @ np.log((1 - rates[0]) / (1 - rates[1]))
        p = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
    return dict(zip(keys, p.tolist()))


def train(features: list[list[int]], chance: list[float], rounds: int = 300, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic classifier on hashed features and soft labels, by full-batch Adam: weights and bias."""
    w, b = np.zeros(BUCKETS), 0.0
    if not features:
        return w, -4.0
    size = np.array([len(f) for f in features])
    index, starts, y = np.concatenate([np.array(f) for f in features]), np.cumsum(size) - size, np.array(chance)
    first, second = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for t in range(1, rounds + 1):
        g = (1 / (1 + np.exp(-np.clip(np.add.reduceat(w[index], starts) + b, -30, 30))) - y) / len(y)
        grad = np.append(np.bincount(index, np.repeat(g, size), BUCKETS) + l2 * w, g.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        step = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def scan(docs: DataFrame, known: Gazetteers = Gazetteers()) -> DataFrame:
    """``(doc_id, base, found)``: base spans as ``kind:start:end``, and those and all candidates with votes and features, for every whole text."""

    def run(rows: dict) -> dict:
        base, found = [], []
        for t in rows["text"]:
            spans = base_spans(t or "")
            base.append([f"{k}:{a}:{b}" for a, b, k in spans])
            found.append(candidates(t or "", spans, known))
        return {"doc_id": rows["doc_id"], "base": base, "found": found}

    return map_arrow(docs.selectExpr("doc_id", "cast(text as string) text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base array<string>, found array<string>")


def find(docs: DataFrame, threshold: float = 0.5, known: Gazetteers = Gazetteers(), sample: int = SAMPLE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts of the base kinds, their digest, all spans, and the base spans that the classifier doubts."""
    rows = cut(scan(docs, known))
    parts = F.split("c", ":")
    each = rows.select(F.explode("found").alias("c")).select("c", parts[0].alias("kind"), parts[3].alias("votes"))
    counted = each.groupBy("kind", "votes").count().collect()  # a bounded number of patterns
    chance = estimate({(r["kind"], r["votes"]): r["count"] for r in counted})
    order = Window.partitionBy("kind").orderBy(F.xxhash64("c"), "c")
    few = each.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample).select("c", "kind", "votes").collect()  # at most ``sample`` of each of twelve kinds
    few.sort()
    weight, bias = train([[int(f) for f in r["c"].rsplit(":", 1)[1].split()] for r in few], [chance[r["kind"], r["votes"]] for r in few])
    limit = math.log(threshold / (1 - threshold)) - bias
    number = {k: i for i, k in enumerate((*BASE, *EXTRA))}

    def run(rows: dict) -> dict:
        out: dict[str, list] = {n: [] for n in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "doubted")}
        for base, found in zip(rows["base"], rows["found"]):
            kinds = [s.split(":")[0] for s in base]
            for k in BASE:
                out[f"n_{k}"].append(kinds.count(k))
            out["base_sha256"].append(hashlib.sha256(",".join(base).encode()).hexdigest())
            spans = [((int((p := s.split(":"))[1]), number[p[0]]), s) for s in base]
            doubted, taken = [], 0
            for c in found:
                kind, start, end, _, features = c.split(":")
                sure = float(weight[np.array(features.split(), int)].sum()) >= limit
                if kind in BASE:
                    doubted += [] if sure else [f"{kind}:{start}:{end}"]
                elif sure and int(start) >= taken:
                    spans.append(((int(start), number[kind]), f"{kind}:{start}:{end}"))
                    taken = int(end)
            out["spans"].append(",".join(s for _, s in sorted(spans)))
            out["doubted"].append(",".join(doubted))
        return {"doc_id": rows["doc_id"]} | out

    return map_arrow(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, doubted string")
