"""Personal data and secrets by weak supervision.

Spans are proposed by patterns: the base kinds, which always stand, and looser forms that may or may not be personal data:
written-out addresses, numbers shaped like cards that fail the checksum, phones in local form or run together with other
numbers, and long tokens of letters and digits (kind `secret`, which has no base form). Labelers vote on each span: +1 for
personal data, -1 against, 0 for no opinion. Regex labelers look at the span's own form, gazetteer labelers at lists, context
labelers at what stands around it. Expectation-maximisation over the counts of all vote patterns estimates how reliable each
labeler is for each kind, with no labels at hand; its posteriors, in turn, are the targets of a logistic span classifier over
votes and shape, which decides on the looser spans. The driver sees counts of patterns only, and there are no more of those
than patterns.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import batches, ddl, documents, slices, texts

KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans in the order in which they are listed: `secret` is found by the method alone.
ALL = (*KINDS, "secret")
DIGITS = frozenset("0123456789")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits is tried from its start only: from any other place in it no match would end elsewhere.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WRITTEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[(] ?dot ?[\])] ?)[A-Za-z0-9-]++)+", re.IGNORECASE)
LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-]|\.[0-9])")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+=*")
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
#: What a token is called, if it is given a value; read backwards from the token.
NAMED = re.compile(r"([A-Za-z_][A-Za-z0-9_-]*)[\"']?\s{0,3}[=:]\s{0,3}[\"']?$")
#: Words that speak for a kind, or against personal data at all, near a span (fixed values).
FOR = {
    "email": frozenset("email mail contact write correo courriel kontakt".split()),
    "ip": frozenset("ip host server address login client dirección adresse".split()),
    "card": frozenset("card visa mastercard credit debit payment pay tarjeta carte karte kreditkarte".split()),
    "phone": frozenset("phone tel call mobile fax cell whatsapp teléfono téléphone telefon".split()),
    "secret": frozenset("token secret password passwd pwd key apikey api auth bearer credential credentials private".split()),
}
AGAINST = frozenset("hash version isbn order invoice id section sha md5 commit checksum digest etag revision serial build page total".split())
#: Endings of addresses that are, and that are not (fixed values).
ENDINGS = frozenset("com org net edu gov info io de fr es uk eu us ch it nl".split())
FILES = frozenset("png jpg jpeg gif svg css js py html txt pdf zip".split())
#: Country codes (fixed values, the most common ones).
COUNTRIES = ("1", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91")
AREA = 32  # characters on each side that context labelers see
WORD = re.compile(r"[^\W\d_]+")
LABELERS = ("form", "checked", "listed", "context", "borders")
ACCEPT = 0.9
#: What labelers are taken to do before any span is seen (chances of -1, 0, 1 where it is not, and where it is personal data), and
#: how many spans that counts as; of numbers that are no cards, it is known that one in ten passes the checksum.
EXPECTED, COUNTS_AS = ((0.5, 0.3, 0.2), (0.1, 0.3, 0.6)), 4.0
CHECKSUM, CHECKSUM_COUNTS_AS = ((0.89, 0.01, 0.1), (0.01, 0.01, 0.98)), 40.0


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what stands in any case, by kind and start; code points, end exclusive."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 40 and 13 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def loose_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Further spans that the classifier decides on; none touches a base span, or another one."""
    found = []
    if "at)" in (low := text.lower()) or "at]" in low or "at )" in low or "at ]" in low:
        found += [("email", *m.span()) for m in WRITTEN.finditer(text)]
    if DIGIT.search(text):
        for m in CARD.finditer(text):
            if 13 <= m.end() - m.start() <= 40 and 13 <= sum(c in DIGITS for c in m.group()) <= 19:
                found.append(("card", *m.span()))
        found += [("phone", *m.span()) for m in LOCAL_PHONE.finditer(text)]
        found += [("secret", *m.span()) for m in TOKEN.finditer(text) if DIGIT.search(m.group()) and LETTER.search(m.group())]
    out: list[tuple[str, int, int]] = []
    taken, at, end = sorted((a, b) for _, a, b in base), 0, 0  # end: of what reaches furthest of those that begin before a span does
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        while at < len(taken) and taken[at][0] < b:
            end = max(end, taken[at][1])
            at += 1
        if a >= end:
            out.append((kind, a, b))
            end = b
    return out


def issuer(digits: str) -> bool:
    """Whether a card's number begins as an issuer's do, and has as many digits."""
    n, two, four = len(digits), int(digits[:2]), int(digits[:4])
    return (digits[0] == "4" and n in (13, 16, 19)) or (n == 16 and (51 <= two <= 55 or 2221 <= four <= 2720 or four == 6011 or two == 65 or two == 35)) or (n == 15 and two in (34, 37)) or (n == 14 and two in (30, 36, 38, 39))


def entropy(span: str) -> float:
    """Bits a character, by the span's own frequencies."""
    counts = np.array(list(Counter(span).values())) / len(span)
    return float(-(counts * np.log2(counts)).sum())


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """The labelers' votes, in the order of LABELERS."""
    span = text[start:end]
    digits = "".join(c for c in span if c in DIGITS)
    before = text[max(0, start - AREA) : start]
    around = {w.lower() for w in WORD.findall(before) + WORD.findall(text[end : end + AREA])}
    if kind == "email":
        ending = re.split(r"[.\s\])]+", span.lower().rstrip("])"))[-1]
        form = 1 if "@" in span or re.search(r"[\[(] ?dot ?[\])]", span, re.IGNORECASE) else 0
        checked = 1 if len(span) <= 254 and ".." not in span else -1
        listed = 1 if ending in ENDINGS else -1 if ending in FILES or ending.isdigit() else 0
    elif kind == "ip":
        parts = [p.lstrip("0") or "0" for p in span.split(".")]
        form = 1 if all(p == "0" or p[0] != "0" for p in span.split(".")) else -1
        checked = 1 if all(len(p) <= 3 and int(p) <= 255 for p in parts) else -1
        listed = -1 if parts[0] in ("0", "10", "127", "255") or parts[:2] == ["192", "168"] or (len(parts[0]) == 3 and int(parts[0]) >= 224) else 1
    elif kind == "card":
        form = 1 if re.fullmatch(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}", span) else -1
        checked = 1 if luhn(digits) else -1
        listed = 1 if issuer(digits) else -1
    elif kind == "phone":
        form = 1 if span[0] in "+(" else 0
        checked = 1 if 9 <= len(digits) <= 15 and len(set(digits)) > 2 else -1
        listed = 1 if span[0] == "+" and digits.startswith(COUNTRIES) else -1 if span[0] == "+" else 0
    else:
        named = NAMED.search(before)
        called = set(re.split(r"[_-]", named[1].lower())) if named else set()
        form = 1 if re.fullmatch(r"(?:[0-9a-f]{8}){4,}|(?:[0-9A-F]{8}){4,}|[A-Za-z0-9+/_-]{20,}=*", span) and len(digits) * 20 >= len(span) else -1
        checked = 1 if entropy(span) >= 3 else -1
        listed = 1 if called & FOR[kind] else -1 if called & AGAINST or "/" in before[-1:] else 0
    context = 1 if around & FOR[kind] else -1 if around & AGAINST else 0
    inside = "_=\"'#" if kind != "secret" else "#@"
    borders = -1 if (start and (text[start - 1].isalnum() or text[start - 1] in inside)) or (end < len(text) and (text[end].isalnum() or text[end] in inside.replace("=", "").replace("#", ""))) else 1
    return (form, checked, listed, context, borders)


def shape(kind: str, span: str) -> int:
    """A coarse form of the span: how many digits it has, and whether anything stands between them."""
    return min(20, sum(c.isdigit() for c in span)) * 2 + any(c in " -()" for c in span)


@dataclass
class Model:
    """`reliable[kind][labeler]`: the chances of its votes -1, 0, 1 for what is not and what is personal data;
    `weights[kind]`: those of the span classifier."""

    reliable: dict[str, np.ndarray]
    prior: dict[str, float]
    weights: dict[str, np.ndarray]

    def probability(self, kind: str, votes: tuple[int, ...], form: int) -> float:
        if kind not in self.weights:
            return 0.0
        return float(1 / (1 + np.exp(-features(votes, form) @ self.weights[kind])))


def features(votes: tuple[int, ...], form: int) -> np.ndarray:
    out = np.zeros(1 + 3 * len(LABELERS) + 2)
    out[0] = 1
    for i, v in enumerate(votes):
        out[1 + 3 * i + v + 1] = 1
    out[-2], out[-1] = form // 2 / 20, form % 2
    return out


def maximise(patterns: list[tuple[tuple[int, ...], float]], kind: str = "", rounds: int = 60) -> tuple[np.ndarray, float, np.ndarray]:
    """Reliabilities (labeler, class, vote), the share of personal data, and each pattern's posterior.

    It starts from EXPECTED, which goes on counting as a few spans: it says which class is which, and keeps a labeler that hardly
    votes from taking sides, but any number of spans overrules it."""
    given = np.array([[v + 1 for v in p] for p, _ in patterns])
    count = np.array([c for _, c in patterns], float)
    starts, weights = np.repeat(np.array(EXPECTED)[None], len(LABELERS), axis=0), np.full(len(LABELERS), COUNTS_AS)
    if kind == "card":
        starts[LABELERS.index("checked")], weights[LABELERS.index("checked")] = CHECKSUM, CHECKSUM_COUNTS_AS
    table, share = starts.copy(), 0.5
    posterior = np.full(len(patterns), 0.5)
    for _ in range(rounds):
        score = np.log([1 - share, share]) + sum(np.log(table[i][:, given[:, i]]).T for i in range(len(LABELERS)))
        posterior = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -50, 50)))
        weight = np.stack([count * (1 - posterior), count * posterior])
        for i in range(len(LABELERS)):
            table[i] = weights[i] * starts[i]
            for v in range(3):
                table[i][:, v] += weight[:, given[:, i] == v].sum(axis=1)
            table[i] /= table[i].sum(axis=1, keepdims=True)
        share = float(np.clip((weight[1].sum() + 1) / (count.sum() + 2), 1e-3, 1 - 1e-3))
    return table, share, posterior


def classifier(rows: list[tuple[tuple[int, ...], int, float, float]], rounds: int = 300) -> np.ndarray:
    """Logistic regression on (votes, form, target, count), by Newton steps with a little shrinking."""
    x = np.array([features(v, f) for v, f, _, _ in rows])
    y, n = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    n = n / n.sum()
    w = np.zeros(x.shape[1])
    for _ in range(min(rounds, 25)):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + 1e-4 * w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        w = w - np.linalg.solve(curve, slope)
    return w


def learn(counts: list[tuple[str, tuple[int, ...], int, bool, int]]) -> Model:
    """From (kind, votes, form, whether base, number of spans)."""
    model = Model({}, {}, {})
    for kind in ALL:
        own = [r for r in counts if r[0] == kind]
        if not own:
            continue
        patterns: Counter = Counter()
        for _, v, _, _, n in own:
            patterns[v] += n
        items = sorted(patterns.items())
        model.reliable[kind], model.prior[kind], posterior = maximise(items, kind)
        target = {p: float(q) for (p, _), q in zip(items, posterior, strict=True)}
        model.weights[kind] = classifier(sorted((v, f, target[v], float(n)) for _, v, f, _, n in own))
    return model


def fit(docs: DataFrame) -> Model:
    """The model of all spans that `docs` has. An empty table, or one without spans, gives a model that accepts base spans alone."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for whole in it:
            for batch in slices(whole):
                for text in batch.column(0).to_pylist():
                    base = base_spans(text)
                    for own, spans in ((True, base), (False, loose_spans(text, base))):
                        for kind, a, b in spans:
                            total[kind, votes(text, kind, a, b), shape(kind, text[a:b]), own] += 1
        out = [(k, ",".join(map(str, v)), f, o, n) for (k, v, f, o), n in total.items()]
        yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int64()))], names=["kind", "votes", "form", "base", "n"])

    found = batches(texts(docs).select("text"), rows, "kind string, votes string, form int, base boolean, n long").groupBy("kind", "votes", "form", "base").agg(F.sum("n")).collect()
    return learn(sorted((k, tuple(map(int, v.split(","))), f, o, n) for k, v, f, o, n in found))


def find(text: str, model: Model) -> list[tuple[str, int, int, bool]]:
    """All spans of a text by kind, then start, and whether each is a base one."""
    base = base_spans(text)
    more = [s for s in loose_spans(text, base) if model.probability(s[0], votes(text, *s), shape(s[0], text[s[1] : s[2]])) >= ACCEPT]
    return sorted([(*s, True) for s in base] + [(*s, False) for s in more], key=lambda s: (ALL.index(s[0]), s[1], s[2]))


def redact(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with each span's kind in its place; of spans that overlap, the one that begins first covers both."""
    out, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind: string, start: int, end: int, base: boolean>>"


def annotate(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, spans, redacted for each row, and the columns `keep` as they are; others are ignored. A null text is empty, a
    null doc_id stays, repeated rows have a row each; texts are read whole, however long; an empty table gives none."""
    names = ["doc_id", "spans", "redacted", *keep]

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for whole in it:
            for batch in slices(whole):
                got = batch.column(1).to_pylist()
                spans = [find(t, model) for t in got]
                yield pa.record_batch([batch.column(0), pa.array([[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in x] for x in spans], kind), pa.array([redact(t, x) for t, x in zip(got, spans, strict=True)], pa.string()), *batch.columns[2:]], names=names)

    return batches(texts(docs, *keep), rows, f"doc_id long, spans {SPANS}, redacted string" + ddl(docs, list(keep)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the personal data of every document, and beside what is asked for n_secret and n_spans (all spans)."""
    docs = documents(spark, sf_dir)
    base = F.filter("spans", lambda s: s.base)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    of_kind = lambda kind: F.filter("spans", lambda s: s.base & (s.kind == kind))
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return annotate(docs, fit(docs)).select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s.kind == "secret")).cast("long").alias("n_secret"), F.size("spans").cast("long").alias("n_spans"))


QUERIES = {"op1_pii": query}
