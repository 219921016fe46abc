"""op1, op3, op6, op8 and the pipeline."""

from __future__ import annotations

import gc
import hashlib
import random
import re
import weakref
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.dataset as ds
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cairn.llm import common, op1_pii, op3_warc_revisits, op4_simhash_gph, op6_byte_cnn, op8_audio
from cairn.llm.queries import ORACLE_SQL, QUERIES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m.group())) <= 19 and op1_pii.luhn(digits(m.group()))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]


def expected_op1(values):
    out = []
    for i, t, _ in values:
        found = base(t or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        out.append((str(i), *(sum(k == kind for k, _, _ in found) for kind in op1_pii.KINDS), hashlib.sha256(listed.encode()).hexdigest()))
    return sorted(out)


def test_luhn():
    assert op1_pii.luhn("4111111111111111") and not op1_pii.luhn("4111111111111112")


def test_base_spans(rows):
    r = random.Random(2)
    parts = [*"a1.@+-() 0%_", "255", "256", "4111 1111 1111 1111", "@b.c", "1.2.3.4", "+1 ", "é", "\n", "٣"]
    for t in [t for _, t, _ in rows] + ["".join(r.choices(parts, k=r.randint(0, 25))) for _ in range(8000)]:
        assert op1_pii.base_spans(t) == base(t)


def test_op1(spark, sf, rows):
    got = op1_pii.query(spark, sf).collect()
    assert sorted((str(r.doc_id), *r[1:6]) for r in got) == expected_op1(rows)
    by_id = dict((i, t) for i, t, _ in rows)
    for r in got:
        listed = [tuple(x.split(":")) for x in r.spans.split(",") if x]
        assert {(k, int(a), int(b)) for k, a, b in listed} >= set(base(by_id[r.doc_id]))
        assert listed == sorted(listed, key=lambda s: (op1_pii.ALL.index(s[0]), int(s[1]))) and r.n_spans == len(listed)


def test_op1_odd_rows(documents, odd):
    df = documents(odd)
    got = op1_pii.annotate(df, op1_pii.fit(df), ("lang",)).collect()
    assert len(got) == len(odd)
    assert sorted((str(r.doc_id), sum(s.base for s in r.spans)) for r in got) == sorted((str(i), len(base(t or ""))) for i, t, _ in odd)
    empty = documents([])
    assert op1_pii.annotate(empty, op1_pii.fit(empty)).collect() == []


def test_em_finds_reliable_labelers():
    r = np.random.default_rng(0)
    accuracy, counts, truth = [0.95, 0.9, 0.55, 0.9, 0.85], {}, {}
    for _ in range(6000):
        y = r.random() < 0.4
        votes = tuple((1 if (r.random() < a) == y else -1) if r.random() < 0.9 else 0 for a in accuracy)
        counts[votes] = counts.get(votes, 0) + 1
        truth.setdefault(votes, []).append(y)
    table, share, posterior = op1_pii.maximise(sorted(counts.items()))
    right = [table[i][1][2] / (table[i][1][2] + table[i][1][0]) for i in range(5)]
    assert abs(share - 0.4) < 0.05 and right[0] > right[2] + 0.2 and right[1] > 0.8 and right[2] < 0.65
    hits = sum(sum(y == (q > 0.5) for y in truth[p]) for (p, _), q in zip(sorted(counts.items()), posterior, strict=True))
    assert hits / 6000 > 0.95


def test_classifier_adds_spans_and_redacts():
    votes = (1, 1, 1, 0, 1)
    model = op1_pii.learn([("phone", votes, 23, True, 500), ("phone", (0, 1, 0, 0, 1), 21, False, 5), ("phone", (-1, -1, 0, -1, -1), 21, False, 60), ("email", (0, 1, 1, 1, 1), 0, False, 5), ("email", votes, 6, True, 300), ("email", (-1, -1, -1, -1, -1), 0, False, 30)])
    text = "call (482) 555-7163 or mail jo (at) mail (dot) org, not a@b.org"
    spans = op1_pii.find(text, model)
    assert ("email", 56, 63, True) in spans and len([s for s in spans if not s[3]]) == 2
    assert op1_pii.redact(text, spans) == "call <phone> or mail <email>, not <email>"
    assert op1_pii.redact("ab", []) == "ab"


def planted(r, n):
    """Texts with personal data and secrets in base and looser forms, and with what looks like them: (text, spans that are, spans that are not)."""
    digits = lambda k: "".join(r.choices("0123456789", k=k))
    hexed = lambda k: "".join(r.choices("0123456789abcdef", k=k))
    word = lambda: "".join(r.choices("abcdefghilmnoprstu", k=r.randint(2, 8)))

    def card():
        while not op1_pii.luhn(d := "4" + digits(15)):
            pass
        return d

    def no_card():
        while op1_pii.luhn(d := r.choice("0179") + digits(15)):
            pass
        return d

    true = {
        "email": lambda: r.choice([f"{word()}.{word()}@{word()}.com", f"{word()} (at) {word()} (dot) org", f"{word()}[at]{word()}.net", f"{word()} [at] {word()} [dot] de"]),
        "phone": lambda: r.choice([f"+1 ({digits(3)}) 555-{digits(4)}", f"+44 20 {digits(4)} {digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}"]),
        "secret": lambda: r.choice([hexed(40), hexed(64), "".join(r.choices("abcdefgXYZQRS0123456789", k=36))]),
        "card": card,
        "ip": lambda: f"{r.randint(1, 9)}{digits(1)}.{r.randint(1, 255)}.{r.randint(1, 255)}.{r.randint(1, 255)}",
    }
    lead = {"email": ["mail", "write", "contact", ""], "phone": ["call", "tel", "phone", ""], "secret": ["token =", "api_key:", "password =", 'secret = "'], "card": ["card", "visa", ""], "ip": ["host", "", "from"]}
    false = [
        lambda: ("email", r.choice([f"{word()} (at) {word()}.png", f"{word()} (at) {word()}.py"]), ["file", "image", "see"]),
        lambda: ("phone", f"{digits(3)}-{digits(3)}-{digits(4)}", ["order", "invoice", "isbn", "part_"]),
        lambda: ("secret", hexed(40), ["commit", "sha =", "digest:", "checksum ="]),
        lambda: ("secret", r.choice([f"build_{word()}_{word()}_{word()}_{word()}{digits(1)}", "a" * 24 + digits(2)]), ["see", "page", "version"]),
        lambda: ("card", no_card(), ["order", "id", "", "total"]),
    ]
    out = []
    for _ in range(n):
        text, yes, no = "", [], []
        for _ in range(r.randint(1, 4)):
            text += " ".join(word() for _ in range(r.randint(6, 14))) + " "
            if r.random() < 0.6:
                kind = r.choice(sorted(true))
                before, span, held = r.choice(lead[kind]), true[kind](), yes
            else:
                kind, span, befores = r.choice(false)()
                before, held = r.choice(befores), no
            text += before + ("" if before.endswith(('"', "_")) else " ")
            held.append((kind, len(text), len(text) + len(span)))
            text += span + " "
        out.append((text, yes, no))
    return out


def counted(texts):
    total = {}
    for text in texts:
        b = op1_pii.base_spans(text)
        for own, spans in ((True, b), (False, op1_pii.loose_spans(text, b))):
            for kind, s, e in spans:
                key = (kind, op1_pii.votes(text, kind, s, e), op1_pii.shape(kind, text[s:e]), own)
                total[key] = total.get(key, 0) + 1
    return sorted((*k, n) for k, n in total.items())


def test_op1_held_out_spans():
    """Learned without labels from half of the texts, the classifier is right on the other half, and more so than a vote count."""
    r = random.Random(11)
    model, test = op1_pii.learn(counted([t for t, _, _ in planted(r, 1500)])), planted(r, 1500)

    def measured(accepts):
        right = wrong = missed = 0
        for text, yes, _ in test:
            b = set(base(text))
            got = {s for s in op1_pii.loose_spans(text, op1_pii.base_spans(text)) if accepts(text, s)}
            want = set(yes) - b
            right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
        return right / max(1, right + wrong), right / max(1, right + missed), right

    precision, recall, right = measured(lambda t, s: model.probability(s[0], op1_pii.votes(t, *s), op1_pii.shape(s[0], t[s[1] : s[2]])) >= op1_pii.ACCEPT)
    by_vote = measured(lambda t, s: sum(op1_pii.votes(t, *s)) > 0)
    assert precision >= 0.9 and recall >= 0.85 and right > 500
    assert precision > by_vote[0] + 0.05


def test_op1_estimates_overrule_what_was_expected():
    """A labeler that votes at random is found out, however many spans there are, and so is one that always errs."""
    r = np.random.default_rng(1)
    counts = {}
    for _ in range(20_000):
        y = r.random() < 0.5
        v = tuple(1 if (r.random() < a) == y else -1 for a in (0.95, 0.9, 0.5, 0.2, 0.9))
        counts[v] = counts.get(v, 0) + 1
    table, share, _ = op1_pii.maximise(sorted(counts.items()))
    assert np.abs(table[:, 1, 2] - [0.95, 0.9, 0.5, 0.2, 0.9]).max() < 0.03 and abs(share - 0.5) < 0.03


def test_op1_loose_spans_touch_nothing():
    r = random.Random(5)
    parts = ["4111 1111 1111 1111", "9807915762804490", "+1 (017) 555-7713", "555-123-4567", "a@b.org", "jo (at) x (dot) org", "1.2.3.4", "0123456789abcdef0123456789abcdef", " ", " ", "x", ".", "-", "="]
    for _ in range(3000):
        t = "".join(r.choices(parts, k=r.randint(1, 9)))
        b = op1_pii.base_spans(t)
        spans = op1_pii.loose_spans(t, b)
        assert all(not (x < f and e < y) for _, x, y in spans for _, e, f in b) and all(p[2] <= q[1] for p, q in zip(spans, spans[1:], strict=False))


# op3


def test_op3_equals_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    result = c.execute(ORACLE_SQL["op3_warc_revisits"])
    names = [d[0] for d in result.description]
    got = sorted((tuple(r[n] for n in names) for r in op3_warc_revisits.query(spark, sf).collect()), key=repr)
    assert got == sorted(result.fetchall(), key=repr) and {r[names.index("verdict")] for r in got} >= {"resolved", "etag-mismatch", "no-response"}


def test_canonical_urls(spark):
    urls = {"HTTP://WWW.Example.com:80/a/?utm_source=x&b=2&a=1&ref=z#top": "example.com/a?a=1&b=2", "https://example.com": "example.com", "example.com/A/": "example.com/A", " https://m.example.com/x?page=2 ": "m.example.com/x?page=2", "": "", None: None}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(op3_warc_revisits.canonical(df.u)).collect()] == list(urls.values())


def records(spark, values):
    return spark.createDataFrame(values, op3_warc_revisits.RECORD)


def resolved(df):
    return {r.record_id: r for r in op3_warc_revisits.resolve(df).collect()}


def test_op3_as_of_and_validators(spark):
    a, b = "http://a.org/x", "https://www.a.org/x/#y"
    got = resolved(records(spark, [
        (1, a, 10, "response", 200, {"ETag": '"1"', "Content-Type": "t", "Date": "d1"}, "p1"), (2, a, 20, "response", 200, {"ETag": 'W/"2"', "Content-Length": "5"}, "p2"), (3, a, 25, "response", 404, {"ETag": '"4"'}, "p4"),
        (4, b, 15, "revisit", 304, {"etag": 'W/"1"', "DATE": "d2", "Content-Type": "no", "X-Other": "no"}, None), (5, b, 20, "revisit", 304, {"etag": '"2"'}, None), (6, b, 30, "revisit", 304, {"etag": '"1"'}, None), (7, b, 5, "revisit", 304, {"etag": '"1"'}, None),
        (8, b, 30, "revisit", 304, None, "p2"), (9, b, 30, "revisit", 304, {}, "p9"), (10, b, 30, "revisit", 304, {"last-modified": "x"}, None), (11, None, 30, "revisit", 304, {}, None), (12, b, None, "revisit", 304, {}, None), (13, "http://b.org", 30, "revisit", 304, {}, None), (None, None, None, None, None, None, None),
    ]))
    assert {k: (r.matched_id, r.verdict) for k, r in got.items()} == {4: (1, "resolved"), 5: (2, "resolved"), 6: (2, "etag-mismatch"), 7: (None, "no-response"), 8: (2, "resolved"), 9: (2, "digest-mismatch"), 10: (2, "no-validator"), 11: (None, "no-response"), 12: (None, "no-response"), 13: (None, "no-response")}
    assert got[4].headers == 'content-type: t\ndate: d2\netag: W/"1"' and (got[4].status, got[4].payload_digest) == (200, "p1") and got[6].headers is None
    assert resolved(records(spark, [])) == {}


def test_op3_ignores_other_columns(spark):
    a = "http://a.org/x"
    plain = records(spark, [(1, a, 10, "response", 200, {"ETag": '"1"'}, "p1"), (2, a, 15, "revisit", 304, {"etag": '"1"'}, None), (2, a, 15, "revisit", 304, {"etag": '"1"'}, None), (3, "x" * 50_000, 15, "revisit", 304, {}, None)])
    more = plain.selectExpr("'x' AS url_key", "*", "'x' AS verdict", "1 AS full", "'y' AS `range`", "'z' AS m", "0 AS matched_id", "null AS carried")
    got = sorted(map(tuple, op3_warc_revisits.resolve(more).collect()), key=repr)
    assert got == sorted(map(tuple, op3_warc_revisits.resolve(plain).collect()), key=repr) and [r[5] for r in got] == ["resolved", "resolved", "no-response"]


def test_op3_hot_url_over_many_ranges(spark):
    r = random.Random(1)
    values = [(i, "http://hot.org" if i % 3 else f"http://h{i % 50}.org", r.randrange(5000), r.choice(["response", "revisit", "revisit"]), 200, {}, "p") for i in range(3000)]
    got = resolved(records(spark, values).repartition(8))
    latest = {}
    for i, u, t, kind, *_ in sorted(values, key=lambda v: (v[2], v[3] == "revisit", v[0])):
        if kind == "response":
            latest[u] = i
        else:
            assert got[i].matched_id == latest.get(u)


# op6


@pytest.fixture(scope="module")
def labelled():
    t = ds.dataset("/root/testdata/sf0.01/documents.parquet").to_table(columns=["doc_id", "text", "lang"])
    return list(zip(*(t.column(c).to_pylist() for c in t.column_names), strict=True))


@pytest.fixture(scope="module")
def net(labelled):
    return op6_byte_cnn.train([(t[:2048], lang) for i, t, lang in labelled if zlib.crc32(str(i).encode()) % 4 != 2], steps=250)


def test_op6_held_out_accuracy(net, labelled):
    test = [(t, lang) for i, t, lang in labelled if zlib.crc32(str(i).encode()) % 4 == 2]
    found, score = op6_byte_cnn.predict(net, [t for t, _ in test])
    assert sum(f == lang for f, (_, lang) in zip(found, test, strict=True)) / len(test) > 0.98
    assert all(0 <= s <= 1 for s in score)


def test_op6_gradients():
    net = op6_byte_cnn.Net(["a", "b", "c"], seed=1)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    r = np.random.default_rng(0)
    windows, labels = r.integers(0, 256, (5, 40)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    loss = lambda: -np.log(net.probabilities(windows)[np.arange(5), labels]).mean()
    for name, g in net.gradients(windows, labels).items():
        flat = np.abs(g).reshape(-1).argsort()[-3:]
        for at in flat:
            place = np.unravel_index(at, g.shape)
            kept = net.weights[name][place]
            net.weights[name][place] = kept + 1e-6
            up = loss()
            net.weights[name][place] = kept - 1e-6
            down = loss()
            net.weights[name][place] = kept
            assert abs((up - down) / 2e-6 - g[place]) < 1e-4


def slow_probabilities(net, text):
    """Filter by filter and place by place, from the definition."""
    w, data = net.weights, text.encode().lower()
    total, weight = np.zeros(len(net.languages)), 0
    step = op6_byte_cnn.WINDOW - op6_byte_cnn.WIDEST + 1
    for first in range(0, max(1, len(data) - op6_byte_cnn.WIDEST + 1), step):
        window = data[first : first + op6_byte_cnn.WINDOW].ljust(op6_byte_cnn.WINDOW, b"\0")
        pooled = []
        for i, width in enumerate(op6_byte_cnn.WIDTHS):
            for f in range(i * op6_byte_cnn.FILTERS, (i + 1) * op6_byte_cnn.FILTERS):
                kernel = w["conv"][: width * op6_byte_cnn.EMBEDDED, f].reshape(width, -1)
                pooled.append(max(0.0, w["bias"][f] + max(sum(float(w["table"][window[p + j]] @ kernel[j]) for j in range(width)) for p in range(step))))
        score = np.array(pooled) @ w["out"] + w["out_bias"]
        share, size = np.exp(score - score.max()), min(op6_byte_cnn.WINDOW, len(data) - first)
        total, weight = total + share / share.sum() * size, weight + size
    return total / weight


def test_op6_equals_a_slow_forward_pass(net, labelled):
    texts = ["a", "abcd", *[t[: 90 + 300 * i] for i, (_, t, _) in enumerate(labelled[:3])], "É日本 ".join("xyz")]
    found, score = op6_byte_cnn.predict(net, texts)
    for t, f, s in zip(texts, found, score, strict=True):
        slow = slow_probabilities(net, t)
        assert net.languages[int(slow.argmax())] == f and abs(slow.max() - s) < 1e-4


def test_op6_learns_every_language_from_a_bounded_sample(documents):
    assert op6_byte_cnn.sample_size(4) == (500, 2048) and op6_byte_cnn.sample_size(10**6) == (1, 64)
    for n in (1, 10, 300, 3000, 100_000):
        rows, chars = op6_byte_cnn.sample_size(n)
        assert n * rows * chars <= max(op6_byte_cnn.SAMPLE_TOTAL, n * op6_byte_cnn.LEAST_CHARS)
    values = [(i, chr(0x4E00 + i % 40) * 30, f"l{i % 40:03d}") for i in range(320)]
    net = op6_byte_cnn.fit(documents(values), rows=3)
    again = op6_byte_cnn.fit(documents([*values[::-1], *values[:50]], parts=5), rows=3)
    assert len(net.languages) == 40 and all(np.array_equal(w, again.weights[k]) for k, w in net.weights.items())


def test_op6_undetermined(net):
    found, score = op6_byte_cnn.predict(net, [None, "", " 12 .", "² Ⅷ ½ _ 三", "² a", "Ω"])
    assert [f == "und" for f in found] == [True, True, True, False, False, False] and score[:3] == [0, 0, 0]
    assert op6_byte_cnn.predict(net, ["² Ⅷ ½ _"])[0] == ["und"]


def test_op6_windows_cover_whole_texts():
    for n in (0, 1, 3, 255, 256, 257, 509, 510, 5000):
        windows, owner, sizes = op6_byte_cnn.windows_of(["x" * n, "y"])
        step = op6_byte_cnn.WINDOW - op6_byte_cnn.WIDEST + 1
        own = windows[owner == 0]
        assert b"".join(w[:step].tobytes() for w in own[:-1]) + own[-1].tobytes().rstrip(b"\0") == b"x" * n
        assert (owner == 1).sum() == 1 and (sizes > 0).all()


def test_op6(spark, sf, rows):
    got = op6_byte_cnn.query(spark, sf).collect()
    assert sorted((r.doc_id, r.held_out) for r in got) == [(i, zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows]
    lang = {i: x for i, _, x in rows}
    assert sum(lang[r.doc_id] == r.lang_pred for r in got) / len(got) > 0.95


def test_op6_odd_rows(documents, odd, net):
    got = op6_byte_cnn.identify(documents(odd), net, ("lang",)).collect()
    assert len(got) == len(odd) and {r.lang_pred for r in got if r.doc_id in (0, 1, 2)} == {"und"}
    assert all((r.lang_pred == "und") == (r.score == 0) for r in got)
    empty = documents([])
    assert op6_byte_cnn.identify(empty, op6_byte_cnn.fit(empty)).collect() == []
    unlabelled = documents([(1, "words", None), (2, "12 34", "en")])
    assert {r.lang_pred for r in op6_byte_cnn.identify(unlabelled, op6_byte_cnn.fit(unlabelled)).collect()} <= {"und", "en"}


# op8


def test_wav_and_resampling():
    payload = bytes(range(192)) * 3
    assert op8_audio.from_wav(op8_audio.to_wav(payload)) == payload
    with pytest.raises(ValueError):
        op8_audio.from_wav(b"RIFF" + op8_audio.to_wav(payload)[4:-1])
    t = np.arange(-(op8_audio.TAPS // 2), 192 * 20 + op8_audio.TAPS) / op8_audio.RATE
    out = op8_audio.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32))
    places = np.arange(len(out)) * op8_audio.DOWN / op8_audio.UP / op8_audio.RATE
    assert len(out) >= 128 * 20 and np.abs(out - np.sin(2 * np.pi * 440 * places))[10:-10].max() < 0.05
    for high in (4050, 4500, 5500):  # above the new rate's half
        assert np.abs(op8_audio.resample(np.sin(2 * np.pi * high * t).astype(np.float32))[60:-60]).max() < 10 ** (-55 / 20)


def slow_log_mel(payload):
    """From the definitions: zeros between samples, a low-pass filter, every third sample, a discrete Fourier transform, triangles in mel."""
    up, down, hop, taps = op8_audio.UP, op8_audio.DOWN, op8_audio.HOP, op8_audio.TAPS
    x = [0.0] * 192 + [(b - 128) / 128 for b in payload] + [0.0] * 192 + [0.0] * (3 * taps)
    sound = []
    for m in range(2 * hop + len(payload) * up // down):
        k, phase = divmod(m, up)
        sound.append(sum((x[i] if (i := down * k + j - taps // 2) >= 0 else 0.0) * float(op8_audio.FILTER[j, phase]) for j in range(taps)))
    n, bank = 2 * hop, op8_audio.mel_bank()
    turn = np.exp(-2j * np.pi * np.outer(np.arange(n // 2 + 1), np.arange(n)) / n)
    out = []
    for f in range(len(payload) // 192 + 1):
        frame = np.array(sound[f * hop : f * hop + n]) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n))
        out.append(1000 * np.log10((np.abs(turn @ frame) ** 2) @ bank + 1e-6))
    return np.array(out)


def test_log_mel_equals_a_slow_one():
    payload = "".join(random.Random(4).choices("abc éß.\n", k=1500)).encode()
    payload = payload.ljust(-(-len(payload) // 192) * 192)
    got, _ = op8_audio.log_mel(payload)
    assert np.abs(got - slow_log_mel(payload)).max() <= 2  # hundredths of a decibel
    bins = np.fft.rfftfreq(256, 1 / 8000)
    mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    edges = np.linspace(0, mel(4000), op8_audio.BANDS + 2)
    for b in range(op8_audio.BANDS):  # each triangle is 0 at its neighbours' middles and largest nearest its own
        inside = (mel(bins) > edges[b]) & (mel(bins) < edges[b + 2])
        assert ((op8_audio.MEL[:, b] > 0) <= inside).all() and op8_audio.MEL[:, b].max() <= 1


def test_log_mel_finds_the_tone_and_pieces_agree(monkeypatch):
    t = np.arange(192 * 50) / op8_audio.RATE
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 * t)).astype(np.uint8).tobytes()
    values, energies = op8_audio.log_mel(tone)
    assert values.shape == (51, op8_audio.BANDS) and len(energies) == 51
    bins = np.fft.rfftfreq(256, 1 / 8000)
    assert op8_audio.MEL[np.abs(bins - 1000).argmin(), values[10].argmax()] > 0.3
    monkeypatch.setattr(op8_audio, "AT_ONCE", 7)
    again, _ = op8_audio.log_mel(tone)
    assert np.abs(again - values).max() <= 2


def test_hysteresis():
    e = np.array([0, 0, 9, 5, 9, 0, 0, 5, 5, 9, 9.0])
    assert op8_audio.active(e, 0.5, 0.5) == [(2, 5), (9, 11)]
    assert op8_audio.active(np.zeros(0)) == [] and op8_audio.active(np.ones(4)) == []


def test_tensors_have_a_fixed_shape():
    values = np.arange(70 * op8_audio.BANDS).reshape(70, -1).astype(np.int16)
    table = pa.ipc.open_stream(op8_audio.to_ipc(op8_audio.tensors(values))).read_all()
    assert table.schema.field("log_mel").type == pa.fixed_shape_tensor(pa.int16(), [32, op8_audio.BANDS])
    stored = table.column("log_mel").chunk(0).to_numpy_ndarray()
    assert np.array_equal(stored.reshape(-1, op8_audio.BANDS)[:70], values) and table.column("frames").to_pylist() == [32, 32, 6]
    assert table.column("start_s").to_pylist()[1] == table.column("end_s").to_pylist()[0]


def check_op8(got, values):
    features = {}
    for (_, t, _), r in zip(sorted(values, key=lambda v: (str(v[0]), v[1] or "")), sorted(got, key=lambda r: (str(r.doc_id), 0)), strict=True):
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(payload) + 44, hashlib.sha256(op8_audio.to_wav(payload)).hexdigest())
        assert features.setdefault(payload, r.feature) == r.feature
    return features


def test_op8(spark, sf, rows):
    features = check_op8(op8_audio.query(spark, sf).collect(), rows)
    assert len(set(features.values())) == len(features)
    for payload, feature in list(features.items())[:40]:
        values, energies = op8_audio.log_mel(payload)
        n, spans, *means, _ = feature.split(":")
        assert (int(n), int(spans)) == (len(values), len(op8_audio.active(energies)))
        assert np.abs(np.array(means, float) - values.reshape(len(values), 4, -1).mean(axis=(0, 2)) / 100).max() < 0.006


def test_op8_stored_tensors_are_what_was_computed(documents):
    from cairn.llm.common import kept

    values = [(1, "a tone of words " * 900, "en"), (2, None, None), (3, "x", "en")]
    back = {r.doc_id: r for r in kept(op8_audio.featured(op8_audio.recordings(documents(values))), "features").collect()}
    for i, t, _ in values:
        raw = (t or "").encode()
        want, energies = op8_audio.log_mel(raw.ljust(max(1, -(-len(raw) // 192)) * 192))
        batch = op8_audio.from_ipc(bytes(back[i].tensors))
        assert np.array_equal(batch.column("log_mel").to_numpy_ndarray().reshape(-1, op8_audio.BANDS)[: len(want)], want)
        assert [(s.start_s, s.end_s) for s in back[i].spans] == [(a / op8_audio.SECOND, b / op8_audio.SECOND) for a, b in op8_audio.active(energies)]
    with pytest.raises(ValueError):
        op8_audio.from_ipc(op8_audio.to_ipc(pa.record_batch([pa.array([1])], names=["log_mel"])))


def test_op8_odd_rows(documents, odd):
    through = lambda values: op8_audio.described(op8_audio.featured(op8_audio.recordings(documents(values)))).collect()
    check_op8(through(odd), odd)
    assert through([]) == []


# the pipeline


@pytest.fixture(scope="module")
def stages(spark, sf):
    """What each stage returns over the smallest tables."""
    from cairn.llm.common import kept

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = kept(stage(spark, docs, sf), name)
        out.append(docs)
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "passages", "personal_data", "packing"]
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def collected(df):
    return {r.doc_id: r for r in df.collect()}


def test_language_stage_keeps_clean_documents(stages):
    before, after = collected(stages[0]), collected(stages[1])
    assert len(after) >= 0.98 * len(before) and all(after[i] == before[i] for i in after)


def test_language_stage_without_labels(spark, documents):
    values = [(1, "words enough", None), (2, "12 3.4 ² Ⅷ", None), (3, None, None), (4, "", None), (5, "été 日本", None), (None, "no id", None)]
    docs = documents(values).selectExpr("doc_id", "text", "lang", "'s' AS source", "cast(length(text) AS long) AS n_chars")
    left = corpus_pipeline.language(spark, docs, "")
    assert {r.doc_id for r in left.collect()} == {1, 5, None} and left.columns == corpus_pipeline.COLUMNS


def shingles(text):
    """The set of 5-word shingles, with A-Z as a-z."""
    words = re.findall("[^\x20\x09-\x0d]+", text.translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_near_duplicate_stage(stages):
    """What goes is what links of an exact Jaccard similarity of 0.8 lead to a smaller doc_id from."""
    before, after = collected(stages[1]), collected(stages[2])
    sets = {i: shingles(r.text) for i, r in before.items()}
    linked = lambda a, b: sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    gone = set()
    for i in sorted(before):  # what each document that is not reached yet reaches goes
        if i not in gone:
            reached, new = {i}, {i}
            while new:
                new = {j for j in before for k in new if j not in reached and linked(j, k)}
                reached |= new
            gone |= reached - {i}
    assert gone and set(after) == set(before) - gone and all(after[i] == before[i] for i in after)


def test_near_duplicate_stage_finds_edited_documents(spark, documents):
    """Copies of long texts with 3 % of their 5-word shingles changed: a Jaccard similarity of over 0.9."""
    r = random.Random(17)
    values = []
    for i in range(60):
        words = [f"w{r.randrange(10**6)}" for _ in range(300)]
        edited = list(words)
        for at in (40, 220):
            edited[at] = "changed"
        values += [(i, " ".join(words), "en"), (1000 + i, " ".join(edited), "en")]
    docs = documents(values).selectExpr("doc_id", "text", "lang", "'s' AS source", "length(text) AS n_chars")
    left = {x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert left >= set(range(60)) and sum(1000 + i not in left for i in range(60)) >= 48


def test_passages_stage(stages):
    before, after = collected(stages[2]), collected(stages[3])
    seen = {}
    for i in sorted(before):
        words = before[i].text.split()
        gone = [False] * len(words)
        for k in range(len(words) - 12):
            if seen.setdefault(tuple(words[k : k + 13]), i) < i:
                gone[k : k + 13] = [True] * 13
        left = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        if any(gone):
            assert (after[i].text if i in after else "") == left
        else:
            assert after[i] == before[i]


def test_personal_data_stage(stages):
    before, after = collected(stages[3]), collected(stages[4])
    assert set(before) == set(after)
    for i, r in after.items():
        assert not base(r.text) and r.n_chars == len(r.text)
        if not op1_pii.base_spans(before[i].text) and not op1_pii.loose_spans(before[i].text, []):
            assert r.text == before[i].text


def test_packing_stage(stages):
    packed = stages[5].collect()
    assert {r.doc_id for r in packed} == set(collected(stages[4]))
    ends = {}
    for r in packed:
        ends[r.doc_id] = ends.get(r.doc_id, 0) + r.length
    assert all(ends[r.doc_id] == r.doc_tokens for r in packed)
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for i, r in collected(stages[4]).items():
        ids = b"".join(bytes(p.ids) for p in sorted((p for p in packed if p.doc_id == i), key=lambda p: p.start))
        assert np.frombuffer(ids, "<u4").tolist() == [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1]


ROWS = "doc_id long, text string, lang string, source string, n_chars long, score string, spans string, kept string"


def test_stages_on_odd_rows(spark, odd):
    """Null, empty, repeated and very long rows, null ids, columns with clashing names: each stage by itself, and none crashes on an empty table."""
    table = lambda values: spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", "x", "x") for i, t, lang in values], ROWS)
    ids = lambda df: sorted(str(r.doc_id) for r in df.collect())
    every = sorted(str(i) for i, _, _ in odd)
    docs = table(odd)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, table([]), "").collect() == [], name
        got = stage(spark, docs, "")
        if name != "packing":
            assert got.columns == corpus_pipeline.COLUMNS
        if name == "near_duplicates":  # 1 and 2 have no word, as 0 has none; 4 is 3 again; the row of 6 that is there twice stays twice
            assert ids(got) == sorted(x for x in every if x not in ("1", "2", "4"))
        elif name == "passages":  # the long texts of one word repeat none of another document
            assert ids(got) == every
        elif name in ("personal_data", "packing"):
            assert sorted({*ids(got)}) == sorted({*every})
        else:
            assert not {"0", "1", "2"} & {*ids(got)}


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_stages_begin_with_executors_giving_back_memory(monkeypatch):
    class Settled(Exception):
        pass

    def settle(spark):
        raise Settled

    monkeypatch.setattr(corpus_pipeline, "settle", settle)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(Settled):
            stage(None, None, "")


def test_settling_gives_back_heap(spark):
    """Heap that garbage has grown goes back to the system."""
    jvm = spark.sparkContext._jvm
    heap = lambda: jvm.java.lang.Runtime.getRuntime().totalMemory() >> 20
    arrays = [jvm.java.nio.ByteBuffer.allocate(100 << 20) for _ in range(12)]
    grown = heap()
    del arrays
    gc.collect()
    common.settle(spark)
    assert grown >= 1200 and heap() < grown - 300


def test_settling_collects_the_drivers_garbage(spark):
    """What only Python's garbage still holds is let go on the driver, and its free native memory goes back to the system."""

    class Plan:
        pass

    gc.disable()
    try:
        plan = Plan()
        plan.own, gone = plan, weakref.ref(plan)
        del plan
        assert gone()
        common.settle(spark)
        assert not gone()
    finally:
        gc.enable()
    assert "trim" in common.trimmed(spark).lower()


def test_settling_again_soon_does_nothing(spark):
    common.SETTLED.pop(spark.sparkContext, None)
    common.settle(spark, 3600)
    first = common.SETTLED[spark.sparkContext]
    common.settle(spark, 3600)
    assert common.SETTLED[spark.sparkContext] == first
    common.settle(spark)
    assert common.SETTLED[spark.sparkContext] > first
