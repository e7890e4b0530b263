"""Secrets, personal data and learned scores."""

import hashlib
import random
import re
import zlib

import numpy as np

from tessitura.llm import pii, quality, secrets, toxicity

from tests.llm.conftest import edge_rows

TEXTS = [
    "mail a.b@c.example.org,x_y@z-1.co and x@y", "a@b.c_d@e.f", "ip 1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 001.002.003.004", "card 4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111",
    "+1 (212) 555-0100 +49 30 1234567 +1 2", "é+44 20 7946 0958é", "AKIA" + "A1" * 10 + " password = hunter22 token:'abc' API_KEY=\"0123456789abcdef0123456789abcdef\"",
    "user: bob\nkey Ab1" + "xYz9" * 6 + " https://api.example.org/x", "key Ab1" + "xYz9" * 6 + " alone", "deadbeef" * 3, "AKIAshort secret: KelvinK", "bob (at) example [dot] org, call 030 123 4567",
]


def luhn(digits):
    return sum(v * 2 - 9 * (v > 4) if i % 2 else v for i, v in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_personal(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15]
    return [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)]


def plain_secrets(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)]


def test_strict_spans_are_exact_and_stay(frame):
    rows = edge_rows() + [(100 + i, t) for i, t in enumerate(TEXTS)] + [(200, "4" * 2000 + " " + "a" * 3000 + " 1." * 3000 + " a@b.c" * 2000)]
    texts = {i: t or "" for i, t in rows}
    for run, plain, counts in ((pii.personal_data, plain_personal, pii.KINDS), (secrets.secrets, plain_secrets, secrets.KINDS[:3])):
        got = run(frame(rows)).collect()
        assert len(got) == len(rows)
        for r in (r for r in got if r["doc_id"] is not None):
            want = plain(texts[r["doc_id"]])
            assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
            assert [r[f"n_{k}"] for k in counts] == [sum(w.startswith(k + ":") for w in want) for k in counts]
            assert set(want) <= set(filter(None, r["spans"].split(",")))
        assert run(frame([])).count() == 0


def test_weak_parts_count_only_together(frame):
    got = {r["doc_id"]: r["spans"] for r in secrets.secrets(frame([(1, TEXTS[7]), (2, TEXTS[8]), (3, TEXTS[7].replace("\n", " " * 400))])).collect()}
    assert [s.split(":")[0] for s in got[1].split(",")] == ["identifier", "key", "endpoint"]
    assert got[2] == ""
    assert "identifier" not in got[3]


def test_keys_behind_an_equals_sign_are_candidates(frame):
    key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    access = "aws_access_key_id=AKIA" + "A1" * 8
    forms = [f"{access}\naws_secret_access_key={key}", f"{access}\naws_secret_access_key='{key}'", f"{access}\naws_secret_access_key = {key}", f"user=bob\nKEY={key}==", f"https://h.example.org/x?sig={key}"]
    got = {r["doc_id"]: r["spans"] for r in secrets.secrets(frame(list(enumerate(forms)))).collect()}
    for i, text in enumerate(forms):
        at = text.index(key)
        assert f"key:{at}:{at + len(key) + 2 * (i == 3)}" in got[i].split(",")


def plain_candidates(text):
    """Looser spans that meet no strict one, and strict ones, each with its features, by plain loops."""
    strict = [(int(a), pii.KINDS.index(k), int(b)) for k, a, b in (w.split(":") for w in plain_personal(text))]
    forms = [(pii.EMAIL.replace(r"|\G", ""), 0), (pii.IP, 1), (pii.CARD, 2), (pii.PHONE, 3), (pii.SPELLED, 0), (pii.GROUPS8, 1), (pii.GROUPED, 2), (pii.PLAIN, 3)]
    loose = [(m.start(), k, m.end()) for form, k in forms for m in re.finditer(form, text)]
    loose = [s for s in loose if not any(s[0] < t[2] and s[2] > t[0] for t in strict)]

    def kind_of(c):
        return 0 if not c else 1 if c in " \t\n" else 2 if c.isascii() and c.isalpha() else 3 if c.isascii() and c.isdigit() else 4

    def described(s, is_strict):
        m, numbers = text[s[0]:s[2]], re.findall("[0-9]+", text[s[0]:s[2]])
        digits = "".join(numbers)
        check = (
            re.search("[A-Za-z]{2,}$", m) is not None, re.search("[0-9A-Fa-f]{3}", m) is not None and ":" in m, 14 <= len(digits) <= 19 and luhn(digits), 10 <= len(digits) <= 15,
        )[s[1]]
        steps = lambda v, *limits: sum(v >= x for x in limits)
        cue = re.search(pii.CUES[s[1]], text[max(0, s[0] - pii.AROUND):s[0]]) is not None
        x = (s[1], steps(len(digits), 1, 7, 10, 13, 16), steps(len(m), 8, 12, 16, 24), steps(len(numbers), 2, 4, 5), steps(max(map(len, numbers), default=0), 4, 5, 8), kind_of(text[max(0, s[0] - 1):s[0]]), kind_of(text[s[2]:s[2] + 1]), int(cue))
        return s, x, is_strict, check, digits[-pii.TAIL:] if s[1] == 3 else None

    return [described(s, True) for s in strict] + [described(s, False) for s in loose]


def plain_added(texts):
    """Added spans per text: evidence span by span, the module's trees over the counts, overlaps by a loop."""
    found = [plain_candidates(t) for t in texts]
    known = {tail for spans in found for _, x, strict, _, tail in spans if strict and x[0] == 3 and len(tail) == pii.TAIL}
    table = {}
    for spans in found:
        for _, x, strict, check, tail in spans:
            row = table.setdefault(x, dict(zip(pii.FEATURES, x)) | {"strict": 0, "n": 0, "yes": 0})
            row["strict" if strict else "n"] += 1
            row["yes"] += not strict and check and (x[0] != 3 or x[-1] == 1 or tail in known)
    base, trees, limits = pii.chooser(list(table.values()))
    out = []
    for spans in found:
        kept, upto = [], -1
        for s, x, strict, _, _ in sorted(spans, key=lambda v: (v[0][0], -v[0][2], v[0][1])):
            limit = limits[x[0]]
            if not strict and limit is not None and pii.margins(np.array([x]), base, trees)[0] >= limit - 1e-9 and s[0] >= upto:
                kept, upto = [*kept, s], s[2]
        out.append(kept)
    return out


def card(rand, valid):
    body = "4" + "".join(str(rand.randrange(10)) for _ in range(14))
    last = next(c for c in "0123456789" if luhn(body + c))
    return body + (last if valid else str((int(last) + 1) % 10))


def personal_rows(n=500):
    """Texts with looser personal data, strict twins of some, and numbers alike that are none; with the true looser spans."""
    rand, rows = random.Random(4), []
    for i in range(n):
        a, b, c = rand.randrange(200, 999), rand.randrange(200, 999), rand.randrange(1000, 9999)
        digits = card(rand, i % 160 != 4)
        true, text = [
            (f"{a}-{b}-{c}", "please call {} today"),
            (f"bob{i} (at) example [dot] org", "so write to {} soon"),
            (None, f"row {a} {b} {c} end, order {a}.{b}.{a}.{b} of 2024-01-15 1030"),
            (f"+1 {a} {b} {c}", "office {} then"),
            (".".join(digits[k:k + 4] for k in range(0, 16, 4)), "paid by {} now"),
            (None, f"ids {card(rand, False)} and {a}/{b}"),
            (f"2001:db8:85a3:{a}:0:8a2e:370:{c}", "the host {} is up"),
            (None, "no numbers here"),
        ][i % 8]
        rows.append((i, text.format(true) if true else text, true))
    return rows


def test_added_spans_equal_plain_ones_and_are_personal_data(frame):
    rows = personal_rows()
    texts = [t for _, t, _ in rows] + TEXTS + ["", "  "]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(frame(list(enumerate(texts)))).collect()}
    added = plain_added(texts)
    for i, text in enumerate(texts):
        want = {*plain_personal(text), *(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in added[i])}
        assert set(filter(None, got[i].split(","))) == want
    chosen = [(i, s) for i in range(len(rows)) for s in added[i]]
    true = sum(rows[i][2] is not None and rows[i][1][s[0]:s[2]] == rows[i][2] for i, s in chosen)
    assert true >= 0.9 * len(chosen)
    assert {s[1] for _, s in chosen} == {0, 1, 2, 3}
    assert true >= 0.9 * sum(t is not None and not t.startswith("+") for _, _, t in rows)


def test_thresholds_need_evidence_among_looser_ones(frame):
    rand = random.Random(2)
    rows = [(i, f"pay {card(rand, True)} now" if i % 2 else f"pay {card(rand, False)} now") for i in range(200)]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(frame(rows)).collect()}
    assert all((got[i] != "") == bool(i % 2) for i in got)
    x, n = np.array([[0] + [0] * 7, [0] + [1] * 7]), np.array([100.0, 100.0])
    assert pii.thresholds(x, np.array([10.0, 95.0]), n, np.array([-1.0, 1.0])) == [1.0, None, None, None]
    assert pii.thresholds(x, np.array([1.0, 9.0]), n / 10, np.array([-1.0, 1.0])) == [None] * 4


def labelled(spark, make, n=600):
    rand = random.Random(9)
    rows = [(i, *make(rand, i % 4 == 0)) for i in range(n)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "null id"), (n, None), (n + 1, ""), (n + 2, "  ")], "doc_id long, text string")
    return docs, rows


def accuracy(scored, rows, modulus, held):
    score = {r["doc_id"]: r["score"] for r in scored if r["doc_id"] is not None}
    own = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % modulus == held]
    return sum((score[i] >= 0.3) == bool(y) for i, y in own) / len(own)


def test_toxicity_on_held_out_rows(spark):
    def make(rand, bad):
        words = [f"w{rand.randrange(400)}" for _ in range(60)]
        if bad:
            words[3] = words[30] = rand.choice(["zorgish", "zorgian", "blurgh"])
        return " ".join(words), int(bad)

    docs, rows = labelled(spark, make)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert accuracy(scored, rows, 4, 2) > 0.95
    kept = toxicity.without_toxic(docs, model).count()
    assert kept == sum(r["score"] < 0.3 for r in scored)
    none = toxicity.fit(docs, labels.limit(0))
    assert {round(r["score"], 6) for r in toxicity.score(docs, none).collect()} == {0.0001}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_quality_on_held_out_rows(spark):
    def make(rand, bad):
        words = [f"w{rand.randrange(400)}" for _ in range(150)]
        return (" | ".join(words) if bad else " ".join(words)), int(not bad)

    docs, rows = labelled(spark, make)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    scored = quality.score(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert accuracy(scored, rows, 5, 0) > 0.95
    assert quality.score(docs.limit(0), model).count() == 0
    one = quality.fit(docs, labels.filter("quality = 1"))
    assert {r["score"] for r in quality.score(docs, one).collect()} == {1.0}


def test_slopes_equal_differences():
    import numpy as np

    rand = np.random.default_rng(1)
    x, lengths, y = rand.normal(size=(7, quality.WIDTH)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])
    shapes = [(quality.WIDTH, 5), (5,), (5, 4), (5, 4), (4,), (5,), ()]
    weights = [rand.normal(0, 0.3, s) for s in shapes]
    starts = np.cumsum(lengths) - lengths

    def loss():
        p = quality._forward(x, starts, lengths, tuple(weights))[-1]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    slopes = quality._slopes(x, starts, lengths, y, tuple(weights))
    for k in range(7):
        weights[k] = np.asarray(weights[k], float)
        at = tuple(0 for _ in shapes[k])
        for sign in (1,):
            before = weights[k].copy()
            weights[k][at] += 1e-6
            up = loss()
            weights[k] = before.copy()
            weights[k][at] -= 1e-6
            down = loss()
            weights[k] = before
            assert abs((up - down) / 2e-6 * sign - np.asarray(slopes[k])[at]) < 1e-6
