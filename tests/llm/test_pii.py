import hashlib
import random
import re
from collections import Counter

import numpy as np
from helpers import documents, empty, odd_rows

from tidemark.llm import pii

TEXTS = [
    "", "a@b.c", "x" * 50_000, "1" * 50_000, "a." * 20_000 + "@b.c", "1.2.3.4.5.6.7.8", "é😀 +1 (132) 555-1352 z", "256.1.1.1 0255.0.0.000000001", "4785380592391139 4785-3805-9239-1139-", "a@b.c_d@e.f.g", "+1+1 234 567 8901", "a@" + "b.c" * 5000, None, "..@-.-", "1 " * 30_000,
    "call 212-555-0199 or mail joe (at) mail (dot) com; card 4785380592391130", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"###', "0" * 50 + "1.2.3.4", "mail me@x.org at 10.0.0.1 +49 30 123456789", "nothing here at all",
]


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return sorted(out)


def test_base_spans(spark):
    rows = odd_rows() + [(100 + k, t, "en", "s") for k, t in enumerate(TEXTS)]
    docs = documents(spark, rows)
    texts = {i: t or "" for i, t, *_ in rows if i is not None and i >= 100}
    got = pii.find(docs.repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in texts:
            base = brute(texts[r.doc_id])
            names = [f"{k}:{a}:{b}" for a, _, k, b in base]
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[2] == k for x in base) for k in pii.BASE)
            assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
            assert set(names) <= set(r.spans.split(","))
    spans = {r.doc_id: r.spans for r in got}
    assert spans[116] == "secret:9:49" and spans[119] == "" and spans[4] == spans[5] == ""


def test_no_rows(spark):
    assert pii.find(empty(spark)).count() == 0


def test_reliabilities_match_numpy(spark):
    draw = np.random.default_rng(1)
    counts = {}
    for _ in range(2000):
        real = draw.random() < 0.3
        votes = tuple(int(draw.choice(3, p=[0.1, 0.6, 0.3] if real else [0.5, 0.1, 0.4])) for _ in range(pii.LABELERS))
        counts[votes] = counts.get(votes, 0) + 1
    rows = spark.createDataFrame([(list(v), n) for v, n in counts.items()], "votes array<int>, n long")
    got = {tuple(r.votes): r.q for r in pii.reliabilities(rows, 10).collect()}
    votes, n = np.array(list(counts)), np.array(list(counts.values()), dtype=float)
    prior, yes, no = 0.5, np.tile(pii.FIRST_YES, (pii.LABELERS, 1)), np.tile(pii.FIRST_NO, (pii.LABELERS, 1))
    weight = pii.FIRST_WEIGHT

    def posterior():
        y, x = prior * np.prod([yes[j][votes[:, j]] for j in range(pii.LABELERS)], axis=0), (1 - prior) * np.prod([no[j][votes[:, j]] for j in range(pii.LABELERS)], axis=0)
        return y / (y + x)

    for _ in range(10):
        q = posterior()
        prior = ((n * q).sum() + 1) / (n.sum() + 2)
        yes = np.array([[((n * q)[votes[:, j] == v].sum() + weight * pii.FIRST_YES[v]) / ((n * q).sum() + weight) for v in range(3)] for j in range(pii.LABELERS)])
        no = np.array([[((n * (1 - q))[votes[:, j] == v].sum() + weight * pii.FIRST_NO[v]) / ((n * (1 - q)).sum() + weight) for v in range(3)] for j in range(pii.LABELERS)])
    for v, q in zip(map(tuple, votes.tolist()), posterior(), strict=True):
        assert abs(got[v] - q) < 1e-9


def planted(seed, n):
    """Texts with added-span candidates in four languages: (text, real spans, other candidates) with places."""
    draw = random.Random(seed)
    digits = lambda k: "".join(draw.choice("0123456789") for _ in range(k))
    letters = lambda k, some="abcdefghijklmnopqrstuvwxyz": "".join(draw.choice(some) for _ in range(k))
    valid = lambda d: next(d + x for x in "0123456789" if luhn(d + x))
    lead = {
        "email": ["mail me at ", "Schreib an ", "mon courriel est ", "mi correo es ", "contact: "], "phone": ["call ", "Tel. ", "téléphone ", "móvil ", "fax: ", "phone "],
        "card": ["my card ", "Kreditkarte ", "carte ", "tarjeta ", "visa: "], "secret": ["token = ", "password: ", "Kennwort: ", "mot de passe: ", "clave: ", "api_key="],
    }
    out = []
    for _ in range(n):
        real, other, text = [], [], "Some words "
        for kind in draw.sample(sorted(lead), 2):
            span = {
                "email": f"{letters(6)} (at) {letters(5)} (dot) com", "phone": f"{draw.choice('23456789')}{digits(2)}-{digits(3)}-{digits(4)}",
                "card": " ".join(re.findall(".{1,4}", valid(draw.choice("3456") + digits(11)))), "secret": letters(32, "0123456789abcdef") + digits(4),
            }[kind]
            text += draw.choice(lead[kind])
            real.append((kind, len(text), len(text) + len(span)))
            text += span + draw.choice([" and so on ", ". ", ", und weiter ", " et puis "])
        for _ in range(2):
            kind, span = draw.choice([("secret", "https://x.org/" + "-".join(letters(6) for _ in range(5)) + digits(1)), ("secret", "_".join(letters(8) for _ in range(4)) + "_v" + digits(1)), ("card", "order 0" + digits(13)), ("phone", "part 100-" + digits(3) + "-" + digits(4))])
            text += "see "
            other.append((kind, len(text), len(text) + len(span)))
            text += span + " there "
        out.append((text, real, other))
    return out


def test_added_spans_are_found(spark):
    rows = planted(3, 600)
    docs = documents(spark, [(k, t, "en", "s") for k, (t, *_) in enumerate(rows)])
    hit, asked, wrong, given = Counter(), Counter(), 0, 0
    for r in pii.find(docs).collect():
        found = {(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)}
        _, real, other = rows[r.doc_id]
        assert r.n_spans == len(found) and r.n_added == r.n_spans - r.n_email - r.n_ip - r.n_card - r.n_phone
        for span in real:
            asked[span[0]] += 1
            # a card number of 14 digits or more may be a base span
            hit[span[0]] += any(k == span[0] and a <= span[1] and span[2] <= b for k, a, b in found)
        wrong += sum(any(a < e and s < b for _, a, b in found) for _, s, e in other)
        given += len(other)
    assert all(hit[k] >= 0.9 * asked[k] for k in asked), (hit, asked)
    assert wrong <= 0.1 * given, (wrong, given)


def test_marks_in_texts_change_nothing(spark):
    text = f"{pii.MARK}a{pii.MARK}@b.co {pii.MARK} mail x.y@z.org +1 234 567 8901{pii.MARK}"
    row = pii.find(documents(spark, [(1, text, "en", "s")])).collect()[0]
    assert (row.n_email, row.n_phone, row.spans) == (1, 1, ",".join(f"{k}:{a}:{b}" for a, _, k, b in brute(text)))
