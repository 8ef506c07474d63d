import hashlib
import re

from frames import frame  # noqa: F401
from shredline.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TEXTS = [
    None, "", "nothing", "a@b.c", "x@y@b.co.uk, q.r+s%t@d-e.f", "@a.b@c.d", "é.a@b.c1.ü", "a@b..c a@b.", "a@b.c@d.e@f.g",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8.9 01.002.3.255 1.2.3", "1.2.3.0000000000000004 ٣.1.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112", "12 4111111111111111", "41111111 11111111", "0000000000000", "00000000000000000000",
    "call +1 (385) 555-1563 now", "+49 30 123456", "+1", "++12345678901", "+1234567890123456", "+1 2+3456789012", "+12345678 9)",
    "tel (385) 555-1563, mail me@x.org", "9" * 5000, "a" * 5000 + "@", "1." * 3000, "+1" + " " * 3000, "\U0001F600 a@b.c 1.2.3.4",
    "v 2.0.1 of 2024-01-15 costs 1234567", "password=25a0bc4376e17c8019"]


def brute(text):
    text = text or ""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m.group() if c.isdigit()]
        total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def test_base_spans_equal_the_patterns():
    for t in TEXTS:
        if t is None or len(t) < 4000 or "@" not in t:
            assert P.base_spans(t or "") == brute(t), t
    assert P.base_spans("a" * 5000 + "@") == []


def test_scan(frame):
    rows = list(enumerate(TEXTS)) + [(4, TEXTS[4]), (None, "a@b.c")]
    got = P.scan(frame(rows)).collect()
    assert len(got) == len(rows)
    for g in got:
        if g.doc_id is None:
            continue
        base = brute(TEXTS[g.doc_id])
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(b[0] == k for b in base) for k in P.KINDS]
        assert g.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        spans = [s.split(":") for s in g.spans.split(",")] if g.spans else []
        keys = [(P.KINDS.index(k), int(a), int(b)) for k, a, b in spans]
        assert keys == sorted(keys) and {f"{k}:{a}:{b}" for k, a, b in base} <= set(g.spans.split(","))
    assert P.scan(frame([])).count() == 0


def brute_decode(text, before, places, weights, closed):
    """The highest score of all segmentations."""
    n = len(places)

    def best(i):
        if i == n:
            return 0.0
        top = best(i + 1)
        for j in range(i + 1, min(n, i + P.SEGMENT) + 1):
            if any(k in closed for k in range(i, j)):
                break
            a, b = P.trim(text, places[i][0], places[j - 1][1])
            left = before if i == 0 else text[places[i - 1][0]:places[i - 1][1]]
            if a < b:
                f = P.features(text[a:b], left, j - i)
                top = max(top, max(sum(weights.get((k, x), 0.0) for x in f) for k in P.KINDS) + best(j))
        return top
    return best(0)


def test_decoding_is_exact():
    weights = dict(P.PRIOR) | {("phone", "tokens=2"): 1.5, ("card", "tokens=3"): 0.7, ("ip", "shape=d"): 1.2}
    for text in ("+1 (385) 555-1563 12 1.2.3.4 a@b.c 4111 1111 1111 1111", "1 2 3 4 5 6 7 8", "(1) 2-2"):
        places = [m.span() for m in re.finditer(r"\S+", text)]
        for closed in (set(), {2}, {0, 3}):
            spans = P.decode(text, "call", places, weights, closed)
            score = 0.0
            for kind, i, j in spans:
                a, b = P.trim(text, places[i][0], places[j - 1][1])
                left = "call" if i == 0 else text[places[i - 1][0]:places[i - 1][1]]
                score += sum(weights.get((kind, x), 0.0) for x in P.features(text[a:b], left, j - i))
                assert not closed & set(range(i, j))
            assert abs(score - brute_decode(text, "call", places, weights, closed)) < 1e-9


def test_trained_model_adds_numbers_written_otherwise_and_leaves_others():
    samples = [("and", f"+1 ({200 + i}) 555-{1000 + i}") for i in range(60)]
    samples += [("the", f"{i * 37 + 5}") for i in range(40)] + [("on", f"2024-01-{10 + i}") for i in range(15)]
    samples += [("x", f"ab{i}.12@mail{i}.example.com") for i in range(20)] + [("v", f"{i}.{i}.1") for i in range(20)]
    weights = P.train(samples)
    text = "ask (385) 555-1563 about 1234567 of 2024-02-02, v 3.2.1"
    base, every = P.find_spans(text, weights)
    assert base == [] and [(k, text[a:b]) for k, a, b in every] == [("phone", "(385) 555-1563")]


def test_mask(frame):
    rows = frame([(1, "to a@b.co or +1 (385) 555-1563."), (2, None), (3, "plain"), (4, "")])
    out = P.mask(rows, dict(P.PRIOR))
    assert out.columns == rows.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "to <EMAIL> or <PHONE>.", 2: None, 3: "plain", 4: ""}
