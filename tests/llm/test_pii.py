import hashlib
import random
import re

from helpers import AWKWARD, frame

from residua.llm import pii as op

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or (all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 14 <= len(d) <= 19 and luhn(d) if kind == "card" else 10 <= len(d) <= 15)
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_base_spans_match_brute_force(spark):
    rng = random.Random(2)
    parts = ["a@b.c", "@", "1.2.3.4", ".", "5", "4111 1111 1111 1111", "+1 (976) 555-9947", "-", " ", "é", "😀", "%", "+", "0", "255", "00", "(", ")", "é@x.y"]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))) for i in range(800)]
    docs += [(900 + r[0], r[1]) for r in AWKWARD] + [(2001, "1" * 30000), (2002, "a" * 30000), (2003, "1 " * 20000), (2004, "a.b@" * 3000 + "c.d"), (2005, "1." * 20000)]
    got = {r.doc_id: r for r in op.digest(op.personal_data(frame(spark, docs))).collect()}
    assert len(got) == len(docs)
    for i, t, *_ in docs:
        want, r = brute(t), got[i]
        text = ",".join(f"{kind}:{a}:{e}" for a, _, e, kind in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), (i, r.spans[:200])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[1] for x in want) for k in range(4)]


def test_terms_that_disclose_and_those_that_do_not(spark):
    docs = [(i, f"{w} Zorblax wrote mail bob@x.org about {w} things") for i, w in enumerate("alpha beta gamma delta epsilon zeta".split())]
    docs += [(50 + i, f"other mail wrote things about number {i}") for i in range(200)] + [(300, "é zorblax alone; zorblaxes not")]
    copies = [(400 + i, "copied quuxly text card 4111 1111 1111 1111 end") for i in range(9)]  # one context, however many copies
    df = frame(spark, docs + copies)
    found = op.personal_data(df)
    spans = {r.doc_id: r.spans for r in op.digest(found).collect()}
    assert spans[300] == "term:2:9"
    assert spans[0].split(",")[0] == "term:6:13" and "email" in spans[0]
    assert spans[50] == "" and "term" not in spans[400]
    clean = {r.doc_id: r.text for r in op.sanitised(df, found).collect()}
    assert clean[300] == "é [TERM] alone; zorblaxes not"
    assert clean[0] == "alpha [TERM] wrote mail [EMAIL] about alpha things"
    assert clean[400] == "copied quuxly text card [CARD] end" and clean[50] == docs[6][1]
    assert op.sanitised(df, found).columns == df.columns
    small = op.personal_data(df, max_broadcast_rows=0)
    assert {r.doc_id: r.spans for r in op.digest(small).collect()} == spans


def test_copies_of_a_document_do_not_hide_its_term(spark):
    docs = [(i, f"{w} Zorblax wrote mail bob@x.org about {w} things") for i, w in enumerate("alpha beta gamma delta epsilon".split())]
    docs += [(100 + i, docs[2][1]) for i in range(2000)]  # in thousands, as the data hold them
    docs += [(10_000 + i, f"other mail wrote things about number {i}") for i in range(40_000)] + [(60_000, "zorblax alone")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in op.digest(op.personal_data(rows)).filter("doc_id < 10000 or doc_id = 60000").collect()}
    assert spans[60_000] == "term:0:7"
    assert all("term:6:13" in spans[i] or "term:5:12" in spans[i] or "term:8:15" in spans[i] for i in (0, 1, 2, 3, 4, 100, 2099))


def test_terms_far_away_or_behind_a_number(spark):
    far = "so on and on " * 40
    docs = [(i, f"{w} Zorblax {far} bob@x.org; Quuxly paid 2024 or so, and by card 4111 1111 1111 1111 in 20 parts") for i, w in enumerate("alpha beta gamma".split())]
    docs += [(50 + i, f"so on and card parts paid number {i}") for i in range(100)] + [(300, "zorblax"), (301, "quuxly"), (302, "bob xbob")]
    df = frame(spark, docs)
    found = op.personal_data(df)
    spans = {r.doc_id: r.spans for r in op.digest(found).collect()}
    assert spans[300] == "term:0:7" and spans[301] == "term:0:6" and spans[50] == ""
    assert {r.doc_id: r.spans for r in op.digest(op.personal_data(df, max_broadcast_rows=0)).collect()} == spans
    emails = frame(spark, [(i, f"{w} on bob@x.org") for i, w in enumerate("alpha beta gamma".split())] + docs[3:])
    assert not any("term" in r.spans for r in op.digest(op.personal_data(emails)).collect())  # bob stands in the address only


def test_secrets_are_found_by_what_stands_before_them_or_by_their_beginning(spark):
    rng = random.Random(5)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 4)) + "a1b2"
    words = "alpha beta gamma delta epsilon zeta".split()
    plain = lambda: " ".join(rng.choice(words) for _ in range(12))
    docs, want = [], {}
    for i in range(30):
        secret, cue = hexa(18), ["password=", 'token = "', ""][i % 3]
        secret = secret if cue else "QZXW" + secret[:14].upper() + "77"
        before = f"{plain()} {cue}"
        docs.append((i, f"é{before}{secret} {plain()}"))
        want[i] = f"secret:{len(before) + 1}:{len(before) + 1 + len(secret)}"
    docs += [(100 + i, f"{plain()} donaudampfschifffahrt{i % 7} {plain()}") for i in range(600)]
    docs += [(900, "password=abcdefghijklmnopqr"), (901, "a password is asked for"), (902, hexa(30)), (903, "İstanbul password = QZXW0123456789012345")]
    df = frame(spark, docs)
    found = op.personal_data(df)
    for limit in (100_000, 0):
        got = {r.doc_id: r for r in op.digest(op.personal_data(df, max_broadcast_rows=limit)).collect()}
        assert {i: got[i].spans for i in want} == want and all(got[i].n_secret == 1 and got[i].private for i in want)
        assert got[900].spans == "secret:9:27" and got[903].spans == "secret:20:40"  # no digits, but after a cue
        assert got[901].spans == got[902].spans == "" and not any(got[100 + i].private for i in range(600))
    hashes = {r.doc_id: r.sanitised_sha256 for r in op.with_sanitised(found, df).collect()}
    clean = {r.doc_id: r.text for r in op.sanitised(df, found).collect()}
    assert clean[900] == "password=[SECRET]" and all((h is None) == (clean[i] == dict(docs)[i]) for i, h in hashes.items())
    assert all(h is None or h == hashlib.sha256(clean[i].encode()).hexdigest() for i, h in hashes.items())


def brute_terms(docs, n_docs, support=3, posterior=0.5, bits=4.0):
    """Every term that discloses a value, by counting documents in Python."""
    import math

    words = lambda t: {w.lower() for w in re.findall(r"[^\W_]{3,}", t) if re.search(r"[^\W\d_]", w)}
    holds, out = {}, set()
    for _, t in docs:
        for a, k, e, _ in brute(t):
            holds.setdefault((k, t[a:e]), []).append(t)
    n_t = {}
    for _, t in docs:
        for w in words(t):
            n_t[w] = n_t.get(w, 0) + 1
    for (k, _), _texts in holds.items():
        texts = [t for t in _texts]
        for w in set().union(*map(words, texts)):
            outside = {t for t in texts if w in words(re.sub(PATTERNS[0][1], ". ", t) if k == 0 else t)}
            n_et = sum(w in words(t) for t in texts)
            if len(outside) >= support and n_et / n_t[w] >= posterior and math.log2(n_et * n_docs / (len(texts) * n_t[w])) >= bits:
                out.add(w)
    return out


def test_terms_match_brute_force(spark):
    rng = random.Random(8)
    names = ["Zorblax", "QUUX77", "İstanbulx", "straße9", "ab1"]
    common = "the and with from about more things were seen".split()
    docs = []
    for i in range(400):
        k = rng.randrange(40)
        parts = [rng.choice(common) for _ in range(rng.randint(1, 8))]
        if k < len(names):
            parts += [names[k] if rng.random() < 0.9 else "none", [f"n{k}@x.org", "10.0.0.9", "+1 976 555 9947", "4111 1111 1111 1111", "q@y.de"][k]]
        elif k == 20:
            parts += [rng.choice(names)]
        docs.append((i, " ".join(parts)))
    terms = brute_terms(docs, len(docs))
    assert len(terms) >= 3
    got = {r.doc_id: r.spans for r in op.digest(op.personal_data(frame(spark, docs))).collect()}
    for i, t in docs:
        want = {(m.start(), m.end()) for m in re.finditer(r"[^\W_]{3,}", t) if m[0].lower() in terms}
        assert {tuple(map(int, x.split(":")[1:])) for x in got[i].split(",") if x.startswith("term")} == want, (t, got[i], terms)


def test_empty(spark):
    assert op.digest(op.personal_data(frame(spark, []))).count() == 0
