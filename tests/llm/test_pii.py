import hashlib
import random
import re

from ledgerflow.llm import pii

from .fixtures import AWKWARD, awkward

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return "".join(c for c in s if c in "0123456789")


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def base(t):
    t = t or ""
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]
    return out


CASES = ["mail a.b+c@x-y.example.com.", "a@b", "a@b@c.d.e", "a@b.c@d.e", "@x.y", "x@.y.z", "a@b..c",
         "1.2.3.4 and 256.1.1.1 and 1.2.3.4.5.6.7.8 and 1.2..3.4.5.6 and 001.02.3.4", "1.2.3",
         "4111 1111 1111 1111, 4111-1111-1111-1112, 4111  1111 1111 1111", "79927398713 x 6011000990139424",
         "+1 (555) 123-4567. +49 30 1234567890123456 +1 +12 + 5 ++4930123456 +1-2-3-4-5-6-7-8-", "+4( )",
         "É@b.cc ١٢٣.1.2.3 ＋4930123456", "call +1.2.3.4.5.6.7.8", "İ 1.2.3.4 a@b.cc"]


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    chars = "0123456789" * 3 + "..+-- ()@@abAB%_é\n"
    texts = CASES + [t for _, t in AWKWARD]
    texts += ["".join(rng.choice(chars) for _ in range(rng.randint(1, 60))) for _ in range(20_000)]
    for t in texts:
        assert [s for s in pii.find(t) if s[0] in pii.BASE] == base(t), repr(t)


def added(t):
    return [(k, t[s:e]) for k, s, e in pii.find(t) if k not in pii.BASE]


def test_added_kinds():
    assert added("IBAN: DE89 3704 0044 0532 0130 00 thanks") == [("account", "DE89 3704 0044 0532 0130 00")]
    assert added("iban GB82WEST12345698765432.") == [("account", "GB82WEST12345698765432")]
    assert added("IBAN DE89 3704 0044 0532 0130 01") == []
    assert added("Account no. 12345678") == [("account", "12345678")]
    assert added("https://bob:secret@host.example/x") == [("login", "bob:secret")]
    assert added("write to bob (at) host.example or bob[at]host.example") == [
        ("hidden_email", "bob (at) host.example"), ("hidden_email", "bob[at]host.example")]
    assert added("account for it, see https://host.example/a:b@c") == []


def test_redaction():
    t = "to a@b.cc at 1.2.3.4"
    assert pii.redact(t, pii.find(t)) == "to <email> at <ip>"
    assert pii.redact(None, []) == ""


def test_rows(spark):
    got = pii.pii(awkward(spark), redacted=True).collect()
    assert len(got) == len(AWKWARD)
    assert sum(r.n_email for r in got) == 0
    df = spark.createDataFrame([(1, CASES[0] + CASES[5]), (None, None)], "doc_id long, text string")
    for r in pii.pii(df).collect():
        t = CASES[0] + CASES[5] if r.doc_id else ""
        want = ",".join(f"{k}:{s}:{e}" for k, s, e in base(t))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert r.spans == want
    assert pii.pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0
