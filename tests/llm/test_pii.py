import hashlib
import random
import re

from paperloom.llm import pii

from .conftest import ODD

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fine(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and pii.luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if fine(k, m[0])]


def base(text):
    return [s[:3] for s in pii.find(text) if s[0] in pii.BASE]


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(1)
    texts = [
        "a@b.com@c.org x@y z@q.w.", "1.2.3.4.5 256.1.1.1 001.002.003.004 1.2.3 1..2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112",
        "+1 (980) 555-6268 +12345678 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "..@a.b %@a-.b", "4111111111111111 4111  1111", "+49 30 1234-5678-",
    ]
    for alphabet in ("a@.1-", "12.", "1 -", "+1 ()-.", "aA@.1 -+%é😀"):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    for t in texts:
        assert base(t) == plain(t), t


def test_luhn_and_mod97():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82WEST12345698765433")


def test_context_and_further_kinds():
    found = pii.find("my account GB82 WEST 1234 5698 7654 32 and token = a1b2c3d4e5f6a7b8c9d0 but key: aaaaaaaaaaaaaaaaaaaa")
    assert [(k, s) for k, _, _, s in found] == [("iban", 1.0), ("secret", 0.7)]
    assert pii.find("call +1 980 555 6268")[0][3] > pii.find("see +1 980 555 6268")[0][3]


def test_very_long_texts_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 300_000, "+1" * 150_000, "a@" * 100_000, "key=" * 50_000, "+" + "1" * 200_000 + "("):
        pii.find(t)


def test_spans_of_odd_rows(spark, odd, none):
    rows = pii.spans(odd).select("doc_id", pii.listed("spans").alias("s")).collect()
    assert len(rows) == len(ODD) and all(r["s"] == "" for r in rows)
    assert pii.spans(none).collect() == []
    df = spark.createDataFrame([(1, "é a@b.co 1.2.3.4")], "doc_id long, text string")
    row = pii.spans(df).select(pii.listed("spans", True).alias("s")).first()
    assert row["s"] == "email:2:8,ip:9:16" and len(hashlib.sha256(row["s"].encode()).hexdigest()) == 64


def test_masked(spark, none):
    df = spark.createDataFrame([(1, "mail a@b.co now", "en", 15), (2, None, "de", 0)], "doc_id long, text string, lang string, n_chars int")
    got = pii.masked(df)
    assert got.dtypes == df.dtypes
    assert {tuple(r) for r in got.collect()} == {(1, "mail [EMAIL] now", "en", 16), (2, None, "de", 0)}
    assert pii.masked(none).collect() == []


def test_ibans_end_where_their_country_says():
    for text in ("IBAN GB82WEST12345698765432 AND MORE", "GB82 WEST 1234 5698 7654 32 AND", "x GB82WEST12345698765432, y", "DE89 3704 0044 0532 0130 00"):
        (own,) = [s for s in pii.find(text) if s[0] == "iban"]
        assert pii.mod97(text[own[1] : own[2]]) and len(text[own[1] : own[2]].replace(" ", "")) == 22
    for text in ("GB82WEST12345698765432A", "GB82WEST1234569876543", "ZZ82WEST12345698765432", "GB82  WEST12345698765432", "GB82", "GB82 "):
        assert not [s for s in pii.find(text) if s[0] == "iban"]
