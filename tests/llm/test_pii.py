import hashlib
import re

from pitchframe.llm import pii
from tests.llm.helpers import documents, none, odd


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
]


def brute(text):
    # without an @ there is no address; the plain pattern would take minutes to see that in a long run of letters
    seen = {k: k != "email" or "@" in text for k, _, _ in BASE}
    found = {k: [(m.start(), m.end()) for m in re.finditer(p, text) if ok(m.group())] if seen[k] else [] for k, p, ok in BASE}
    listed = [f"{k}:{s}:{e}" for k, _, _ in BASE for s, e in found[k]]
    return [len(found[k]) for k, _, _ in BASE], listed


def check(docs):
    given = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=str)
    want = sorted(str((d, *brute(t)[0], hashlib.sha256(",".join(brute(t)[1]).encode()).hexdigest())) for d, t in given)
    got = pii.find_personal_data(docs).collect()
    assert sorted(str(tuple(r)[:6]) for r in got) == want
    return got


TRICKY = [
    "a@b.c_d@e.f x@y x@y.z. .@-.- a@b.c@d.e.f ü@ü.de me.too+x%@ho-st.co.uk",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255 1.2.3 1.2.3.4444 1..2.3.4 9.9.9.9",
    "4539 1488 0343 6467, 4539148803436467 4539-1488-0343-6468 1234567 0000000000000000000 00000000000000000000",
    "+49 30 1234567 +1 (555) 010-9999 +1234567 +12 3456789012345678 ++4 930 123 45 67+49.30.1234567 +1 2",
    "🙂🙂 é mail: ü.x@ex.org 🙂 10.0.0.1 +4930123456789",
    "@" * 3000 + "x" * 3000 + "@" + "1" * 3000 + ".1.1.1" + "+1" * 500 + "." * 900,
    " ".join(f"u{i}@ex.org 10.0.{i % 300}.1" for i in range(700)),
]


def test_tricky_texts(spark):
    check(spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string"))


def test_documents_and_odd_rows(spark):
    check(documents(spark))
    assert all(r["spans"] == "" for r in check(odd(spark)))
    assert pii.find_personal_data(none(spark)).collect() == []


def test_added_kinds_need_a_checksum_or_context(spark):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00."), (2, "IBAN DE88370400440532013000"), (3, "ssn 078-05-1120"), (4, "number 078-05-1120"), (5, "GB82WEST12345698765432")]
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    spans = {d: [x for x in r["spans"].split(",") if x.split(":")[0] in ("iban", "ssn")] for d, r in got.items()}
    assert spans == {1: ["iban:5:32"], 2: [], 3: ["ssn:4:15"], 4: [], 5: ["iban:0:22"]}
    assert got[3]["top_score"] > 0.6


def test_redaction(spark):
    rows = [(1, "write a@b.org or +49 30 1234567!", 9, "kept"), (2, None, None, "kept"), (3, "nothing", 7, "kept"), (4, "x 4539148803436467@ex.org y", 0, "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, email string")
    out = pii.redact(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: tuple(r)[1:] for r in out.collect()}
    assert got == {1: ("write [EMAIL] or [PHONE]!", 25, "kept"), 2: (None, None, "kept"), 3: ("nothing", 7, "kept"), 4: ("x [CARD] y", 10, "kept")}
    assert pii.redact(none(spark)).collect() == []
    assert pii.redact(odd(spark)).count() == odd(spark).count()
