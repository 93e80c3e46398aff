import hashlib
import random
import re

from pyspark.sql import functions as F

from tidemark.llm import pii_spans as P

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in match.split(".")),
            "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def brute(text):
    found = sorted((m.start(), i, m.end(), kind) for i, (kind, p) in enumerate(PLAIN.items())
                   for m in re.finditer(p, text) if valid(kind, m[0]))
    listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)
    return (*(sum(f[3] == k for f in found) for k in PLAIN), hashlib.sha256(listed.encode()).hexdigest(), listed)


def reported(spark, texts):
    rows = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)],
                                 "doc_id long, text string, found string, kind int")
    return [tuple(r)[1:] for r in sorted(P.report(rows).collect())]


def test_like_the_plain_patterns(spark):
    rng = random.Random(8)
    parts = ["a", "b_", "@", ".", "-", "x@y.z", "1", "22", "255", "256", "007", "1.2.3.4", ".5", "+", "+1 (", ") ", " ", "é",
             "4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 30 1234567", "😀", "\n", "555"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(1500)]
    texts += ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "a@b.c@d.e", "+1+1+123456789", "0" * 30]
    for text, got in zip(texts, reported(spark, texts), strict=True):
        want = brute(text)
        assert got[:5] == want[:5], text
        base = ",".join(s for s in got[5].split(",") if s.split(":")[0] in PLAIN)
        assert base == want[5], text


def test_added_kinds(spark):
    iban = "DE89 3704 0044 0532 0130 00"
    texts = [f"My account {iban}.", f"Some {iban} text", "My account DE88 3704 0044 0532 0130 00.", "SSN 219-09-9999",
             "number 219-09-9999", "ssn 000-12-3456", "GB82WEST12345698765432 bank"]
    got = [r[5] for r in reported(spark, texts)]
    assert got[0] == "iban:11:38" and got[1] == "iban:5:32" and "iban" not in got[2]
    assert "ssn:4:15" in got[3] and "ssn" not in got[4] and "ssn" not in got[5] and got[6] == "iban:0:22"


RUNS = [("1", "", 4000), ("1 ", "", 4000), ("a", "@", 4000), ("a@b.c ", "", 5000), ("+1", "", 4000),
        ("1.1.1.1 ", "", 5000), ("a.", "x@y", 4000)]


def test_runs(spark):
    texts = [part * n + end for part, end, n in RUNS]
    for text, got in zip(texts, reported(spark, texts), strict=True):
        assert got[:5] == brute(text)[:5]


def test_long_runs(spark):
    """A megabyte of each: no recursion, no second look at what was seen."""
    reported(spark, [part * (1_000_000 // len(part)) + end for part, end, _ in RUNS if "@" not in part])


def test_edges(spark, edge_docs, no_docs):
    got = {(r.doc_id or -1): tuple(r)[1:6] for r in P.report(edge_docs).collect()}
    assert got == {(d.doc_id or -1): brute(d.text or "")[:5] for d in edge_docs.collect()}
    assert P.report(no_docs).count() == 0 and P.redact(no_docs).count() == 0


def test_redact(spark):
    rows = spark.createDataFrame([(1, "Write to a.b@c.org or 10.0.0.256, 10.0.0.25 now; 4111 1111 1111 1111, +1 (212) 555-8457!"),
                                  (2, None), (3, "nothing 12 here")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in P.redact(rows).collect()}
    assert got == {1: "Write to <EMAIL> or 10.0.0.256, <IP> now; <CARD>, <PHONE>!", 2: None, 3: "nothing 12 here"}
    assert P.report(P.redact(rows)).agg(F.sum(F.expr("n_email + n_ip + n_card + n_phone"))).first()[0] == 0


def test_no_python_on_the_main_path(spark):
    rows = spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")
    for df in (P.report(rows), P.redact(rows)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def without(text, listed):
    """The text by plain steps: stretches of overlapping spans give way to the kind of the first."""
    out, at = "", 0
    for kind, a, b in [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in listed.split(",") if s)]:
        if a >= at:
            out += text[at:a] + f"<{kind.upper()}>"
        at = max(at, b)
    return out + text[at:]


def test_redact_takes_out_what_is_reported(spark):
    iban = "DE89 3704 0044 0532 0130 00"
    texts = ["219-09-9999 (SSN)", "SSN: 219-09-9998, 219-09-9999", "219-09-9997 é😀 or 219-09-9996 are social security numbers",
             f"{iban} and bank {iban}, a@1.2.3.4 +4111 1111 1111 1111", "no ssn", "1.2.3.4", "", "😀 a@b.c 😀 1.2.3.4 é",
             "219-09-9999, " * 3 + "x" * 50 + " ssn 219-09-9995", "a@b.c " * 256, "a@b.c " * 257 + "end", "x@1.2.3.4 " * 700]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in P.redact(rows).collect()}
    for i, (text, report) in enumerate(zip(texts, reported(spark, texts), strict=True)):
        assert got[i] == without(text, report[5])
        for _, a, b in [s.split(":") for s in report[5].split(",") if s]:
            assert text[int(a):int(b)] not in got[i]
    assert got[0] == "<SSN> (SSN)" and got[1] == "SSN: <SSN>, <SSN>" and "219" not in got[2]


def test_redact_long_texts(spark):
    rows = spark.createDataFrame([(1, "1.1.1.1 " * 125_000)], "doc_id long, text string")
    assert P.redact(rows).first().text == "<IP> " * 125_000


def test_account_codes_before_other_words(spark):
    iban, other = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    texts = [f"IBAN {iban} I paid", f"IBAN {iban} BIC COBADEFF", f"IBAN {iban} 2024-01", f"{iban} BIC COBADEFFXXX",
             f"{iban} {other}", f"AB12 CDEF GHIJ KLMN {iban}", "GB82WEST12345698765432 OK", f"{iban}BIC", f"x {iban} " * 300]
    listed = [r[5].split(",") for r in reported(spark, texts)]
    got = [[s for s in r if s.startswith("iban")] for r in listed]
    assert got[:4] == [["iban:5:32"], ["iban:5:32"], ["iban:5:32"], ["iban:0:27"]]
    assert got[4:7] == [["iban:0:27", "iban:28:55"], ["iban:20:47"], ["iban:0:22"]] and got[7] == []
    assert got[8] == [f"iban:{30 * i + 2}:{30 * i + 29}" for i in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    redacted = [r.text for r in P.redact(rows).orderBy("doc_id").collect()]
    assert redacted[:2] == ["IBAN <IBAN> I paid", "IBAN <IBAN> BIC COBADEFF"]
    assert redacted[4] == "<IBAN> <IBAN>" and all(iban not in r and other not in r for r in redacted[:7] + redacted[8:])
