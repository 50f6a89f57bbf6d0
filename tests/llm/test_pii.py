import hashlib
import re

import pytest

from driftloom.llm import pii
from driftloom.llm.pii import personal_spans, reliabilities, span_classifier
from pyspark.sql import functions as F


def luhn(number):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(number)))) % 10 == 0


def base(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        n = re.sub("[^0-9]", "", m[0])
        if 13 <= len(n) <= 19 and luhn(n):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


TEXTS = [
    None, "", "no data here, version 2.0.1 of 1999", "write to a.b+c@mail.example.com, or x@y, or a@b.c_d@e.f.g.", "\U0001f600é ann@example.org é 10.0.0.255 and 256.1.1.1 and 1.2.3.4.5.6.7.8",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 or 4111111111111111.", "call +1 (555) 123-4567, +49 30 1234567 ext 5; +12 no", "+1 555 123 4567 +1 555 123 4567", "0001.002.003.004 and 1..2.3.4",
    "@@@ a@b.c@d.e -@-.- %@a.b", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "9" * 4000 + " " + "a" * 5000 + "@" + "b." * 3000 + "c", ("x@y.zz " * 800) + "+" + "1 " * 3000 + "2",
    "our phone is (555) 234-5678 and ssn 123-45-6789, iban DE44 5001 0517 5407 3249 31", "mail me: john (at) example (dot) com", "١٢٣٤.5.6.7 + 1234567890 a@é.com",
]


def test_spans_agree_with_the_patterns(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, None, "x"), (None, TEXTS[3], "x")], "doc_id long, text string, spans string").repartition(4)
    found = personal_spans(docs)
    rows = found.select("doc_id", pii._joined(F.filter("spans", lambda s: s["base"])).alias("base"), pii._joined(F.col("spans")).alias("all")).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        want = base(TEXTS[3 if r.doc_id is None else r.doc_id] or "")
        assert r.base == ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert set(filter(None, r.base.split(","))) <= set(filter(None, r.all.split(",")))
    assert not any(r["all"] for r in rows if r.doc_id in (0, 1, 2))
    assert personal_spans(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a@b.cc")], "doc_id long, text string")
    plan = pii.candidates(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_labelers_that_agree_are_found_reliable():
    patterns = [((1, 1, 1, 1, 1), 80.0), ((1, 1, 1, 1, -1), 10.0), ((-1, -1, -1, -1, 1), 10.0), ((-1, -1, -1, -1, -1), 60.0), ((1, 0, 0, 0, 0), 3.0)]
    post = reliabilities(patterns)
    assert post[0] > 0.99 and post[1] > 0.9 and post[2] < 0.1 and post[3] < 0.01
    weights = span_classifier([("phone", 1, v, c, p) for (v, c), p in zip(patterns, post, strict=True)])
    score = [sum(a * b for a, b in zip(pii._features("phone", 1, v), weights, strict=True)) for v, _ in patterns]
    assert score[0] > 0 > score[3] and score[1] > 0 > score[2]
    assert reliabilities([]) == []


def test_cued_candidates_are_added_and_others_not(spark):
    rows = [(i, f"call our phone (555) 23{i % 10}-56{i % 10}8 today") for i in range(60)] + [(100 + i, f"mail a{i}@example.com or +1 555 123 45{i:02d}") for i in range(60)]
    rows += [(300, "order no. 000-00-0000"), (301, "model AB12 0000 0000 0000 page")]
    got = {r.doc_id: r.spans for r in personal_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(got[i]) == 1 and got[i][0].kind == "phone" for i in range(60)) and not got[300]


@pytest.mark.parametrize("text", ["", "a"])
def test_checksum_of_no_spans(spark, text):
    row = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = personal_spans(row).select(F.sha2(pii._joined(F.col("spans")).cast("binary"), 256).alias("h")).first().h
    assert got == hashlib.sha256(b"").hexdigest()
