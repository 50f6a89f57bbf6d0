"""Personal data by weak supervision, in DataFrame and SQL functions only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; looser patterns add
candidates (spelled-out addresses, national phone forms, social security numbers, bank
accounts).  Five labelers of three kinds vote on every candidate: regular expressions (strict
form, digit shape, boundaries), gazetteers (top-level domains, issuers, calling and country
codes) and context (cue words before the span).  Expectation-maximisation over the counts of
vote patterns estimates how reliable each labeler is; its posteriors train a logistic span
classifier, whose weights become one SQL expression.  Base spans always stay; a looser
candidate becomes a span when the classifier accepts it and no base span overlaps it.

The text is scanned once and never shuffled.  Patterns run only on texts that hold a character
they need, and are written so that matching takes time linear in the text: a run is entered at
its start only (or where the last match ended), and repeated groups never give back.  What
reaches the driver is the table of vote patterns: at most kinds x 2 x 3**5 x 4 rows.

Defined cases: null and empty texts have no spans; positions are code points, end exclusive;
matches that fail their test are dropped without a retry; repeated rows give equal rows; an
empty table gives no rows; extra columns never matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.common import query, table, written

KINDS = ("email", "ip", "card", "phone", "id", "account")
#: Base patterns; the look-behinds skip starts inside a run, of which the run's own start is the leftmost match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Looser patterns of further candidates.
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}){1,4}"
NATIONAL = r"(?<![0-9A-Za-z+.(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"
SOCIAL = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
#: Gazetteers.
DOMAINS = "com|org|net|edu|gov|info|biz|io|co|uk|us|de|fr|es|it|nl|at|ch|be|pt|eu|ca|au|jp|br|mx|test|example"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35)"
CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ACCOUNT_LANDS = "AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM"
#: Cue words before a span, and words that speak against it.
CUES = {
    "email": "mail|contact|write|address|kontakt|contacto|correo|courriel",
    "ip": r"\bip\b|host|server|address|login|from|client",
    "card": "card|visa|master|credit|debit|amex|karte|carte|tarjeta|pay",
    "phone": r"phone|tel\b|tel\.|call|mobile|cell|fax|contact|whatsapp|numéro|teléfono|telefon|anruf",
    "id": r"ssn|social|security|\bid\b|passport|identity",
    "account": "iban|account|bank|konto|compte|cuenta|transfer",
}
AGAINST = r"version|isbn|issn|section|chapter|order|invoice|ticket|serial|page|license|licence|doi|part no|model"
WINDOW = 48
LABELERS = ("strict", "shape", "edge", "gazetteer", "context")
ROUNDS, STEPS = 50, 300
SPAN = "array<struct<start:int,end:int,text:string>>"


def found(text: Column, pattern: str) -> Column:
    """All matches of ``pattern`` with their places in code points: gaps and matches add up to them."""
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["hit"])
        more = F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("text"))).alias("out"))
        return F.when(x["hit"].isNull(), acc).otherwise(more)

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), add)["out"]


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass the checksum: every second one from the right counts double, minus nine above nine."""
    n = F.length(number)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + (
        lambda d: F.when((n - i) % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))(F.substr(number, i, F.lit(1)).cast("int")))
    return total % 10 == 0


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substr(F.ltrim(p, F.lit("0")), F.lit(1), F.lit(3)).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(digits(text)).between(13, 19), luhn(digits(text))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(text)).between(9, 15)
    return F.lit(True)


def _passes(kind: str):  # noqa: ANN202
    return lambda span: _valid(kind, span["text"])


def _is_kind(kind: str):  # noqa: ANN202
    return lambda span: span["kind"] == kind


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the base patterns, by kind."""
    none = F.array().cast(SPAN)
    number = text.rlike("[0-9]")
    needs = {"email": text.contains("@"), "ip": number & text.rlike(r"[0-9]\.[0-9]"), "card": number, "phone": text.contains("+") & number}
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    return {k: F.when(needs[k], F.filter(found(text, p), _passes(k))).otherwise(none) for k, p in patterns.items()}


def loose_spans(text: Column) -> dict[str, Column]:
    """Further candidates, by kind."""
    none = F.array().cast(SPAN)
    needs = {"email": text.contains("dot") & text.contains("at"), "phone": text.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"), "id": text.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), "account": text.rlike("[A-Z]{2}[0-9]{2}")}
    patterns = {"email": SPELLED, "phone": NATIONAL, "id": SOCIAL, "account": ACCOUNT}
    return {k: F.when(needs[k], found(text, p)).otherwise(none) for k, p in patterns.items()}


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def votes(kind: str, base: bool, text: Column, span: Column) -> list[Column]:
    """Votes -1, 0 or 1 of the labelers on a span of ``text``."""
    hit, number = span["text"], digits(span["text"])
    before = F.lower(F.substr(text, F.greatest(span["start"] - WINDOW, F.lit(0)) + 1, F.least(span["start"], F.lit(WINDOW))))
    around = F.concat(F.right(before, F.lit(1)), F.lit(" "), F.substr(text, span["end"] + 1, F.lit(1)))
    never = F.lit(False)
    strict = {
        "phone": _vote(hit.rlike(r"^\(?[2-9][0-9]{2}\)?[\x20.-]?[2-9]"), ~hit.rlike(r"^\(?[2-9][0-9]{2}\)?[\x20.-]?[2-9]")),
        "id": _vote(~number.rlike("^(?:000|666|9)"), number.rlike("^(?:000|666|9)|^...00|0000$")),
        "account": _vote(F.length(F.replace(hit, F.lit(" "), F.lit(""))).between(15, 34), never),
    }.get(kind, F.lit(0)) if not base else F.lit(1)
    gazetteer = {
        "email": _vote(hit.rlike(rf"(?i)(?:\.|dot[\])\x20]+)(?:{DOMAINS})$"), never),
        "ip": _vote(F.split(hit, r"\.")[0].try_cast("int").between(1, 223), hit.rlike(r"^0+\.|^0+[0-9]")),
        "card": _vote(number.rlike(ISSUERS), never),
        "phone": _vote(hit.rlike(CALLING) | ~hit.startswith("+") & number.rlike("^[2-9]"), never),
        "account": _vote(hit.rlike(f"^(?:{ACCOUNT_LANDS})"), ~hit.rlike(f"^(?:{ACCOUNT_LANDS})")),
    }.get(kind, F.lit(0))
    return [
        strict,
        _vote(hit.rlike(r"[0-9][\x20().-]+[0-9]|^[A-Za-z][A-Za-z0-9]*[._][A-Za-z0-9]+"), number.rlike(r"^([0-9])\1{5,}$")),
        _vote(~around.rlike(r"[\p{L}\p{N}_@/\\=-]"), around.rlike(r"[\p{L}\p{N}_@/\\=]")),
        gazetteer,
        _vote(before.rlike(CUES[kind]), before.rlike(AGAINST)),
    ]


def _candidates(kind: str, base: bool, text: Column, spans: Column) -> Column:
    def row(span: Column) -> Column:
        size = F.least(F.floor(F.log2((span["end"] - span["start"]).cast("double")) - 2), F.lit(3))
        marks = votes(kind, base, text, span)
        return F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), span["start"].alias("start"), span["end"].alias("end"),
                        F.greatest(size, F.lit(0)).cast("int").alias("size"), *[v.alias(n) for v, n in zip(marks, LABELERS, strict=True)])

    return F.transform(spans, row)


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``spans``: all candidates of a text with the votes on them; looser ones overlap no base span."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), body.alias("body"))
    base, loose = base_spans(F.col("body")), loose_spans(F.col("body"))
    rows = rows.select("key", "body", *[c.alias(f"b_{k}") for k, c in base.items()], *[c.alias(f"l_{k}") for k, c in loose.items()])
    taken = F.concat(*[F.col(f"b_{k}") for k in base])
    rows = rows.select("key", "body", taken.alias("taken"), *[F.col(f"b_{k}") for k in base], *[F.col(f"l_{k}") for k in loose])

    def free(name: str) -> Column:
        return F.filter(F.col(name), lambda s: ~F.exists(F.col("taken"), lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"])))

    many = [_candidates(k, True, F.col("body"), F.col(f"b_{k}")) for k in base] + [_candidates(k, False, F.col("body"), free(f"l_{k}")) for k in loose]
    return rows.select("key", F.concat(*many).alias("spans"))


def reliabilities(patterns: list[tuple[tuple[int, ...], float]], rounds: int = ROUNDS) -> list[float]:
    """Posterior of every vote pattern by expectation-maximisation; patterns are (votes, count)."""
    n = len(LABELERS)
    post = [1 / (1 + math.exp(-sum(v))) for v, _ in patterns]
    for _ in range(rounds):
        mass = [sum(c * p for (_, c), p in zip(patterns, post, strict=True)), sum(c * (1 - p) for (_, c), p in zip(patterns, post, strict=True))]
        rates = [[[0.0] * 3 for _ in range(n)] for _ in range(2)]
        for (v, c), p in zip(patterns, post, strict=True):
            for i in range(n):
                rates[0][i][v[i] + 1] += c * p
                rates[1][i][v[i] + 1] += c * (1 - p)
        # pseudo-votes keep a labeler better than chance and the classes from swapping
        for y, lean in ((0, (1.0, 2.0, 4.0)), (1, (4.0, 2.0, 1.0))):
            rates[y] = [[(r + q) / (sum(row) + sum(lean)) for r, q in zip(row, lean, strict=True)] for row in rates[y]]
        prior = (mass[0] + 1) / (mass[0] + mass[1] + 2)
        post = []
        for v, _ in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(rates[0][i][v[i] + 1] / rates[1][i][v[i] + 1]) for i in range(n))
            post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return post


def _features(kind: str, size: int, marks: tuple[int, ...]) -> list[float]:
    return [1.0, *[float(kind == k) for k in KINDS], size / 3, *[float(v == 1) for v in marks], *[float(v == -1) for v in marks]]


def span_classifier(patterns: list[tuple[str, int, tuple[int, ...], float, float]], steps: int = STEPS) -> list[float]:
    """Logistic weights over kind, size and votes, fitted to (kind, size, votes, count, posterior)."""
    width = 2 + len(KINDS) + 2 * len(LABELERS)
    weights, total = [0.0] * width, sum(c for *_, c, _ in patterns) or 1.0
    rows = [(_features(k, s, v), math.sqrt(c / total), p) for k, s, v, c, p in patterns]
    scale = sum(c for _, c, _ in rows) or 1.0
    for _ in range(steps):
        gradient = [1e-3 * w for w in weights]
        for x, c, p in rows:
            z = sum(a * b for a, b in zip(x, weights, strict=True))
            gap = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * c / scale
            for i, a in enumerate(x):
                gradient[i] += gap * a
        weights = [w - 2.0 * g for w, g in zip(weights, gradient, strict=True)]
    return weights


def _score(span: Column, weights: list[float]) -> Column:
    """The classifier as an expression over a candidate."""
    at = 2 + len(KINDS)
    z = F.lit(weights[0]) + F.lit(weights[at - 1]) * span["size"] / 3
    for k, w in zip(KINDS, weights[1:], strict=False):
        z = z + F.when(span["kind"] == k, w).otherwise(0.0)
    for i, name in enumerate(LABELERS):
        z = z + F.when(span[name] == 1, weights[at + i]).when(span[name] == -1, weights[at + len(LABELERS) + i]).otherwise(0.0)
    return z


def personal_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``spans`` (kind, base, start, end, score): the base spans, and the candidates accepted."""
    rows = written(candidates(docs, key, text))
    each = rows.where(F.size("spans") > 0).select(F.explode("spans").alias("s")).groupBy("s.kind", "s.size", *[f"s.{n}" for n in LABELERS]).agg(F.count("*").alias("c"))
    table_rows = [(r["kind"], r["size"], tuple(r[n] for n in LABELERS), float(r["c"])) for r in each.orderBy("kind", "size", *LABELERS).collect()]
    post = reliabilities([(v, c) for _, _, v, c in table_rows])
    weights = span_classifier([(*r, p) for r, p in zip(table_rows, post, strict=True)])
    kept = F.filter(F.col("spans"), lambda s: s["base"] | (_score(s, weights) > 0))
    out = F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["base"].alias("base"), s["start"].alias("start"), s["end"].alias("end"), _score(s, weights).alias("score")))
    return rows.select(F.col("key").alias(key), out.alias("spans"))


def _joined(spans: Column) -> Column:
    """``kind:start:end`` by kind as listed, then start, comma-joined."""
    place = F.map_from_arrays(F.array(*[F.lit(k) for k in KINDS]), F.array(*[F.lit(i) for i in range(len(KINDS))]))
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(F.element_at(place, s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op10_pii")
def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    out = personal_spans(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, _is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return out.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
