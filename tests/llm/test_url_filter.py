import random
import re

import pytest
from pyspark.sql import functions as F

from driftloom.llm import url_filter
from driftloom.llm.url_filter import RULES, fit, host, judge, path

SCHEMA = "page_id long, url string, host string, _host string, score string, label string, kind string"


def parts(url):
    """Host and path in plain Python."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = re.match(r"[^/?#]*", rest).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), at), re.match(r"[^?#]*", rest[len(at) :]).group()


def brute(url, rules):
    at, start = parts(url)
    fits = [(len(r), len(r.split("/")[0]), v == "block", r, v) for r, v in rules if (at == r.split("/")[0] or at.endswith("." + r.split("/")[0])) and start.startswith(r[len(r.split("/")[0]) :])]
    return max(fits)[3:] if fits else (None, None)


AWKWARD = [
    None, "", "no scheme at all", "://", "http://", "HTTP://WWW.Example.COM/en/x?y=1#z", "http://www.example.com/en/", "http://a.www.example.com/en/1", "http://xwww.example.com/en/1",
    "http://example.com", "http://example.com?q=/en/", "http://example.com#/en/", "http://com/", "http://.com/x", "http://a..net/es/", "http://notnet/es/", "http://a.net/es", "http://a.net/fr/b.html?x=1&y=2&&z",
    "http://user:pw@a.net:80/fr/", "ftp://a.net/fr/ü/日本?é=ü", "http://ÉXAMPLE.net/es/", "x://y://example.com/en/", "http://a.net/es/\nsecond line", "http://a.org/" + "ab/" * 20_000, "http://" + "a." * 20_000 + "com/x",
    "http://a.org/" + "日本語😀" * 5_000,
]


def test_rules_equal_brute_force(spark):
    draw = random.Random(0)
    hosts = ["com", "example.com", "www.example.com", "net", "b.net", "x.b.net", "org", "c.example.com.", "xcom"]
    urls = AWKWARD + [f"http://{draw.choice(hosts)}/{draw.choice(['en', 'es', 'fr', 'e', ''])}{draw.choice(['/', ''])}{draw.randrange(99)}" for _ in range(400)]
    frame = spark.createDataFrame([(i, u, "h", "_", "s", "l", "k") for i, u in enumerate(urls)], SCHEMA).repartition(3)
    more = [*RULES, ("b.net/e", "block"), ("b.net/e", "allow"), ("net/e", "allow"), ("x.b.net/", "allow"), ("et/", "block")]
    for rules in (RULES, more):
        got = judge(frame, rules)
        assert got.columns == ["page_id", "url", "_host", "label", "kind", "host", "path", "rule", "verdict", "score"]
        rows = got.collect()
        assert sorted(r.page_id for r in rows) == list(range(len(urls)))
        for r in rows:
            rule, verdict = brute(r.url, rules)
            assert (r.host, r.path, r.rule) == (*parts(r.url), rule)
            assert r.verdict in ("allow", "block") and (rule is None or r.verdict == verdict) and (r.score is None) == (rule is not None)


def labelled(spark, n, seed):
    """URLs whose verdict lies in digits, parameters and the suffix of the host, with some noise in the rest."""
    draw = random.Random(seed)
    rows = []
    for _ in range(n):
        bad = draw.random() < 0.4
        word = "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randrange(4, 9)))
        name = f"{word}{draw.randrange(10**7)}" if bad and draw.random() < 0.8 else word
        end = draw.choice(["top", "biz", "com"]) if bad else draw.choice(["com", "org", "edu"])
        asked = "?" + "&".join(f"p{i}={draw.randrange(999)}" for i in range(draw.randrange(2, 6))) if bad and draw.random() < 0.7 else ""
        rows.append((f"https://{name}.{end}/{word}/{draw.randrange(99)}{asked}", int(bad)))
    return spark.createDataFrame(rows, "url string, blocked int")


def test_held_out_accuracy(spark):
    model = fit(labelled(spark, 1500, 1))
    held = labelled(spark, 700, 2).withColumns({"_host": host(F.col("url")), "_path": path(F.col("url"))})
    right = model.scored(held, "url").select(F.avg(((F.col("_score") >= 0.5).cast("int") == F.col("blocked")).cast("double"))).first()[0]
    assert right > 0.93


def test_own_fold_is_left_out(spark):
    """A host seen once has the overall share in training, whatever its own label."""
    known = [(f"http://h{i}.org/a", i % 2) for i in range(40)]
    model = fit(spark.createDataFrame(known, "url string, blocked int"))
    rows = spark.createDataFrame(known, "url string, blocked int").withColumns({"_host": host(F.col("url")), "_path": path(F.col("url")), "_fold": F.pmod(F.xxhash64("url"), F.lit(url_filter.FOLDS)).cast("int")})
    shares = [r._features[len(r._features) - 6] for r in model.inputs(url_filter._prepared(rows, "url"), True).collect()]
    assert all(s == pytest.approx(model.overall) for s in shares)


def test_one_verdict_or_no_label(spark):
    frame = spark.createDataFrame([(1, "http://a.com/x", *"abcde"), (2, "http://b.org/y", *"abcde"), (3, None, *"abcde")], SCHEMA)
    assert {r.page_id: r.verdict for r in judge(frame, [("com/", "block")]).collect()} == {1: "block", 2: "block", 3: "block"}
    assert {r.verdict for r in judge(frame, []).collect()} == {"allow"}
    assert judge(spark.createDataFrame([], SCHEMA), RULES).collect() == []
    with pytest.raises(ValueError, match="is not a host"):
        judge(frame, [("com/", "maybe")])


def test_same_text_same_verdict(spark):
    urls = [f"http://a{i % 7}.{'com' if i % 2 else 'net'}/{'en' if i % 3 else 'es'}/{i % 11}" for i in range(200)] + [f"http://b{i % 5}.org/en/{i % 3}" for i in range(50)]
    frame = spark.createDataFrame([(i, u, *"abcde") for i, u in enumerate(urls)], SCHEMA)
    one = {r.page_id: r.verdict for r in judge(frame.coalesce(1), RULES).collect()}
    assert one == {r.page_id: r.verdict for r in judge(frame.repartition(7), RULES).collect()}
    by = {}
    for i, u in enumerate(urls):
        assert by.setdefault(u, one[i]) == one[i]
