import math

import numpy as np
import pytest

from quern.llm import urls as U

CASES = [
    ("https://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://x.net/de", "x.net", "/de", "net/", "block"),
    ("http://example.com/de/a", "example.com", "/de/a", "example.com/de/", "block"),
    ("http://myexample.com/de/a", "myexample.com", "/de/a", None, None),
    ("ftp://org/fr/", "org", "/fr/", "org/fr/", "allow"),
    ("http://x.org#/fr/", "x.org", "", None, None),
    ("http://net", "net", "", None, None),
    ("http://?a://b.net/", "", "", None, None),
    ("no scheme net/", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("http://É.NET/\nb?c", "É.net", "/\nb", "net/", "block"),
]


def pages(spark, urls):
    return spark.createDataFrame([(k, u, "<p>", "a", "b") for k, u in enumerate(urls)], "page_id long, url string, html string, host string, verdict string")


def test_rules(spark):
    rows = U.with_rules(pages(spark, [c[0] for c in CASES])).orderBy("page_id").collect()
    assert [(r._url, r.host, r.path, r.rule, r.ruled) for r in rows] == CASES


def slow(strings, text):
    """Witten-Bell by dictionaries."""
    seen = {}
    for s in strings:
        s = b"\0" * U.ORDER + s
        for i in range(U.ORDER, len(s)):
            for k in range(U.ORDER + 1):
                seen.setdefault(s[i - k : i], {}).setdefault(s[i], 0)
                seen[s[i - k : i]][s[i]] += 1
    total, t = 0.0, b"\0" * U.ORDER + text
    for i in range(U.ORDER, len(t)):
        p = 1 / 256
        for k in range(U.ORDER + 1):
            f = seen.get(t[i - k : i])
            if f:
                p = (f.get(t[i], 0) + len(f) * p) / (sum(f.values()) + len(f))
        total += math.log(p)
    return total


def test_model_by_hand(spark, monkeypatch):
    monkeypatch.setattr(U, "MIN_BITS", 20)
    monkeypatch.setattr(U, "MAX_BITS", 20)
    urls = [f"http://good{k}.example.net/en/page{k}" for k in range(30)] + [f"http://spam{k}.net/buy{k}" for k in range(30)]
    ruled = U.with_rules(pages(spark, urls))
    model = U.train(ruled)
    import zlib

    kept = [u.encode() for u in urls if zlib.crc32(u.encode()) % 5]
    good, bad = [u for u in kept if b"example" in u], [u for u in kept if b"example" not in u]
    for text in (b"http://good7.example.com/en/page", b"x", b"http://spam.com/buy"):
        assert model.differences([b"zz", text])[1] == pytest.approx((slow(good, text) - slow(bad, text)) / len(text), abs=1e-4)
    rows = {r._url: r.verdict for r in U.judge(U.with_rules(pages(spark, ["http://good.example.com/en/page9", "http://spam4.com/buy4", "", None])), model).collect()}
    assert rows == {"http://good.example.com/en/page9": "allow", "http://spam4.com/buy4": "block", "": "allow", None: "allow"}


def test_without_training_strings(spark, tmp_path):
    pages(spark, ["http://a.com/", None, "http://a.com/"]).write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.verdict for r in U.op8_url_language_model(spark, str(tmp_path)).collect()} == {"allow"}
    ruled = U.with_rules(pages(spark, []))
    assert U.judge(ruled, U.train(ruled)).count() == 0


def test_query(spark, sf):
    rows = U.op8_url_language_model(spark, sf).collect()
    assert {r.verdict for r in rows} <= {"allow", "block"}
    verdict = dict(U.RULES)
    assert all(r.verdict == verdict[r.rule] for r in rows if r.rule) and any(r.rule for r in rows)
    assert all((r.difference is None) == (r.rule is not None) and (r.difference is None or np.isfinite(r.difference)) for r in rows)


def test_counts_grow_with_the_urls(spark):
    """At the production setting, many unlike urls do not blur each other's counts."""
    r = np.random.default_rng(8)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz0123456789"))
    word = lambda: "".join(r.choice(letters, 12))
    urls = [f"http://a.example.net/en/{word()}" if k % 2 else f"http://b.net/{word()}" for k in range(12_000)]
    model = U.train(U.with_rules(pages(spark, urls)))
    import zlib

    kept = [u.encode() for u in urls if zlib.crc32(u.encode()) % 5]
    good, bad = [u for u in kept if b"example" in u], [u for u in kept if b"example" not in u]
    texts = [f"http://c.org/{word()}".encode() for _ in range(5)] + [good[7], bad[7]]
    assert model.differences(texts) == pytest.approx([(slow(good, t) - slow(bad, t)) / len(t) for t in texts], abs=1e-6)
