"""Registered domains by rules against a plain version, on 200 hosts and more."""

import random

from pyspark.sql import functions as F

from pagelume.operators import suffixes as S

RULES = ["// a comment", "", "com", "uk", "co.uk  trailing words", "*.ck", "!www.ck", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "kobe.jp", "рф", "github.io", "io", "COM"]


def plain(host):
    labels = host.split(".")
    best, exception = 1, False
    for line in RULES:
        rule = line.split()[0].lower() if line.split() else ""
        if not rule or rule.startswith("//"):
            continue
        mark, want = rule.startswith("!"), rule.removeprefix("!").split(".")
        if len(want) <= len(labels) and all(w in ("*", x) for w, x in zip(want[::-1], labels[::-1])):
            size = len(want) - mark
            if (mark, size) > (exception, best):
                best, exception = size, mark
    return ".".join(labels[-best - 1 :]) if len(labels) > best else None


def test_rules(spark):
    rng = random.Random(5)
    labels = ["a", "www", "city", "x-y", "co", "kobe", "kawasaki", "github"]
    ends = ["com", "co.uk", "uk", "ck", "www.ck", "b.ck", "jp", "kawasaki.jp", "city.kawasaki.jp", "kobe.jp", "рф", "github.io", "io", "unknown"]
    hosts = sorted({".".join([*rng.choices(labels, k=rng.randrange(4)), rng.choice(ends)]) for _ in range(600)})
    assert len(hosts) > 200
    rows = [(f"https://{h}/p?q", h) for h in hosts] + [("http://10.0.0.1:80/", None), ("", None), (None, None), ("HTTPS://User@A.B.CO.UK.:8443/x", "a.b.co.uk")]
    rules = S.rules_of(spark.createDataFrame([(r,) for r in RULES], "rule string"))
    df = spark.createDataFrame(rows, "url string, host string").withColumn("domain", F.lit("old")).repartition(3)
    out = S.with_domain(df, F.col("url"), rules).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.domain == (plain(r.host) if r.host else None), r
    assert S.with_domain(df.limit(0), F.col("url"), rules).count() == 0 and S.with_domain(df, F.col("url"), rules.limit(0)).where("host = 'a.b.co.uk'").first() is not None


def test_file_of_rules(spark, tmp_path):
    (tmp_path / "rules.dat").write_text("\n".join(RULES))
    got = {tuple(r) for r in S.read_rules(spark, f"file://{tmp_path}/rules.dat").collect()}
    assert ("ck", "wildcard") in got and ("www.ck", "exception") in got and ("co.uk", "plain") in got and len(got) == 12
