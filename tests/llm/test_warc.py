import random

import pytest
from pyspark.sql import functions as F

from riskframe.llm import warc

SCHEMA = (
    "record_id long, url string, date long, kind string, etag string, last_modified string, "
    "digest string, headers map<string,string>, range int, about string, full string"
)
CANON = {
    "http://A.example/x?b=1&a=2#f": "a.example/x?a=2&b=1",
    "https://www.a.example:443/x/": "a.example/x",
    "http://u:p@m.a.example:8080/x//?utm_source=k&&ref=1": "a.example:8080/x",
    " https://a.example ": "a.example",
    "https://a.example?q=1": "a.example?q=1",
    "no address": None,
    "": None,
    None: None,
    "http:///path": None,
}


def test_canonical_urls(spark):
    table = spark.createDataFrame([(u,) for u in CANON], "url string")
    found = dict(table.select("url", warc.canonical_url(F.col("url"))).collect())
    assert found == CANON


def records(seed=2, number=400):
    random.seed(seed)
    urls = ["http://hot.example/"] * 6 + [f"http://a.example/{i}" for i in range(8)] + ["https://www.hot.example", None, "x"]
    made = []
    for i in range(number):
        full = random.random() < 0.3
        made.append(
            (
                i if random.random() < 0.98 else None, random.choice(urls),
                random.choice([None] + list(range(60))), "response" if full else random.choice(["revisit", "revisit", "metadata"]),
                random.choice([None, '"a"', 'W/"a"', '"b"']), random.choice([None, "mon", "tue"]),
                random.choice(["d1", "d2"]) if full else random.choice([None, None, None, "d1"]),
                random.choice([None, {}, {"Age": "1", "Server": "s"}, {"ETag": str(i), "content-length": "0", "AGE": "7"}]),
                1, "x", "y",
            )
        )
    return made + made[:5]


def brute(made):
    order = lambda r: (r[2], -1 if r[0] is None else r[0])
    found = []
    for r in made:
        if r[3] != "revisit":
            continue
        url = CANON.get(r[1], r[1] and {"http://hot.example/": "hot.example", "https://www.hot.example": "hot.example"}.get(r[1], r[1].removeprefix("http://") if "//" in r[1] else None))
        earlier = [
            o for o in made
            if o[3] == "response" and url is not None and r[2] is not None and o[2] is not None
            and canon(o[1]) == url and order(o) < order(r)
        ]
        if not earlier:
            found.append((r[0], url, r[2], "missing", None, None, None, None))
            continue
        o = max(earlier, key=order)
        bare = lambda e: e and e.removeprefix("W/")
        agree = None
        if r[4] is not None:
            agree = bare(o[4]) == bare(r[4])
        elif r[5] is not None:
            agree = o[5] == r[5]
        if r[6] is not None:
            agree = (agree is not False) and o[6] == r[6]
        outcome = "unchecked" if agree is None else "resolved" if agree else "changed"
        headers = None
        if agree is not False:
            new = {k.lower(): v for k, v in (r[7] or {}).items() if k.lower() in warc.PERMITTED}
            headers = tuple(sorted(({k.lower(): v for k, v in (o[7] or {}).items()} | new).items()))
        found.append((r[0], url, r[2], outcome, o[0], o[2], o[6] if agree is not False else None, headers))
    return found


def canon(url):
    if url is None or "//" not in url:
        return None
    return url.split("//")[1].removeprefix("www.").rstrip("/")


@pytest.mark.parametrize("partitions", [1, 13])
def test_revisits_equal_brute_force(spark, partitions):
    made = records()
    # Where date and id tie between a response and a revisit the order is fixed by the kind.
    made = [r for r in made if r[0] is not None or r[3] != "response"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = warc.resolve_revisits(spark.createDataFrame(made, SCHEMA).repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    found = [
        (*r[:7], None if r.headers is None else tuple(sorted(r.headers.items()))) for r in rows
    ]
    assert sorted(map(repr, found)) == sorted(map(repr, brute(made)))


def test_empty_table(spark):
    assert warc.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0
