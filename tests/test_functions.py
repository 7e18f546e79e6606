"""Expected values of single functions and operators."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanings.functions import dates, html, text, urls
from gleanings.operators import aggs, crawl, dedup, filters, quality, windows
from gleanings.sources import io


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("function", "given", "wanted"),
    [
        (urls.normalize_url, "https://a.org/p/?utm_source=x&id=5&k=#f", "https://a.org/p?id=5"),
        (urls.normalize_search_url, "https://a.org/p/?utm_source=x&id=5&k=#f", "https://a.org/p?id=5&k="),
        (urls.normalize_url, "HTTP://A.org/", "http://A.org/"),
        (urls.normalize_search_url, "HTTP://A.org/", "http://a.org/"),
        (urls.normalize_search_url, "ftp://a.org/", ""),
        (urls.url_key, "https://www.A.org/x/?q=1#z", "a.org/x?q=1"),
        (urls.classify_url, "https://e.org/company/blog/post-x", "article"),
        (urls.classify_url, "https://e.org/about-us/team", "soft"),
        (urls.classify_url, "https://e.org/x/y/privacy-policy", "hard"),
        (urls.classify_url, "https://e.org/news", "index"),
        (urls.classify_url, "https://e.org/a/b/index.php", "index"),
        (urls.media_url, "//h.example/a.png", "https://h.example/a.png"),
        (urls.media_url, "https://h.example/a.jpg 100w, b.jpg 2x", "https://h.example/a.jpg"),
        (urls.media_url, "https://p.example/?url=https%3A%2F%2Fh.example%2Fa.png", "https://h.example/a.png"),
        (urls.media_url, "data:image/png;base64,x", None),
        (urls.public_url, "http://10.0.0.1/x", False),
        (urls.public_url, "https://example.org/x", True),
        (urls.media_url_triage, "https://i/a.png", "test data"),
        (urls.safe_dir_name, "..", "uncategorized"),
        (urls.safe_dir_name, "con.txt", "_con.txt"),
        (urls.is_furniture, "https://h.example/assets/logo.svg", True),
        (urls.is_furniture, "https://h.example/1921x1080.jpg", False),
        (urls.is_furniture, "https://h.example/1x1.gif", True),
        (dates.parse_date, "Sat, 28 Jun 2025 10:30:00 GMT", datetime(2025, 6, 28, 10, 30)),
        (dates.parse_date, "2026年6月28日", datetime(2026, 6, 28)),
        (dates.parse_date, "in 2019 or so", datetime(2019, 1, 1)),
        (dates.parse_date, "none", None),
        (urls.media_url, "https://h.example/a b\\u003d.png", "https://h.example/a%20b=.png"),
        (text.atomize_query, "安全以及隐私与平等", "安全 隐私 平等"),
        (text.topic_terms, "大模型，真的 安全吗？为什么", "大模型 安全吗"),
        (text.topic_terms, "What is new, really?", "What is new really"),
        (text.canonical_media, "../../a.png?x=1&amp;y=2", "/a.png?x=1&y=2"),
        (text.atomize_query, "大模型水印的识别与去除技术", "大模型水印 识别 去除"),
        (text.atomize_query, "参与目的", "参与目的"),
        (text.atomize_query, "水印以及甲与识别", "水印 甲 识别"),
        (text.atomize_query, "甲乙与丙和丁戊", "甲乙 丙 丁戊"),
        (text.topic_terms, "到真的底好", "到底好"),
        (lambda t: text.leaked_reasoning(t, ["I Will"]), "", False),
        (lambda t: text.leaked_reasoning(t, ["I Will"]), "### Head\nx", False),
        (lambda t: text.leaked_reasoning(t, ["I Will"]), "\n  i wiLL look\n## a", True),
        (lambda t: text.leaked_reasoning(t, ["I Will"]), "short", True),
        (quality.contact_of, "加微信: abc_123 or vx zzz9999", "加微信: abc_123"),
        (quality.contact_of, "our WeChat account abcdef", None),
        (quality.contact_of, "our WeChat： abcdef.", "WeChat： abcdef"),
        (quality.contact_of, "wx: first77, 微信号second88", "微信号second88"),
        (urls.is_site_chrome, "https://h/a/footer-logo.svg", True),
        (urls.is_site_chrome, "https://h/a/logo.svg?x", False),
        (urls.is_site_chrome, "https://h/apple.touch-icon.PNG", True),
        (urls.is_site_chrome, "https://h/favicon-32x32.ico?v=1", True),
        (urls.is_site_chrome, "https://h/favicon/a.ico", False),
        (urls.is_site_chrome, "https://h/Loading.gif#x", True),
        (urls.is_site_chrome, "https://h/my__ScaleWidth.jpg", True),
        (urls.is_site_chrome, "plain", False),
        (text.shorten_query, "alpha beta", "alpha"),
        (filters.required_length, 299, 0),
        (filters.required_length, 1499, 1499),
        (filters.required_length, 10000, 2000),
        (filters.required_length, 20000, 3000),
        (aggs.skip_reason, "HTTP 503 Service", "5xx"),
    ],
)
def test_values(spark, function, given, wanted):
    assert one(spark, function(F.lit(given))) == wanted


def test_references_split_and_join(spark):
    body = "text\n\n## References\nold\n\nmore\n\n---\n\n## References\n- one"
    a, b = text.split_references(F.lit(body))
    row = spark.range(1).select(a.alias("a"), b.alias("b")).first()
    assert row.a + row.b == body and row.b.startswith("---") and "old" in row.a


def test_dashes(spark):
    body = "one —— two.\nend——\n```\na——b\n```\nfive，——six"
    assert one(spark, text.normalize_dashes(F.lit(body))) == "one，two.\nend\n```\na——b\n```\nfive，six"


def test_reply_indexes(spark):
    got = {r: one(spark, text.parse_indexes(F.lit(r))) for r in ("[0, 2]", "keep ['x'] [1]", "[]", '[{"index": 1}]', '["3"]', "nothing")}
    assert got["[0, 2]"] == [0, 2] and got["[]"] == [] and got['[{"index": 1}]'] == [1] and got['["3"]'] == [3] and got["nothing"] is None


def test_edges(spark):
    found = one(spark, text.edges_of(F.lit("A --> B --> C\nA -->|why| C\nstray\nB --> B\nA --> B")))
    assert [(e.src, e.dst) for e in found] == [("A", "B"), ("B", "C"), ("A", "C")]


def test_source_diversity(spark):
    rows = spark.createDataFrame(list(enumerate("aaab")), "rank long, source string")
    assert [r.source for r in windows.source_diverse_topk(rows, 3).collect()] == list("aab")
    assert [r.source for r in windows.source_diverse_topk(rows, 4).collect()] == list("aaba")


def test_budget_and_hotness(spark):
    rows = spark.createDataFrame([(i, 1, 3000) for i in range(8)], "i long, k long, n int")
    assert [r.given for r in windows.source_budget(rows, "k", "i", F.col("n")).orderBy("i").collect()] == [2500] * 7 + [500]
    stats = spark.createDataFrame([("x", 30)], "name string, total long")
    assert aggs.hotness(stats, None, spark.createDataFrame([("x", 20)], "name string, hits long")).first().score == 95.0


def test_scores(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    assert one(spark, quality.heuristic_score(F.lit("abc"), F.lit(""), F.lit(""), F.lit(None).cast("timestamp"), now, [])) == 35.0
    docs = spark.createDataFrame([(1, "x" * 50 + " hit " + "y" * 45)], "doc_id long, text string")
    assert quality.flavor_points(docs, [quality.Dimension("d", 12.0, 2.5, ("hit",))]).first().points == pytest.approx(3.6)
    even = spark.createDataFrame([(1, "abcdef. " * 8)], "doc_id long, text string")
    assert quality.rhythm(even, enders=".").first().points == pytest.approx(10.0)


def test_series_status(spark):
    chapters = spark.createDataFrame([(1, "done"), (1, "failed"), (2, "done"), (2, "done"), (3, "failed"), (5, "done"), (5, "writing")], "series_id long, status string")
    series = spark.createDataFrame([(i,) for i in range(1, 6)], "series_id long")
    got = {r.series_id: r.status for r in aggs.series_status(series, chapters).collect()}
    assert got == {1: "partial", 2: "done", 3: "failed", 4: "failed", 5: "running"}


def test_image_list(spark):
    df = spark.createDataFrame([(1, ["/logo.svg", "/a.jpg", "/b.jpg"], "x [[IMG:0]] y [[IMG:2]]")], "page_id long, images array<string>, body string")
    row = crawl.clean_image_list(df).first()
    assert row.images == "/a.jpg\n/b.jpg" and row.body == "[[IMG:0]]\n\nx  y [[IMG:1]]"


def test_near_pairs_against_brute_force(spark):
    texts = ["abcdefghijklmnop", "abcdefghijklmnoq", "bcdefghijklmnop", "zzzz", "", "abcdefghijklmnop", "unrelated words here", "abcde"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: {t.replace(" ", "")[k : k + 5] for k in range(max(1, len(t.replace(" ", "")) - 4))} for i, t in enumerate(texts) if t}
    assert {tuple(r) for r in dedup.shingle_classes(df, "doc_id", F.col("text"))[0].select("id", "class_id").collect()} == {(i, min(k for k, y in sets.items() if x == y)) for i, x in sets.items()}
    sets = {i: x for i, x in sets.items() if all(x != y for k, y in sets.items() if k < i)}  # pairs are pairs of classes
    wanted = set()
    for a, x in sets.items():
        for b, y in sets.items():
            if a != b and (len(x), a) < (len(y), b) and len(x & y) * 100 >= 82 * len(x):
                wanted.add((a, b, len(x & y), len(x)))
    assert {tuple(r) for r in dedup.near_pairs(df, "doc_id", F.col("text")).collect()} == wanted
    kept = {tuple(r) for r in dedup.near_duplicates(df, "doc_id", "text").collect()}
    assert {k[0] for k in kept} == {0, 3, 4, 6}


def slow_near_duplicates(texts):
    """In order, each text against what is kept so far; a longer near one takes the place."""
    def signature(t):
        t = "".join(c for c in t.lower() if c.isalnum() or c == "_")
        return {t[k : k + 5] for k in range(max(1, len(t) - 4))} if t else set()

    kept = []
    for i, t in enumerate(texts):
        mine = signature(t)
        for k in kept:
            if mine and k[2] and len(mine & k[2]) >= 0.82 * min(len(mine), len(k[2])):
                if len(t) > len(texts[k[1]]):
                    k[1:] = [i, mine]
                break
        else:
            kept.append([i, i, mine])
    return {(k[0], k[1]) for k in kept}


def test_near_duplicates_follow_the_order(spark):
    import random

    r = random.Random(5)
    bases = ["".join(r.choice("abcdefghij") for _ in range(60)) for _ in range(4)]

    def changed(t):
        at = r.randrange(len(t))
        return t[:at] + r.choice("xyz") + t[at + r.randint(0, 2) :] + r.choice(["", "", "!", "klmno", "!!"])

    texts = []
    for _ in range(120):
        t = r.choice(bases)
        for _ in range(r.randint(0, 5)):
            t = changed(t)
        texts.append(r.choice([t, t, t + ".", ""]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {tuple(x) for x in dedup.near_duplicates(df, "doc_id", "text").collect()} == slow_near_duplicates(texts)


def test_rounds_decide_as_the_order_does(spark):
    """Random links between classes with several documents each: rounds end where one group that reads them in order does."""
    import random

    import pandas as pd

    r = random.Random(8)
    classes = sorted(r.sample(range(200), 14))
    ids = [*classes, *r.sample(range(201, 400), 26)]
    rows = [(i, i if i in classes else r.choice([c for c in classes if c < i]), r.randint(1, 9)) for i in ids]
    links = {(a, b) for a in classes for b in classes if a < b and r.random() < 0.2}
    both = links | {(b, a) for a, b in links}
    frame = pd.DataFrame([(i, c, n, [b for a, b in both if a == i] if i == c else None) for i, c, n in rows], columns=["id", "class_id", "chars", "near"])
    wanted = {tuple(x) for x in dedup._follow(frame).itertuples(index=False)}
    got = dedup.follow_in_rounds(spark.createDataFrame(rows, "id long, class_id long, chars int"), spark.createDataFrame(sorted(both), "a long, b long"))
    assert {tuple(x) for x in got.collect()} == wanted


def test_rounds_are_few_in_one_family(spark, monkeypatch):
    """Near copies that all meet and a chain behind them: rounds go by the number of links, not by how many decisions follow each other."""
    import random

    import pandas as pd

    r = random.Random(3)
    n = 60
    links = {(a, b) for a in range(n) for b in range(n) if a != b} | {x for i in range(n - 1, 2 * n) for x in ((i, i + 1), (i + 1, i))}
    rows = [(i, i, r.randint(1, 9)) for i in range(2 * n + 1)] + [(7, 7, 9), (2**60 + 1, 90, 8)]  # an id twice, and one that a double does not hold
    both = {c: [b for a, b in links if a == c] for c in range(2 * n + 1)}
    wanted = {tuple(x) for x in dedup._follow(pd.DataFrame([(i, c, m, both[c]) for i, c, m in rows], columns=["id", "class_id", "chars", "near"])).itertuples(index=False)}
    frame, linked = spark.createDataFrame(rows, "id long, class_id long, chars int"), spark.createDataFrame(sorted(links), "a long, b long")
    writes = []
    monkeypatch.setattr(dedup, "written", lambda df, *a, f=dedup.written, **b: writes.append(1) or f(df, *a, **b))
    assert {tuple(x) for x in dedup.follow_in_rounds(frame, linked).collect()} == wanted and len(writes) < 20
    monkeypatch.setattr(dedup, "ROUND", 2500)
    assert {tuple(x) for x in dedup.follow_in_rounds(frame, linked).collect()} == wanted


def test_minhash_finds_nine_of_ten_pairs(spark, monkeypatch):
    import random

    r = random.Random(2)
    texts = []
    for _ in range(60):
        base = [r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400)]
        texts.append("".join(base))
        for _ in range(3):
            other = list(base)
            for _ in range(r.randint(1, 8)):
                other[r.randrange(400)] = r.choice("0123456789")
            texts.append("".join(other))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    exact = {(x.a, x.b) for x in dedup.near_pairs(df, "doc_id", F.col("text"), metric="jaccard").collect()}
    _, sets = dedup.shingle_classes(df, "doc_id", F.col("text"))
    found = {(x.a, x.b) for x in dedup.minhash_pairs(sets).collect()}
    grams = [{t[k : k + 5] for k in range(len(t) - 4)} for t in texts]
    near = {(a, b) for a in range(len(texts)) for b in range(len(texts)) if a != b and (len(grams[a]), a) < (len(grams[b]), b) and len(grams[a] & grams[b]) * 100 >= 82 * len(grams[a] | grams[b])}
    assert exact == near and len(exact) > 150
    assert found <= exact and len(found) >= 0.9 * len(exact)
    monkeypatch.setattr(dedup, "MOST_IN_BUCKET", 2)  # larger buckets make stars: fewer pairs, none wrong
    assert {(x.a, x.b) for x in dedup.minhash_pairs(sets).collect()} <= exact


@pytest.mark.parametrize("size", [1, 9, 40, 300, 5000])
def test_minima_agree_by_similarity(size):
    """Minima are hashes of the set itself, one for a range, and two sets have as many in common as their similarity says, whatever their size."""
    r = np.random.default_rng(size)
    agreed, wanted = [], []
    for _ in range(60):
        union = r.integers(0, 2**64, size + size // 10, np.uint64)
        a, b = np.sort(union[:size]), np.sort(union[len(union) - size :])
        x, y = dedup._minima(a), dedup._minima(b)
        assert len(x) == 128 and np.isin(x, a).all() and (size < 5000 or (x >> np.uint64(57)).tolist() == list(range(128)))
        agreed.append((x == y).mean())
        wanted.append(len(np.intersect1d(a, b)) / len(union))
    assert abs(np.mean(agreed) - np.mean(wanted)) < 0.03


@pytest.mark.parametrize("most", [7, 512])
def test_large_buckets_keep_all_their_pairs(spark, monkeypatch, most):
    """A family of which most members meet in the same bands: each pair of a bucket is found, once, as from all shared keys."""
    import random

    r = random.Random(10)
    base = [r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(900)]
    texts = ["".join(base[:k] + [r.choice("0123456789")] + base[k + 1 :]) for k in r.sample(range(900), 110)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, sets = dedup.shingle_classes(df, "doc_id", F.col("text"))
    shingles = [dedup.shingle_set(t) for t in texts]
    keys = dedup._band_keys([dedup._minima(s) for s in shingles])
    size = [len(s) for s in shingles]
    meeting = {(a, b) for a in range(110) for b in range(110) if (size[a], a) < (size[b], b) and (keys[a] == keys[b]).any()}
    near = {(a, b) for a, b in meeting if 100 * (k := len(np.intersect1d(shingles[a], shingles[b]))) >= 82 * (size[a] + size[b] - k)}
    monkeypatch.setattr(dedup, "MOST_IN_BUCKET", most)
    found = [(x.a, x.b) for x in dedup.minhash_pairs(sets).collect()]
    assert len(found) == len(set(found)) and set(found) == near and len(near) > 5000


def test_near_pairs_across_blocks(spark, monkeypatch):
    """Sets of very different sizes in many small blocks: no pair is lost, none is wrong, by either metric."""
    import random

    r = random.Random(4)
    base = ["".join(r.choice("abcdefgh") for _ in range(600)) for _ in range(3)]
    texts = [b[i : i + r.choice([3, 6, 30, 200, 500])] for b in base for i in (r.randrange(100) for _ in range(30))] + base + [b + "𝒳é" for b in base]
    texts += ["".join(r.choice("xyz") if r.random() < 0.02 else c for c in b) for b in base for _ in range(5)]
    grams = {i: frozenset(t[k : k + 5] for k in range(max(1, len(t) - 4))) for i, t in enumerate(texts)}
    first = {x: min(i for i in grams if grams[i] == x) for x in grams.values()}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(dedup, "BLOCK_LETTERS", 2000)
    for metric in ("overlap", "jaccard"):
        wanted = {(a, b, len(x & y), len(x)) for x, a in first.items() for y, b in first.items() if (len(x), a) < (len(y), b) and len(x & y) * 100 >= 82 * (len(x) if metric == "overlap" else len(x | y))}
        assert {tuple(p) for p in dedup.near_pairs(df, "doc_id", F.col("text"), metric=metric).collect()} == wanted


@pytest.mark.parametrize("metric", ["overlap", "jaccard"])
def test_blocks_compare_by_exact_marks(monkeypatch, metric):
    """Pairs of two blocks without a sort a pair, few rows and hashes at a time; hashes that differ in their last bits only are told apart."""
    r = np.random.default_rng(4)
    pool = np.concatenate((r.integers(0, 2**63, 300), (1 << 40) + np.arange(60)))
    sets = sorted((np.unique(np.concatenate((r.choice(pool[k : k + 90], r.integers(5, 85), replace=False), pool[300:][: r.integers(0, 60)]))) for k in r.integers(0, 200, 90)), key=len)
    monkeypatch.setattr(dedup, "_shared", None)
    monkeypatch.setattr(dedup, "PLACES", 500)
    x, y = (dedup._Block.of([i for i, _ in part], [s.tolist() for _, s in part], 5) for part in (list(enumerate(sets))[:50], list(enumerate(sets))[50:]))
    assert (x.hashes[np.argsort(x.code_of)][x.code] == np.concatenate(sets[:50]).view(np.uint64)).all()
    for one, two in ((x, x), (x, y), (y, y)):
        found = [p for v in dedup._met(one, two, 82, metric) for p in zip(*(c.tolist() for c in v), strict=True)]
        both = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a in one.ids.tolist() for b in two.ids.tolist() if a < b}
        near = {(a, b, k, len(sets[a])) for (a, b), k in both.items() if k * 100 >= 82 * (len(sets[a]) if metric == "overlap" else len(sets[a]) + len(sets[b]) - k)}
        assert len(found) == len(set(found)) and set(found) == near
    assert near


@pytest.mark.parametrize("found", ["classes", "overlap", "jaccard", "kept", "minhash"])
def test_near_duplicates_write_no_shingles(spark, tmp_path, monkeypatch, found):
    """What is written on the way is no more than the texts; for the classes it is two keys of each."""
    import random
    import uuid

    from gleanings import session

    r = random.Random(6)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4000)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(session, "scratch", lambda _: f"file://{tmp_path}/{uuid.uuid4().hex}")
    if found == "classes":
        dedup.shingle_classes(df, "doc_id", F.col("text"))[0].collect()
    elif found in ("kept", "minhash"):
        assert dedup.near_duplicates(df, "doc_id", "text", approximate=found == "minhash").count() == 200
    else:
        assert dedup.near_pairs(df, "doc_id", F.col("text"), metric=found).count() == 0
    size = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    assert size < sum(map(len, texts)) * (0.1 if found == "classes" else 1.5)


def test_minhash_writes_keys_and_no_texts(spark, tmp_path, monkeypatch):
    """Texts that meet no other one are read once, and neither they nor their sets are written."""
    import random
    import uuid

    from gleanings import session

    r = random.Random(7)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4000)) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts + texts[:3] + ["", "!!"])), "doc_id long, text string")
    monkeypatch.setattr(session, "scratch", lambda _: f"file://{tmp_path}/{uuid.uuid4().hex}")
    assert {tuple(x) for x in dedup.near_duplicates(df, "doc_id", "text", approximate=True).collect()} == {(i, i) for i in [*range(100), 103, 104]}
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 0.6 * sum(map(len, texts))


def test_minhash_pairs_in_many_tiles(spark, monkeypatch):
    """Families larger than a block: tiles lose no pair, and the chosen documents are those of one tile."""
    import random

    r = random.Random(9)
    texts = []
    for _ in range(4):
        base = [r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(500)]
        texts += ["".join(c if r.random() > 0.004 else r.choice("0123456789") for c in base) + r.choice(["", "!", "?!"]) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(texts + texts[:5])), "doc_id long, text string").repartition(3)
    _, sets = dedup.shingle_classes(df, "doc_id", F.col("text"))
    whole = {tuple(x) for x in dedup.minhash_pairs(sets).collect()}
    kept = {tuple(x) for x in dedup.near_duplicates(df, "doc_id", "text", approximate=True).collect()}
    exact = {tuple(x) for x in dedup.near_pairs(df, "doc_id", F.col("text"), metric="jaccard").collect()}
    assert whole <= exact and len(whole) >= 0.9 * len(exact) > 500
    monkeypatch.setattr(dedup, "TILE_SHINGLES", 3000)
    assert {tuple(x) for x in dedup.minhash_pairs(sets).collect()} == whole
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # a component's rows come in several batches
    try:
        assert {tuple(x) for x in dedup.near_duplicates(df, "doc_id", "text", approximate=True).collect()} == kept
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_shingles_of_a_pair_stay_in_its_row(spark):
    """The texts are joined, and their sets made behind the join: no plan node has an array of shingles."""
    from gleanings.plans import record_queries

    plan = record_queries.shingle_overlap(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "xxhash64" not in plan and "array_join" not in plan


def test_many_copies_are_one_class(spark):
    """Copies meet nobody: the rows stay as many as the documents, and no group is handed to one task."""
    body = "the same page " * 30
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 12_345, F.lit(body + "!!")).otherwise(F.lit(body)).alias("text"))
    assert dedup.near_pairs(df, "doc_id", F.col("text")).count() == 0
    assert [tuple(x) for x in dedup.near_duplicates(df, "doc_id", "text").collect()] == [(0, 12_345)]


def test_lines_need_no_exchange(spark):
    docs = spark.createDataFrame([(1, "a\n```\n# b\n```\n# c")], "doc_id long, text string")
    for df in (text.prose_lines(docs), docs.select(text.demote_headings(F.col("text"))), docs.select(text.normalize_dashes(F.col("text"))), quality.rhythm(docs), quality.diversion_scan(docs), quality.flavor_score(docs, [quality.Dimension("d", 1.0, 1.0, ("x",))])):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert one(spark, text.demote_headings(F.lit("# a\n~~~\n# b\n```\n# c"))) == "## a\n~~~\n# b\n```\n## c"


def test_sanitize_words(spark):
    words = text.lexicon({"adlaw": [text.Word("best"), text.Word("first", ("ly",), "second|third", 10)], "finance": [text.Word("profit")]}, "basic", "own，words; ")
    assert [w.text for w in words] == ["first", "words", "best", "own"]
    body = "first, second. firstly the best of our own words, best first"
    assert one(spark, text.sanitize(F.lit(body), words)) == "first, second. firstly the  of our  ,  "
    assert [tuple(h) for h in one(spark, text.sanitize_hits(F.lit(body), words))] == [("first", 1, 55), ("words", 1, 43), ("best", 2, 27), ("own", 1, 35)]
    assert [w.text for w in text.lexicon({"adlaw": [text.Word("best")]}, "off", "own")] == ["own"]


def test_media_of_loose_html(spark):
    page = "<img src=/a.avif><IMG DATA-SRC='b.png' alt=x><img srcset=\"../c.webp 2x, d.png\"><source srcset=e.jpg><script>var x = 'f.gif?v=1'</script><video src=m.mp4></video><iframe src=https://youtu.be/x></iframe>"
    base = F.lit("https://h.example/one/two/page.html")
    assert one(spark, html.images(F.lit(page), base)) == ["https://h.example/a.avif", "https://h.example/one/two/b.png", "https://h.example/one/c.webp", "https://h.example/one/two/e.jpg", "https://h.example/one/two/f.gif?v=1"]
    assert one(spark, html.videos(F.lit(page), base)) == ["https://youtu.be/x", "https://h.example/one/two/m.mp4"]


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ('<meta name="date" content="2020-01-01"><meta content="2021-02-03" property="og:published_time">', datetime(2021, 2, 3)),
        ('{\\"dateModified\\":\\"2020-01-01\\",\\"publishedOn\\":\\"2021-02-03\\"}', datetime(2021, 2, 3)),
        ("<p>on 3 Feb 2021</p><time datetime=2019-01-01>", datetime(2021, 2, 3)),
        ("<p>Order 12, 2020 of Feb. 3, 2021</p>", datetime(2021, 2, 3)),
        ('<meta name="pubdate" content="soon"><time datetime="2021-02-03">', datetime(2021, 2, 3)),
        ('{"datePublished": "2999-01-01"}', None),
        ("", None),
    ],
)
def test_dates_of_pages(spark, page, wanted):
    assert one(spark, html.published_at(F.lit(page), F.lit("2024-01-01").cast("timestamp"))) == wanted


def test_crawl_with_budget_and_fallbacks(spark):
    seeds = spark.createDataFrame([("a", "https://a/x", None, None), ("b", "https://b/x", None, None), ("c", "https://c/x", None, None)], "site string, url string, include_pattern string, exclude_pattern string")
    chain = [("a", f"https://a/{'x' if i == 0 else f'y/z/post-{i}'}", f"https://a/y/z/post-{i + 1}") for i in range(6)] + [("b", "https://b/x", "https://b/tag"), ("b", "https://b/x", "https://else/y/z/w")]
    links = spark.createDataFrame(chain, "site string, src string, dst string")
    one_level = spark.createDataFrame([("b", "https://b/page/2")], "site string, url string")
    feeds = spark.createDataFrame([("b", "https://b/feed"), ("c", "https://c/feed/one")], "site string, url string")
    got = sorted(tuple(r) for r in crawl.crawl_site(links, seeds, [one_level, feeds]).collect())
    assert got == [("a", f"https://a/y/z/post-{i}", 0) for i in range(1, 7)] + [("b", "https://b/page/2", 1), ("c", "https://c/feed/one", 2)]


def test_read_atom_and_content(spark, tmp_path):
    (tmp_path / "r.xml").write_text('<rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><item><title>T</title><link>https://x.example/a/b</link><description>short</description><content:encoded><![CDATA[<p>whole</p><img src="c.png">]]></content:encoded></item></channel></rss>')
    (tmp_path / "a.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="text">E</title><link rel="self" href="https://x.example/self"/><link rel="alternate" href="https://x.example/e"/><summary>in short</summary><updated>2025-06-28T10:30:00Z</updated></entry></feed>')
    r = io.read_feed_items(spark, str(tmp_path / "r.xml"), "s").first()
    assert (r.url, r.raw_summary, r.images) == ("https://x.example/a/b", "short", ["https://x.example/a/c.png"]) and r.content_md.startswith("<p>whole")
    e = io.read_feed_items(spark, str(tmp_path / "a.xml"), "s", row_tag="entry").first()
    assert (e.title, e.url, e.content_md, e.published_at) == ("E", "https://x.example/e", "in short", datetime(2025, 6, 28, 10, 30))


def test_archive_and_failures(spark, tmp_path):
    rows = spark.createDataFrame([("https://x.example/1", "One", "a/b", "s1"), ("https://x.example/2", "Two", "c", "s2")], "url string, title string, topic string, source_name string").withColumns({"published_at": F.lit(None).cast("timestamp"), "fetched_at": F.lit("2024-01-01").cast("timestamp"), "content_md": F.lit("x")})
    io.write_archive(rows, str(tmp_path / "archive"))
    assert [r.title for r in io.read_archive(spark, str(tmp_path / "archive"), topic="a/b").collect()] == ["One"]
    assert [r.title for r in io.read_archive(spark, str(tmp_path / "archive"), source="s2").collect()] == ["Two"]
    log = spark.range(50).select(F.timestamp_seconds(F.col("id")).alias("timestamp"), F.concat(F.lit("u"), "id").alias("url"), F.repeat(F.lit("y"), 300).alias("response_snippet"))
    io.append_failures(log, str(tmp_path / "log"))
    io.compact_failures(spark, str(tmp_path / "log"), str(tmp_path / "short"), 10)
    kept = spark.read.json(str(tmp_path / "short"))
    assert {r.url for r in kept.collect()} == {f"u{i}" for i in range(40, 50)} and kept.first().response_snippet == "y" * 200


def test_relevance_gate(spark):
    rows = spark.range(20).withColumnRenamed("id", "doc_id")
    replies = spark.createDataFrame([(i, "[0]") for i in range(3)], "chunk long, reply string")
    assert sorted(r.doc_id for r in filters.relevance_gate(rows, replies, "doc_id").collect()) == [0, 8, 16]


def test_feed_and_config(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title> A </title><link>http://x.example/1</link><description>body</description><pubDate>Sat, 28 Jun 2025 10:30:00 GMT</pubDate></item><item><title>B</title><link>http://x.example/2</link></item></channel></rss>")
    pages = spark.createDataFrame([("http://x.example/1", "a much longer body")], "link string, body string")
    got = {r.title: r for r in io.read_feed_items(spark, str(tmp_path / "f.xml"), "feed", pages).collect()}
    assert got["A"].content_md == "a much longer body" and got["A"].published_at == datetime(2025, 6, 28, 10, 30) and got["B"].published_at is None
    (tmp_path / "c.json").write_text('{"version": 1, "topics": [{"name": "t", "keywords": ["k"]}, {"name": ""}], "sources": [{"name": "s", "url": "u"}, {"name": "n"}], "settings": {"a": "1", "b_api_key": "x", "c": null}}')
    topics, sources, settings = io.read_config(spark, str(tmp_path / "c.json"))
    assert topics.count() == 1 and sources.first().type == "rss" and sources.count() == 1 and [r.key for r in settings.collect()] == ["a"]
    assert '"topics"' in io.export_config(topics, sources, settings).first().json


def test_archive_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("https://e.org/a", "T", "body", "a/b", "s"), ("https://e.org/b", "U", "body", None, "s")], "url string, title string, content_md string, topic string, source_name string")
    rows = rows.withColumn("published_at", F.lit(None).cast("timestamp")).withColumn("fetched_at", F.lit("2024-05-06").cast("timestamp"))
    io.write_archive(rows, str(tmp_path / "a"))
    got = io.read_archive(spark, str(tmp_path / "a"), topic="a_b", source="s").collect()
    assert [r.archive_path for r in got] == ["a_b/20240506-t"]
