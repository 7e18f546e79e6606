"""The ten operators against brute force on small inputs, with the awkward rows that every one must take."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from gleanings.llm import exact_dedup, language_model, line_dedup, mixing, quality_classifier, quality_rules, sentencepiece_codec, simhash, substring_dedup, text_stats, url_filter
from gleanings.llm.components import connected_components
from gleanings.llm.registry import PIECES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, norm string, row long, kept boolean, fp long, label int"
SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def table(spark, rows):
    """rows of (id, text, source) as documents with further columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(i, t, "en", s, 0, 1, "x", 2, True, 3, 4) for i, t, s in rows], SCHEMA)


def some_docs(n=60, seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["The", "É", "ß", "x,", "end."]
    out = []
    for i in range(n):
        out.append((i, "\n".join(" ".join(r.choice(words) for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 6))), f"s{i % 4}"))
    out += [(n + 1, None, "s1"), (n + 2, "", None), (n + 3, " \t ", "s2"), (n + 4, out[5][1], "s1"), (n + 5, out[5][1].replace(" ", "  "), None), (n + 6, "one", "s3"), (n + 7, "word " * 4000, "s0"), (n + 8, out[7][1] + " w1", "s0")]
    return out


AWKWARD = some_docs()


def test_exact_groups(spark):
    rows = AWKWARD + [(100 + i, "copy of\tall", "s0") for i in range(50)]
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[SPACE.sub(b" ", (t or "").encode())].append(i)
    wanted = {i: (min(g), len(g), i == min(g), hashlib.sha256(k).hexdigest()) for k, g in groups.items() for i in g}
    for parts in (1, 3, 16):  # the large group is cut over many partitions
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(table(spark, rows), parts).collect()}
        assert got == wanted
    kept = exact_dedup.dedup(table(spark, rows))
    assert kept.columns == table(spark, rows).columns and {r.doc_id for r in kept.collect()} == {w[0] for w in wanted.values()}


def test_exact_groups_of_equal_rows_and_null_ids(spark):
    got = exact_dedup.exact_groups(table(spark, [(1, "a", "s"), (1, "a", "s"), (None, "a", "s"), (None, "b", "s")]), 4).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == [(0, 0, 1, True), (0, 1, 3, False), (1, 1, 3, False), (1, 1, 3, True)]


def test_dedups_of_no_rows_and_map_columns(spark):
    for f in (exact_dedup.dedup, simhash.dedup, simhash.dedup_similar, mixing.mixed_rows):
        assert f(table(spark, [])).count() == 0
    assert exact_dedup.exact_groups(table(spark, [])).count() == 0 and simhash.near_groups(table(spark, [])).count() == 0
    docs = table(spark, [(1, "a b c", "s"), (1, "a b c", "s"), (None, "", "t"), (None, None, "t")]).withColumn("extra", F.create_map(F.lit("k"), F.col("row")))
    for f in (exact_dedup.dedup, simhash.dedup, simhash.dedup_similar):
        got = f(docs)
        assert got.columns == docs.columns and sorted((str(r.doc_id), r.text or "") for r in got.collect()) == [("1", "a b c"), ("None", "")]


def slow_fingerprint(text):
    w = text.lower().encode() if text.isascii() else text.encode().lower()
    w = w.split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    base = " ".join(f"t{i}" for i in range(400))
    rows = AWKWARD + [(200 + i, base.replace(f"t{i} ", f"T{i} u ", 1) if i else base, "s0") for i in range(6)]
    fps = {i: slow_fingerprint(t or "") for i, t, _ in rows}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_groups(table(spark, rows)).collect()}
    assert got == {i: (fps[i], find(i)) for i in fps}
    assert {r.doc_id for r in simhash.dedup(table(spark, rows)).collect()} == {i for i in fps if find(i) == i}


def test_near_links_find_every_pair(spark):
    r = random.Random(4)
    fps = set()
    for _ in range(40):
        x = r.getrandbits(64)
        fps.add(x)
        for k in range(5):
            y = x
            for b in r.sample(range(64), k):
                y ^= 1 << b
            fps.add(y)
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in fps]
    got = {tuple(sorted((a % 2**64, b % 2**64))) for a, b in simhash.near_links(spark.createDataFrame(signed, "fp long")).collect()}
    assert got == {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(100, 90), (90, 95), (7, 7)]
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(31)}, 90: 90, 95: 90, 100: 90}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_url_filter(spark):
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("A.net", "/de/8", "allow"), ("a.net", "/de/8", "block"), (None, "/x", "block"), ("org", None, "block")]
    urls = ["http://a.example.com/en/77?x", "https://B.COM/en/", "x://com/en/1", "http://com.evil/en/1", "http://a.net/de/8#f", "http://b.a.net/de/9", "http://badexample.com/en/7", "no scheme", None, "http://", "http://example.org", "http://x.org?q", "http://example.com:80/en/7"]
    pages = spark.createDataFrame(list(enumerate(urls)) * 2, "page_id long, url string")
    clean = [(h.lower(), p or "", v) for h, p, v in rules if h]

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group().lower()
        path = re.match(r"[^/?#]*([^?#]*)", rest).group(1)
        fits = [(len(h + p), v, h + p) for h, p, v in clean if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, "allow", None))
        return host, path, best[2], best[1]

    got = url_filter.match_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in got) == sorted((i, judge(u)[0], judge(u)[1], judge(u)[2] or "", judge(u)[3]) for i, u in list(enumerate(urls)) * 2)
    assert url_filter.match_urls(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_url_rules_are_those_of_the_contract(spark, tmp_path):
    """Each of the five rules by name, and what lies beside it."""
    wanted = {"http://b.com/en/1": ("com/en/", "block"), "http://a.example.com/en/77": ("example.com/en/7", "allow"), "http://x.net/de/1": ("net/de/", "allow")}
    wanted |= {"http://example.net/de/80": ("example.net/de/8", "block"), "http://x.org/es/": ("org/es/", "block"), "http://x.org/en/": (None, "allow")}
    urls = list(wanted)
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {urls[r.page_id]: (r.rule, r.verdict) for r in QUERIES["op1_url_filter"](spark, str(tmp_path)).collect()} == wanted


def test_url_filter_over_many_ranges(spark):
    """Nested rules that reach over the bounds of ranges, long addresses, null ids, clashing columns and a parent key that all hosts share."""
    r = random.Random(17)
    rules = [("com", "/", "block"), ("com", "/a/b", "allow"), ("h5.com", "/a", "block"), ("org", "/" + "x" * 3000, "block"), ("org", "/" + "x" * 2999, "allow"), ("net", "", "block"), ("n.net", "/p", "allow")]
    urls = [f"http://h{i}.com/" for i in range(300)] + [f"https://h5.com/a/{i}" for i in range(300)] + ["http://a.org/" + "x" * n for n in (10, 2998, 2999, 3000, 5000)] + [f"http://n.net/{c}{i}" for c in "pq" for i in range(50)]
    r.shuffle(urls)
    rows = [(None if i % 50 == 0 else i, u, "x", "y", 1) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, key string, range int")

    def judge(u):
        rest = u.split("://", 1)[1]
        host, path = rest.split("/", 1)[0], "/" + rest.split("/", 1)[1]
        fits = [(-len(h + p), v != "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return min(fits, default=(0, 0, None, "allow"))[2:]

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = Counter((x.page_id, x.rule, x.verdict) for x in url_filter.match_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == Counter((i, *judge(u)) for i, u, *_ in rows)


def test_url_filter_of_very_long_addresses(spark):
    """Addresses of 100 KB and hosts of thousands of labels, over several ranges: no more is made of them than rules have lengths."""
    rules = [("com", "/a", "block"), ("com", "/" + "a" * 90_000, "allow"), ("x.com", "/", "allow"), ("b.c.d.com", "/z", "block")]
    urls = [f"http://h{i}.com/" + "a" * 100_000 + str(i) for i in range(12)] + [f"http://h{i}.com/" + "a" * 50_000 + str(i) for i in range(12)] + ["http://" + "l." * 5000 + "x.com/q", "http://" + "l." * 5000 + "c.d.com/z", "http://b.c.d.com/zz"]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.match_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    long = ("com/" + "a" * 90_000, "allow")
    assert got == {**dict.fromkeys(range(12), long), **dict.fromkeys(range(12, 24), ("com/a", "block")), 24: ("x.com/", "allow"), 25: (None, "allow"), 26: ("b.c.d.com/z", "block")}


def test_substring_dedup(spark):
    r = random.Random(2)
    sentence = lambda: " ".join(f"v{r.randint(0, 900)}" for _ in range(r.randint(4, 14))) + ". "
    passage = "".join(sentence() for _ in range(7))
    rows = [(i, "".join(sentence() for _ in range(4)) + (passage if i in (2, 5, 9) else "") + "".join(sentence() for _ in range(3)), "s") for i in range(12)] + [(20, None, "s"), (21, "", "s"), (None, passage, "s")]
    seen, first = defaultdict(list), {}
    for i, t, _ in rows:
        if i is not None and t:
            for a, b, *h in zip(*[x.tolist() for x in substring_dedup.Cut(t.encode()).spans(20)], strict=True):
                seen[tuple(h)].append((i, a, b))
    first = {h: min(p) for h, p in seen.items()}
    gone = defaultdict(set)
    for h, places in seen.items():
        for i, a, b in places:
            if (i, a, b) != first[h]:
                gone[i] |= set(range(a, b + 1))
    assert set(gone) == {5, 9}
    got = {x.doc_id: x for x in substring_dedup.dedup_passages(table(spark, rows)).collect()}
    for i, t, _ in rows:
        if i is None or t is None:
            assert got[i].text == t
            continue
        raw = t.encode()
        left = b"".join(raw[a:b] for k, (a, b) in enumerate(substring_dedup.sentences(raw)) if k not in gone[i])
        assert got[i].text == left.decode() and got[i].n_removed == len(gone[i])
    assert passage.split(". ")[3] not in got[5].text


def test_passages_set_anywhere_share_a_span():
    r = random.Random(8)
    some = lambda n: [f"v{r.randint(0, 5000)}" + r.choice(["", "", "", "", "", "", ".", "\n"]) * (r.random() < r.choice([0, 0.5])) for _ in range(n)]
    seen, back = {}, {}
    for n in (50, 51, 60, 100):
        for _ in range(150):
            passage = some(n)
            found = []
            for _ in range(2):
                left, right = some(r.randint(0, 60)), some(r.randint(0, 60))
                raw = " ".join(left + passage + right).encode()
                pieces = substring_dedup.sentences(raw)
                assert b"".join(raw[a:b] for a, b in pieces) == raw
                each = list(zip(*[x.tolist() for x in substring_dedup.Cut(raw).spans(20)], strict=True))
                found.append({tuple(x[2:]) for x in each})
                for a, b, *h in each:  # the same words have the same digest, and no others
                    words = tuple(raw[pieces[a][0] : pieces[b][1]].lower().split())
                    assert seen.setdefault(words, tuple(h)) == tuple(h) and back.setdefault(tuple(h), words) == words
            assert found[0] & found[1]


def test_substring_dedup_of_a_passage_within_a_sentence(spark):
    r = random.Random(9)
    some = lambda n: " ".join(f"v{r.randint(0, 5000)}" for _ in range(n))
    passage = some(51)
    rows = [(i, some(40) + " " + (passage + " " if i in (2, 5) else "") + some(40), "s") for i in range(8)] + [(20, "", "s"), (21, " \n ", "s")]
    got = {x.doc_id: x for x in substring_dedup.dedup_passages(table(spark, rows)).collect()}
    assert {i for i in got if got[i].n_removed} == {5}
    assert len(got[5].text.split()) <= 131 - 26 and all(w in got[5].text.split() for w in rows[5][1].split()[:40] + rows[5][1].split()[-40:])


def own_sentences(text):
    """Bounds of sentences, for texts whose sentences end with one mark and one space, or one line end, and have 24 words at most."""
    ends = [k + 1 for k, c in enumerate(text) if c == "\n" or (c == " " and text[k - 1] in ".!?")]
    ends += [len(text)] * (not ends or ends[-1] < len(text))
    return list(zip([0, *ends], ends))


def test_substring_dedup_against_an_own_cutter(spark):
    """Texts of short sentences without anchors' reach: what is covered by a later equal run of sentences of 20 words goes."""
    r = random.Random(12)
    pool = [" ".join(f"u{r.randint(0, 10**6)}" for _ in range(r.randint(8, 11))) + r.choice([". ", "? ", "\n"]) for _ in range(30)]
    rows = []
    for i in range(60):
        k = r.randint(0, 27)
        # runs of two or three shared sentences, of under 50 words, between sentences of their own
        own = lambda: " ".join(f"x{r.randint(0, 10**9)}" for _ in range(r.randint(3, 9))) + ". "
        rows.append((i, own() + "".join(pool[k : k + r.randint(2, 3)]) + own(), "s"))
    seen, gone = {}, defaultdict(set)
    for i, t, _ in rows:
        cut = own_sentences(t)
        words = [t[a:b].lower().split() for a, b in cut]
        for a in range(len(cut)):
            b, n = a, len(words[a])
            while b + 1 < len(cut) and (b == a or n < 20):
                b += 1
                n += len(words[b])
            if n >= 20 and b > a:
                key = tuple(w for x in words[a : b + 1] for w in x)
                if seen.setdefault(key, (i, a)) != (i, a):
                    gone[i] |= set(range(a, b + 1))
    got = {x.doc_id: x for x in substring_dedup.dedup_passages(table(spark, rows), anchor_words=200, window=100).collect()}
    assert len(gone) > 10
    for i, t, _ in rows:
        assert got[i].text == "".join(t[a:b] for k, (a, b) in enumerate(own_sentences(t)) if k not in gone[i]) and got[i].n_removed == len(gone[i])


def test_substring_dedup_of_repeated_ids_long_sentences_and_no_rows(spark):
    r = random.Random(13)
    some = lambda n: " ".join(f"v{r.randint(0, 10**6)}" for _ in range(n))
    passage, other, long = some(120), some(130), some(400)
    rows = [(1, passage, "s"), (2, passage, "s"), (2, other, "s"), (3, long, "s"), (4, some(30) + " " + long, "s"), (5, other, "s"), (5, other, "s"), (6, "word " * 100_000, "s")]
    got = sorted(((x.doc_id, x.text, x.n_removed) for x in substring_dedup.dedup_passages(table(spark, rows)).collect()), key=str)
    of = lambda i: [(t, n) for d, t, n in got if d == i]
    assert of(1) == [(passage, 0)] and (other, 0) in of(2) and of(3) == [(long, 0)]
    assert all(len(t.split()) < 30 for t, n in of(2) if n) and len([n for _, n in of(2) if n]) == 1
    assert len(of(4)[0][0].split()) < 30 + 60 and of(5)[0] == of(5)[1] and len(of(5)[0][0].split()) < 60
    assert len(of(6)[0][0].split()) < 1000
    assert substring_dedup.dedup_passages(table(spark, [])).count() == 0


def edit_words(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d[0], last = i, d[0]
        for j, y in enumerate(b, 1):
            d[j], last = min(d[j] + 1, d[j - 1] + 1, last + (x != y)), d[j]
    return d[-1]


def test_line_dedup(spark):
    r = random.Random(3)
    lines = [" ".join(f"v{r.randint(0, 60)}" for _ in range(r.randint(1, 20))) for _ in range(40)]

    def changed(line):
        w = line.split()
        k, p = r.randint(0, 3), r.randrange(len(w))
        return " ".join(w[:p] + (["new"] + w[p:] if k == 0 else w[p + 1 :] if k == 1 else ["other"] + w[p + 1 :] if k == 2 else w[p:]))

    rows = [(i, "\n".join(r.choice([lines[r.randrange(40)], changed(lines[r.randrange(40)]), "", "  " + lines[r.randrange(40)] + "\t"]) for _ in range(8)), "s") for i in range(15)] + [(30, None, "s"), (31, "", "s"), (32, "\n \n", "s"), (33, "long " * 3000, "s"), (None, lines[0], "s")]
    places = [(i, n, tuple(line.split())) for i, t, _ in rows if i is not None and t is not None for n, line in enumerate(t.split("\n")) if line.split()]
    gone = {(i, n) for i, n, w in places if any((j, m) < (i, n) and abs(len(v) - len(w)) < 2 and edit_words(w, v) <= 1 for j, m, v in places)}
    got = {x.doc_id: x for x in line_dedup.dedup_lines(table(spark, rows)).collect()}
    for i, t, _ in rows:
        if i is None or t is None:
            assert got[i].text == t
        else:
            assert got[i].text == "\n".join(line for n, line in enumerate(t.split("\n")) if (i, n) not in gone), i
            assert got[i].n_removed == sum(g[0] == i for g in gone) and got[i].n_lines == sum(p[0] == i for p in places)


def test_line_dedup_of_repeated_ids_long_lines_and_no_rows(spark):
    w = [f"v{i}" for i in range(5000)]
    long, near, same = " ".join(w), " ".join(w[:2500] + ["x"] + w[2501:]), "one line of ten words that stands in many texts\nand a second"
    shorter = " ".join(w[:4000] + w[4001:])
    rows = [(1, long, "s"), (2, near, "s"), (3, shorter, "s"), (4, same, "s"), (4, "another text\nof the same id", "s"), (5, same, "s"), (5, same, "s"), (6, "another text", "s")]
    got = Counter((x.doc_id, x.text, x.n_removed) for x in line_dedup.dedup_lines(table(spark, rows)).collect())
    assert got == Counter([(1, long, 0), (2, "", 1), (3, "", 1), (4, same, 0), (4, "another text\nof the same id", 0), (5, "", 2), (5, "", 2), (6, "", 1)])
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


def test_op3_keeps_short_lines_that_only_share_words(spark, tmp_path):
    w = [f"v{i}" for i in range(30)]
    texts = ["And.\nAnd onhe.\n" + " ".join(w[:9]) + "\n" + " ".join(w[10:20]), "Adoboque.\nAnd ornd.\nAnd.\n" + " ".join(w[:8] + ["x"]), " ".join(w[10:19] + ["x"]) + "\n" + " ".join(w[10:19]) + "\n" + " ".join(w[:8]) + "\n" + " ".join(w[:9] + ["y"])]
    table(spark, [(i, t, "s") for i, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: (x.n_removed, x.n_chars) for x in QUERIES["op3_line_dedup"](spark, str(tmp_path)).collect()}
    left = [texts[0], "Adoboque.\nAnd ornd.\n" + " ".join(w[:8] + ["x"]), " ".join(w[:8])]
    assert got == {0: (0, len(left[0])), 1: (1, len(left[1])), 2: (3, len(left[2]))}


def test_codec_equals_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    r = random.Random(5)
    extra = ["a\0b", "\0", " \0\0 x\0", "  two  spaces ", "\n\n a\tb", "漢字 and 😀", " " * 37, "x" * 300, "é́ß", "".join(chr(r.randint(32, 0x2FF)) for _ in range(400)), "1234567890 3.14159"] + [" " * k + "q" for k in range(1, 40)]
    rows = AWKWARD + [(500 + i, t, "s") for i, t in enumerate(extra)]
    got = {x.doc_id: x for x in sentencepiece_codec.round_trip(table(spark, rows), PIECES).collect()}
    for i, t, _ in rows:
        assert got[i].ids == sp.encode(t or ""), repr(t)[:80]
        assert got[i].exact and got[i].n_tokens == len(got[i].ids)
    encoded = sentencepiece_codec.encode(table(spark, rows), PIECES)
    assert {x.doc_id: x.text for x in sentencepiece_codec.decode(encoded, PIECES).collect()} == {i: t or "" for i, t, _ in rows}


def test_codec_of_odd_and_unbroken_texts():
    sp, codec = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepiece_codec.Codec(PIECES, remember=2_000)
    r = random.Random(11)
    bits = ["a", "the", "ing", "\0", " ", "  ", "\n", "\t", "漢", "字", "😀", "é", "er", "▁", "12", "https://", "\r"]
    odd = ["".join(r.choice(bits) for _ in range(r.randint(0, 50))) for _ in range(800)] + ["x" * n for n in (63, 64, 65, 66)] + ["thequickbrownfox" * 60, " " * 1500, " " * 1500 + "漢", None]
    lines = "\n".join("".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(70)) for _ in range(5_000))
    for texts in (odd, odd[::-1], [lines], ["".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(1_000_000))], []):
        ids, sizes = codec.encode(pa.array(texts, pa.string()))
        assert ids.tolist() == [i for t in texts for i in sp.encode(t or "")]
        raw, n = codec.decode(ids, sizes)
        ends = np.cumsum(n).tolist()
        assert [raw[b - k : b].tobytes().decode().removeprefix(" ") for b, k in zip(ends, n.tolist(), strict=True)] == [(t or "").replace("▁", " ") for t in texts]
    assert len(codec.known) <= 2_000 + 1_000 and all(len(c) <= sentencepiece_codec.SHORT for c in codec.known)


def test_codec_windows(monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    monkeypatch.setattr(sentencepiece_codec, "BLOCK", 40)
    text = "unbrokenwordsthatgoonandonoverwindows" * 20 + "漢字" * 50
    assert sentencepiece_codec.Codec(PIECES).encode(pa.array([text]))[0].tolist() == sp.encode(text)


def test_codec_takes_no_rows_and_null_ids(spark):
    assert sentencepiece_codec.round_trip(table(spark, []), PIECES).count() == 0
    got = sentencepiece_codec.round_trip(table(spark, [(None, "one", "s"), (None, "one", "s"), (3, None, "s")]), PIECES).collect()
    assert sorted((x.doc_id is None, x.n_tokens, x.exact) for x in got) == [(False, 0, True), (True, 1, True), (True, 1, True)]


def slow_repeats(words):
    n = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    return len({k for i in range(len(words) - 7) if n[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)})


def test_counts(spark):
    rows = AWKWARD + [(300, "a b c d e f g h i a b c d e f g h i #*\n x \n x \n x \n\n", "s")]
    got = {x.doc_id: x for x in text_stats.text_stats(table(spark, rows)).collect()}
    for i, t, _ in rows:
        words = (t or "").encode().split()
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), slow_repeats(words))


def labelled(spark, n=400):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        rows.append((i, " ".join(("W" * r.randint(3, 8) + "!!") if bad and r.random() < 0.8 else "w" * r.randint(2, 8) + str(r.randint(0, 99)) for _ in range(r.randint(30, 80))), "s"))
        labels.append((i, 0 if bad else 1, None))
    labels += [(7, 1, None), (None, 1, None), (8, None, None), (99999, 0, None)]
    return rows, table(spark, rows + AWKWARD_IDS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


AWKWARD_IDS = [(1000 + i, t, s) for i, t, s in AWKWARD]


def slow_measures(t):
    """The measures of a text, counted one by one."""
    t = t or ""
    raw = t.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars = sum(len(w.decode()) for w in words)
    n, c, k = max(1, len(words)), max(1, chars), max(1, len(lines))
    count = lambda of: sum(ch in of for ch in t)
    return {
        "words": math.log(1 + len(words)), "word_length": chars / n, "symbol_share": count("#*$%&|<>") / c, "dup_line_share": (len(lines) - len(set(lines))) / k, "repeat_share": slow_repeats(words) / n,
        "upper_share": sum("A" <= ch <= "Z" for ch in t) / c, "digit_share": sum("0" <= ch <= "9" for ch in t) / c, "mark_share": count("!?") / c, "comma_share": count(".,;:") / c, "distinct_share": len(set(words)) / n,
        "same_next_share": sum(a == b for a, b in zip(words, words[1:])) / n, "longest_word": math.log(1 + max(map(len, words), default=0)), "words_a_line": math.log(1 + len(words) / k), "one_letter_share": sum(len(w) == 1 for w in words) / n,
    }


def slow_verdict(t, rules):
    """Base conditions, then the first rule that holds."""
    words = (t or "").encode().split()
    if len(words) < 20 or 100 * slow_repeats(words) > 30 * len(words):
        return False
    m = slow_measures(t)
    return not any(all(m[f] <= x if sign == "<=" else m[f] > x for f, sign, x in rule) for rule in rules)


def test_quality_verdicts_by_plain_loops(spark):
    rows, docs, labels = labelled(spark)
    more = rows + AWKWARD_IDS + [(None, rows[1][1], "s"), (None, rows[0][1], "s"), (3, "another text of the same id " * 9, "s"), (3, rows[3][1], "s")]
    docs = table(spark, more)
    rules = quality_rules.learned(docs, labels)
    assert rules and rules == quality_rules.learned(docs.orderBy(F.desc("text")).repartition(7), labels)  # whatever the order of rows
    got = Counter((r.doc_id, r.n_words, r.kept) for r in quality_rules.judge(docs, labels).collect())
    assert got == Counter((i, len((t or "").encode().split()), slow_verdict(t, rules)) for i, t, _ in more)
    kept = Counter((r.doc_id, r.text) for r in quality_rules.keep(docs, labels).collect())
    assert kept == Counter((i, t) for i, t, _ in more if slow_verdict(t, rules))


def test_quality_scores_by_plain_loops(spark, monkeypatch):
    made = []

    class Kept(quality_classifier.Ranker):
        def __init__(self, *a, **k):
            super().__init__(*a, **k)
            made.append(self)

    monkeypatch.setattr(quality_classifier, "Ranker", Kept)
    rows, _, labels = labelled(spark)
    more = rows + AWKWARD_IDS + [(None, rows[1][1], "s"), (3, "another text of the same id " * 9, "s"), (3, rows[3][1], "s")]
    got = Counter((r.doc_id, round(r.score, 9), r.predicted) for r in quality_classifier.classify(table(spark, more), labels).collect())
    ranker, wanted = made[0], Counter()
    for i, t, _ in more:
        raw = 0.0
        for k, x in enumerate(slow_measures(t).values()):
            raw += sum(w for e, w in zip(ranker.edges[k], ranker.weights.reshape(ranker.edges.shape)[k]) if x > e + 1e-12)  # an edge is one of the values; their logarithms differ in the last bit
        score = 1 / (1 + math.exp(-(ranker.steepness * (raw - ranker.threshold) + math.log(0.7 / 0.3) + 1e-12)))
        wanted[i, round(score, 9), int(score >= 0.7)] += 1
    assert got == wanted
    assert quality_classifier.classify(table(spark, []), labels).count() == 0


def test_ranking_learns_from_pairs_only():
    """The weights put the better of two apart documents first, and the threshold cuts the share of label 0."""
    rng = np.random.default_rng(1)
    good = rng.random(600) < 0.7
    x = np.stack([rng.normal(good * 2.0), rng.normal(size=600)], 1)
    r = quality_classifier.Ranker(x, good)
    scores = r.code(x) @ r.weights
    pairs = (scores[good][:, None] > scores[~good][None]).mean()
    assert pairs > 0.9 and abs((scores < r.threshold).mean() - (~good).mean()) < 0.02


def test_quality_rules(spark):
    rows, docs, labels = labelled(spark)
    got = {r.doc_id: r for r in quality_rules.judge(docs, labels).collect()}
    right = sum(got[i].kept == (i % 4 != 0) for i, _, _ in rows)
    assert right >= 0.97 * len(rows) and all(got[i].kept for i, _, _ in rows if i % 4) and len(got) == docs.count()
    assert got[1061].base_failed and not got[1061].kept
    none = quality_rules.judge(docs, labels.limit(0)).filter("kept = base_failed").count()
    assert none == 0
    assert quality_rules.judge(docs.limit(0), labels).count() == 0


def test_quality_classifier(spark):
    rows, docs, labels = labelled(spark)
    got = {r.doc_id: r for r in quality_classifier.classify(docs, labels).collect()}
    held = [i for i, _, _ in rows if got[i].held_out]
    assert held and sum(got[i].predicted == (i % 4 != 0) for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values()) and len(got) == docs.count()
    flat = quality_classifier.classify(docs, labels.filter("quality = 1")).select("score", "predicted").distinct().collect()
    assert len(flat) == 1 and flat[0].predicted == 1


def test_mixing(spark):
    r = random.Random(7)
    rows = AWKWARD + [(1000 + i, "w " * r.randint(1, 60), ("s0", "s1", "s2", None)[min(3, r.randint(0, 9) // 2)]) for i in range(900)]
    docs = table(spark, rows)
    sizes, words = Counter(), {}
    for i, t, s in rows:
        words[i] = len((t or "").encode().split())
        sizes[s] += words[i]
    order = sorted((s for s in sizes if s is not None), key=str.encode) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    got = mixing.mix(docs).collect()
    taken = Counter()
    for x in got:
        assert x.size == words[x.doc_id] and x.source_size == sizes[x.source] and x.target == pytest.approx(target[x.source]) and 0 <= x.copies <= 2
        taken[x.source] += x.copies * x.size
    for s in order:
        assert abs(taken[s] - target[s]) <= 0.05 * target[s] + 120, s
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((x.doc_id, x.copies) for x in again) == sorted((x.doc_id, x.copies) for x in got)
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and Counter(x.doc_id for x in mixed.collect()) == Counter({x.doc_id: x.copies for x in got if x.copies})
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_of_strided_null_and_repeated_ids(spark):
    r = random.Random(18)
    rows = [(30 * i, "w " * r.randint(1, 40), "s0") for i in range(600)] + [(None, f"n{i} " * r.randint(1, 40), "s1") for i in range(200)] + [(7, "same words here", "s2")] * 50 + [(None, "same words here", "s2")] * 50
    docs = table(spark, rows)
    got = mixing.mix(docs).collect()
    words, taken, target = Counter(), Counter(), {}
    for x in got:
        words[x.source] += x.size
        taken[x.source] += x.copies * x.size
        target[x.source] = x.target
        assert x.copies <= 2
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 0.05 * target[s] + 120 for s in words)
    again = Counter((x.doc_id, x.text, x.source) for x in mixing.mixed_rows(docs.repartition(5)).collect())
    assert again == Counter((x.doc_id, x.text, x.source) for x in mixing.mixed_rows(docs.orderBy("text")).collect())
    assert sum(len(t.split()) * n for (_, t, _), n in again.items()) == sum(taken.values())


def test_targets_of_many_sources(spark):
    """Every source by itself, against the plain rule, over several ranges."""
    r = random.Random(19)
    sizes = {f"h{i:04d}": r.choice([1, 5, 40, 300]) for i in range(500)} | {None: 77}
    order = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while full := {s for s in open_ if left / sum(weight[x] for x in open_) * weight[s] > 2 * sizes[s]}:
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    level = left / sum(weight[x] for x in open_) if open_ else 0
    target |= {s: level * weight[s] for s in open_}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x.source: x.target for x in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == pytest.approx(target)


def test_lm_scores(spark):
    import zlib

    rows = AWKWARD
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    toks = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t, _ in rows}
    count = Counter(w for i, t in toks.items() if not out(i) for w in t)
    n, v = sum(count.values()), len(count)
    for frequent, model in ((200_000, 4096), (10, 4)):  # all counts at hand, or most of them by the join
        got = {r.doc_id: r for r in language_model.score_texts(table(spark, rows), frequent=frequent, model_words=model).collect()}
        assert len(got) == len(rows)
        for i, t in toks.items():
            x = got[i]
            assert x.held_out == out(i) and x.n_tokens == len(t) and x.n_known == sum(w in count for w in t) and x.train_tokens == n
            assert x.base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
            assert math.isfinite(x.score) and x.score < 0
    assert language_model.score_texts(table(spark, rows).limit(0)).count() == 0


def test_lm_scores_are_a_function_of_the_table(spark, monkeypatch):
    monkeypatch.setattr(language_model, "SHARD_TOKENS", 400)  # several shards, and two levels of averages
    monkeypatch.setattr(language_model, "FAN_IN", 3)
    rows = AWKWARD + [(None, "w1 w2 w3", "s"), (None, None, "s"), (7, "w1", "s"), (7, "w2 " * 200, "s"), (8, "long" * 50 + " w1", "s")]
    docs = table(spark, rows)
    one = sorted((r.n_tokens, r.base_score, r.score) for r in language_model.score_texts(docs.repartition(2)).collect())
    other = sorted((r.n_tokens, r.base_score, r.score) for r in language_model.score_texts(docs.orderBy(F.desc("text")).repartition(9)).collect())
    assert len(one) == len(rows) and np.allclose(one, other, rtol=1e-6)


def slow_log_probability(model, word, one, two, m):
    """Of one word, by plain sums over the parameters."""
    p, k = model.parts, model.k
    dot = lambda a, b: sum(float(x) * float(y) for x, y in zip(a, b, strict=True))
    r = [float(a) + float(b) for a, b in zip(p["one"][one], p["two"][two], strict=True)]
    logits = [dot(r, p["classes"][c]) + float(p["class_bias"][c]) for c in range(k + 1)]
    group = word // language_model.CLASS if word < m else k
    out = logits[group] - math.log(sum(math.exp(x) for x in logits))
    if word < m:
        inside = {w: dot(r, p["words"][w]) + float(p["word_bias"][w]) for w in range(group * language_model.CLASS, (group + 1) * language_model.CLASS)}
        out += inside[word] - math.log(sum(math.exp(x) for x in inside.values()))
    return out


def test_lm_scores_by_plain_loops(spark, monkeypatch):
    import zlib

    learned = []
    load = language_model.LogBilinear.load
    monkeypatch.setattr(language_model.LogBilinear, "load", lambda self, flat: (load(self, flat), learned.append(self))[0])
    rows = AWKWARD
    got = {r.doc_id: r.score for r in language_model.score_texts(table(spark, rows), model_words=20).collect()}
    model = learned[-1]  # the averaged parameters, as the driver loads them
    toks = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t, _ in rows}
    count = Counter(w for i, t in toks.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in t)
    ranked = sorted(count, key=lambda w: (-count[w], w))
    m = min(20, len(ranked))
    place, others, types = {w: i for i, w in enumerate(ranked[:m])}, sum(count[w] for w in ranked[m:]), len(ranked) - m
    for i, words in toks.items():
        total, one, two = 0.0, m + 1, m + 1
        for w in words[:300]:
            k = place.get(w, m)
            total += slow_log_probability(model, k, one, two, m) / math.log(10)
            if k == m:
                total += math.log10((count[w] + 0.5) / (others + 0.5 * (types + 1)))
            one, two = k, one
        if len(words) <= 300:
            assert got[i] == pytest.approx(total, rel=1e-4, abs=1e-4)


def test_lm_without_training_rows(spark):
    got = language_model.score_texts(table(spark, [(i, "w1 w2", "s") for i in (1, 1, 2)]), fold=0, folds=1).collect()
    assert len(got) == 3 and all(r.train_tokens == 0 and r.n_known == 0 and r.held_out and r.base_score == pytest.approx(3 * math.log10(0.5 / 0.5)) for r in got)


def test_lm_probabilities_add_up():
    import numpy as np

    counts = np.sort(np.random.default_rng(1).integers(1, 500, 150))[::-1]
    model = language_model.LogBilinear(counts, others=40.0)
    ids = np.random.default_rng(2).integers(0, 151, 5000)
    before = model.log_probabilities(ids, np.array([0, 100])).sum()
    model.train(iter([(ids, np.array([0, 100]))]))
    context = np.array([3, 7])
    total = sum(math.exp(model.log_probabilities(np.append(context, w), np.array([0]))[-1]) for w in range(151))
    assert total == pytest.approx(1.0, abs=1e-4)
    assert math.isfinite(before)
