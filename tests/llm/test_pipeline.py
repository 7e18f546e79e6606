"""The pipeline's stages on the smallest tables, each against a plain version on its own input."""

import random
import re
from collections import Counter

import corpus_pipeline
import duckdb
import pytest
import sentencepiece

from gleanings.llm import exact_dedup, quality_rules, registry, simhash
from tests.llm.test_operators import slow_verdict

SF = "/root/testdata/sf0.001"


def similar_parts(texts):
    """Sets of places of texts that hang together by a Jaccard similarity of 0.8 on five-word shingles."""
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, left, parts = [shingles(t) for t in texts], set(range(len(texts))), []
    near = lambda x, y: x == y or len(x & y) * 100 >= 80 * len(x | y)
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            i = todo.pop()
            part.add(i)
            found = {j for j in left if near(sets[i], sets[j])}
            left -= found
            todo += found
        parts.append(part)
    return parts


def test_similar_texts_are_found(spark):
    """Links are exact where they are made, and few are missed; groups of many near copies become one row."""
    r = random.Random(31)
    base = [[f"w{r.randint(0, 10**6)}" for _ in range(150)] for _ in range(40)]

    def changed(words, k):
        words = list(words)
        for i in r.sample(range(len(words)), k):
            words[i] = f"z{r.randint(0, 10**9)}"
        return " ".join(words)

    texts = [" ".join(b) for b in base] + [changed(b, k) for b in base for k in (1, 2, 9)] + [changed(base[0], 1) for _ in range(200)] + ["short one", "Short  ONE", "another", "", None, " "]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    kept = {x.doc_id for x in simhash.dedup_similar(docs).collect()}
    must = {min(part) for part in similar_parts(texts)}
    assert must <= kept and len(kept) <= len(must) + 4  # of 280
    assert {x.doc_id for x in simhash.dedup_similar(docs, exact=True).collect()} == must
    assert sum(i in kept for i in range(160, 360)) == 0 and {360, 362, 363} <= kept and not {361, 364, 365} & kept


def test_near_copies_are_found_beside_relatives(spark):
    """Texts of similarity 0.7 to 0.8 share bands with a text and are none of its copies: they take no copy away."""
    r = random.Random(41)
    texts, pairs = [], []
    for _ in range(60):
        base = [f"w{r.randint(0, 10**6)}" for _ in range(300)]
        for _ in range(4):
            other = list(base)
            for i in range(r.randint(5, 12), 300, 28):
                other[i] = f"y{r.randint(0, 10**9)}"
            texts.append(" ".join(other))
        texts += [" ".join(base), " ".join([*base[:-1], "zz"])]
        pairs.append((len(texts) - 2, len(texts) - 1))
    order = r.sample(range(len(texts)), len(texts))
    kept = {x.doc_id for x in simhash.dedup_similar(spark.createDataFrame([(order[i], t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert all(max(order[a], order[b]) not in kept for a, b in pairs)


def test_rare_keys_miss_no_similar_sets(spark):
    """Sets of many sizes around a few common ones: all pairs of similarity 0.8 share a key from their two sides."""
    r = random.Random(7)
    sets = []
    for _ in range(6):
        base = r.sample(range(10**6), r.choice([1, 2, 9, 40, 120]))
        for _ in range(30):
            s = set(r.sample(base, max(1, len(base) - r.randint(0, len(base) // 5)))) | {r.randint(0, 10**6) for _ in range(r.randint(0, 1 + len(base) // 6))}
            sets.append(s)
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "node long, s array<long>")
    keys = {}
    for x in simhash._rare_keys(rows, 80).collect():
        keys.setdefault(x.node, set()).add((x.t, x.own, x.other))
    turned = {i: {(t, other, own) for t, own, other in k} for i, k in keys.items()}
    similar = [(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j])]
    assert len(similar) > 200 and all(keys[i] & turned[j] for i, j in similar)


def test_large_families_of_relatives(spark):
    """A crowd around one text, most of it less similar than 0.8 to it and to each other: links are found as by comparing all pairs."""
    r = random.Random(11)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(120)]
    texts = [" ".join(base)]
    for _ in range(150):
        other = list(base)
        for i in r.sample(range(3, 117, 6), r.randint(1, 6)):
            other[i] = f"y{r.randint(0, 10**9)}"
        texts.append(" ".join(other))
    order = r.sample(range(len(texts)), len(texts))
    docs = spark.createDataFrame([(order[i], t) for i, t in enumerate(texts)], "doc_id long, text string")
    must = {min(order[i] for i in part) for part in similar_parts(texts)}
    kept = {x.doc_id for x in simhash.dedup_similar(docs).collect()}
    assert must <= kept and 20 < len(must) and len(kept) <= len(must) + 3


@pytest.mark.parametrize("changes", [(3, 4), (2, 2), (1, 1)])
def test_recall_by_similarity(spark, changes):
    """Of copies at a similarity of 0.80 to 0.85, to 0.90 and from there on nine of ten go, and what is less similar stays."""
    r = random.Random(sum(changes))
    texts, near = [], 0
    for _ in range(150):
        base = [f"w{r.randint(0, 10**6)}" for _ in range(r.randint(150, 220))]
        other = list(base)
        for i in r.sample(range(5, len(base) - 5, 6), r.choice(changes)):
            other[i] = "zz" + str(r.randint(0, 10**9))
        texts += [" ".join(base), " ".join(other)]
        near += len(similar_parts(texts[-2:])) == 1
    kept = simhash.dedup_similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count()
    assert near > 100 and 300 - near <= kept <= 300 - 0.9 * near


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    kept = {name: None for name, _ in corpus_pipeline.STAGES}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.staged(stage(spark, docs, SF))
        kept[name] = docs.collect()
        if name == "quality rules":
            judged = {r.doc_id for r in quality_rules.judge(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).filter("kept").collect()}
            assert {r.doc_id for r in kept[name]} == judged and 0 < len(judged) < len(before)
        elif name == "exact dedup":
            firsts = {}
            for r in sorted(before, key=lambda r: r.doc_id):
                firsts.setdefault(b" ".join(r.text.encode().split()), r.doc_id)
            assert {r.doc_id for r in kept[name]} == set(firsts.values())
        elif name == "simhash near-dedup":
            parts = similar_parts([r.text for r in before])
            must = {min(before[i].doc_id for i in part) for part in parts}
            left = {r.doc_id for r in kept[name]}
            assert must <= left <= {r.doc_id for r in before} and len(left) <= len(must) + 0.2 * (len(before) - len(must))
        elif name == "mixing":
            assert max(Counter(r.doc_id for r in kept[name]).values()) <= 2
        if name != "sentencepiece":
            assert docs.columns == names
    assert len(kept["sentencepiece"]) == len(kept["mixing"]) and all(r.exact for r in kept["sentencepiece"])


def awkward(spark, folder, n=160):
    """Documents with null, empty, very long, repeated and near texts, null and repeated ids, null sources and clashing columns; and labels."""
    r = random.Random(21)
    prose = lambda k: " ".join(r.choice(["the", "of", "and"]) if r.random() < 0.3 else f"w{r.randint(0, 3000)}" for _ in range(k))
    rows = [(i, prose(r.randint(30, 90)) if i % 4 else "BUY NOW!! " * 3 + " ".join(f"X{r.randint(0, 999)}!!" for _ in range(40)), f"s{i % 3}") for i in range(n)]
    base = prose(400)
    rows += [(None, None, "s0"), (None, "", None), (1000, " \t ", "s1"), (None, rows[1][1], "s1"), (None, rows[1][1], "s2"), (1001, rows[2][1].replace(" ", "  "), None), (5, rows[5][1], "s2"), (5, rows[5][1], "s2"), (5, prose(50), "s0")]
    rows += [(2000 + i, base.replace(" ", "\n", 1) if i == 1 else base + (" end" if i == 2 else ""), "s0") for i in range(3)] + [(3000, prose(30_000), "s1"), (3001, "漢" * 50_000 + " " + prose(40), "s1")]
    docs = spark.createDataFrame([(i, t, "en", s, 0, 7, "x", 1, "k") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, size long, norm string, copies long, `_row` string")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), None) for i in range(n)] + [(None, 1, 0), (3, None, 0), (77777, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stages_on_awkward_rows(spark, tmp_path):
    docs = awkward(spark, tmp_path)
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    of = lambda rows: Counter((r.doc_id, r.text, r.source) for r in rows)
    smallest = lambda rows: min(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")

    before, docs = docs.collect(), corpus_pipeline.staged(stages["quality rules"](spark, docs, str(tmp_path)))
    rules = quality_rules.learned(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels)
    after = docs.collect()
    assert docs.columns == columns and of(after) == of(r for r in before if slow_verdict(r.text, rules)) and 0 < len(after) < len(before)

    before, docs = after, corpus_pipeline.staged(stages["exact dedup"](spark, docs, str(tmp_path)))
    groups = {}
    for r in before:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), []).append(r)
    after = docs.collect()
    assert docs.columns == columns and Counter(r.doc_id for r in after) == Counter(smallest(g).doc_id for g in groups.values()) and len(after) == len(groups)
    assert {re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in after} == set(groups)

    before, docs = after, corpus_pipeline.staged(stages["simhash near-dedup"](spark, docs, str(tmp_path)))
    after = docs.collect()
    assert docs.columns == columns and of(after) <= of(before)
    # groups are parts of those that all pairs of similar texts make, so the smallest id of each of these stays; and here nothing is missed
    assert Counter(r.doc_id for r in after) == Counter(smallest([before[i] for i in part]).doc_id for part in similar_parts([r.text for r in before])) and len(after) < len(before)

    before, docs = after, corpus_pipeline.staged(stages["mixing"](spark, docs, str(tmp_path)))
    after = docs.collect()
    sizes = Counter()
    for r in before:
        sizes[r.source] += len((r.text or "").encode().split())
    taken = Counter()
    for r in after:
        taken[r.source] += len((r.text or "").encode().split())
    assert docs.columns == columns and set(of(after)) <= set(of(before)) and max(of(after).values()) <= 2 and all(taken[s] <= 2 * sizes[s] for s in taken)

    sp = sentencepiece.SentencePieceProcessor(model_file=registry.PIECES)
    last = stages["sentencepiece"](spark, docs, str(tmp_path)).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in last) == Counter((r.doc_id, tuple(sp.encode(r.text or ""))) for r in after) and all(r.exact for r in last)


def test_stages_take_no_rows(spark, tmp_path):
    awkward(spark, tmp_path, 8).limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_stages_take_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(None, a), (None, a), (None, b), (1, b), (1, b), (1, c), (None, "lone"), (2, "lone too"), (2, "lone too")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    wanted = Counter([(None, a), (1, b), (1, c), (None, "lone"), (2, "lone too")])
    for dedup in (exact_dedup.dedup, simhash.dedup, simhash.dedup_similar):
        got = dedup(docs)
        assert got.columns == docs.columns and Counter((r.doc_id, r.text) for r in got.collect()) == wanted


def test_quality_judges_each_row_by_its_own_text(spark):
    tables = [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")]
    judged = quality_rules.judge(*tables).select("doc_id", "kept").collect()
    verdict = {r.doc_id: r.kept for r in judged}
    text = {r.doc_id: r.text for r in tables[0].collect()}
    good, bad = (next(i for i in sorted(verdict) if verdict[i] is k and text[i]) for k in (True, False))
    more = [(None, text[good]), (None, text[good]), (None, text[bad]), (10**9, text[good]), (10**9, text[bad])]
    docs = tables[0].select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = Counter((r.doc_id, r.text) for r in quality_rules.keep(docs, tables[1]).collect() if r.doc_id in (None, 10**9))
    assert got == Counter({(None, text[good]): 2, (10**9, text[good]): 1})


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    tidy = lambda rows: sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert tidy(tuple(r[c] for c in names) for r in df.collect()) == tidy(con.sql(registry.ORACLES[name]).select(", ".join(names)).fetchall())
