"""The manifest against a plain tree in Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gleanings.llm import merkle
from gleanings.llm.registry import op11_merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place long, n long, node string, c0 string, path string, g string"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def tree(nodes, fanout):
    """Root and, for each node, its (left, right) siblings level by level."""
    paths = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        for at in range(len(nodes)):
            run = at // fanout * fanout
            step = ("".join(nodes[run:at]), "".join(nodes[at + 1 : run + fanout]))
            for i in under[at]:
                paths[i].append(step)
        under = [sum(under[i : i + fanout], []) for i in range(0, len(nodes), fanout)]
        nodes = [h("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def brute(rows, fanout=16):
    groups = defaultdict(list)
    for i, t, lang, s, n in rows:
        low = None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        hit = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        own = leaf(i, s, lang, n, t)
        groups[s].append((i is not None, i, own, leaf(i, s, lang, n, low) if hit else own))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = [tree([x[2] for x in sorted(groups[s])], fanout) for s in names]
    root, over = tree([s[0] for s in subs], fanout)
    out = []
    for s, (sub, paths), top in zip(names, subs, over, strict=True):
        for (_, i, own, now), path in zip(sorted(groups[s]), paths, strict=True):
            for left, right in path + top:
                now = h(left + now + right)
            out.append((i, own, sub, root, h("".join(a + b for a, b in path + top)), now, now == root))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, n, 7, 8, "x", "y", "z", "w") for i, t, lang, s, n in rows], SCHEMA)


def awkward(n, seed):
    r = random.Random(seed)
    rows = [(i, f"Text {r.random()}" if r.random() < 0.8 else "plain", r.choice(["en", "ü", None]), r.choices(["hot", "b", "é", "", None], [8, 2, 1, 1, 1])[0], r.choice([5, None])) for i in range(n)]
    return rows + [(3, "Again", "en", "hot", 1), (3, "Again", "en", "hot", 1), (3, "other", "en", "hot", 1), (None, None, None, None, None), (None, "No id", "en", "hot", 0), (-4, "", "en", "one alone", 0), (n, "Ä Long " * 50_000, "en", "b", 2)]


@pytest.fixture
def through(spark, tmp_path):
    def run(rows):
        table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
        return sorted(map(tuple, op11_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)

    return run


@pytest.mark.parametrize("n", [0, 20, 700])
def test_query_against_a_plain_tree(through, n):
    rows = awkward(n, n)
    assert through(rows) == brute(rows)


def test_one_row_and_no_rows(through):
    assert through([(10, "A", "en", "s", 1)]) == brute([(10, "A", "en", "s", 1)])


def test_no_rows(spark):
    manifest = merkle.build(table(spark, []))
    assert manifest.root.count() == 0 and merkle.proofs(manifest).count() == 0


def test_more_groups_than_a_run_and_other_fanouts(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 37:02}", i) for i in range(200)]
    for fanout in (2, 3, 16):
        found = merkle.proofs(merkle.build(table(spark, rows), fanout=fanout))
        got = found.select("order", "node", "subroot", "root", merkle.proof_digest(F.col("path")), merkle.folded(F.col("node"), F.col("path"))).collect()
        assert {tuple(r) for r in got} == {x[:5] + (x[3],) for x in brute(rows, fanout)}


def test_saved_manifests_and_changed_groups(spark, tmp_path):
    rows = awkward(60, 4)
    first = merkle.build(table(spark, rows))
    merkle.save(first, str(tmp_path / "m"))
    again = merkle.load(spark, str(tmp_path / "m"))
    key = lambda m: sorted(map(str, merkle.proofs(m).select("order", "node", "path", "root").collect()))
    assert key(again) == key(first) and merkle.changed(first, again).count() == 0
    other = [r if r[0] != 7 else (7, "other", *r[2:]) for r in rows if r[3] != "é"] + [(99, "x", None, "new", 1)]
    assert {r.group for r in merkle.changed(first, merkle.build(table(spark, other))).collect()} == {"é", "new", next(r[3] for r in rows if r[0] == 7)}
