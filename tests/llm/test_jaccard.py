import os
import random
import re
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagloom.llm import jaccard


def brute(rows, width=5, threshold=0.8):
    sets = []
    for _, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        sets.append(frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset())
    n = len(rows)
    links = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, queue = {i}, [i]
        while queue:
            for j in links[queue.pop()]:
                if j not in seen:
                    seen.add(j)
                    queue.append(j)
        least = min((rows[j][0] for j in seen), key=lambda d: (d is not None, d or 0))
        out.append((rows[i][0], least, len(links[i]), len({sets[j] for j in links[i] if sets[j] != sets[i]})))
    return sorted(out, key=str)


def test_against_all_pairs(documents, corpus):
    rows = jaccard.near_duplicates(documents).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links, r.n_linked_texts) for r in rows), key=str) == brute(corpus)


def chain(rng, n, words=100):
    """Texts each like the next, the first and the last not."""
    text = [f"w{rng.randint(0, 9999)}" for _ in range(words)]
    out = []
    for i in range(n):
        text = list(text)
        text[(7 * i) % words] = f"x{i}"
        out.append((i, " ".join(text)))
    return out


def test_chains_and_blocks(spark, monkeypatch):
    """Groups larger than a block are dealt out as pairs of blocks; the result does not change."""
    monkeypatch.setattr(jaccard, "BLOCK", 6)
    rng = random.Random(1)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(120)]
    rows = chain(rng, 25)
    for i in range(40):
        words = list(base)
        words[rng.randint(0, 119)] = f"y{i}"
        rows.append((100 + i, " ".join(words)))
    rows += [(200 + i, rows[3][1]) for i in range(4)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string").repartition(6)).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links, r.n_linked_texts) for r in got), key=str) == brute(rows)
    assert max(r.n_links for r in got) >= 39


def test_depth_follows_the_recall():
    depths = [jaccard.depth_for(0.8, r) for r in (0.5, 0.99, 0.99999, 1 - 1e-12)]
    assert depths == sorted(depths, reverse=True) and depths[0] == jaccard.LEVELS and depths[-1] < depths[0]
    assert all(1 - (1 - 0.8**d) ** jaccard.TREES >= r for d, r in zip(depths, (0.5, 0.99, 0.99999, 1 - 1e-12)))


def test_depths_by_size():
    """The least similarity of sets of each size, by trying all sizes of the other and of what they share."""
    for threshold in (0.8, 0.5):
        for n in range(1, 60):
            every = [c / (n + m - c) for m in range(1, 3 * n) for c in range(min(n, m) + 1) if c < max(n, m)]
            assert jaccard.least_similarity(n, threshold) == min((x for x in every if x >= threshold), default=None)
    depths = jaccard.depths_by_size(0.8, 0.99999)
    assert depths[:3] == [0, 0, 0] and min(d for d in depths if d) == depths[-1] == 4 and max(depths) > 4


def test_neighbours_in_the_sorted_tries():
    """Longest prefixes shared with any other path, from neighbours alone, over batches of all sizes."""
    rng = random.Random(3)
    paths = sorted(bytes([rng.randint(0, 1)]) + b"".join(bytes([0, rng.randint(0, 1)]) for _ in range(jaccard.LEVELS)) for _ in range(120))
    paths = [p for i, p in enumerate(paths) if i % 3]

    def levels(a, b):
        n = 0
        while a[0] == b[0] and n < jaccard.LEVELS and a[1 + 2 * n : 3 + 2 * n] == b[1 + 2 * n : 3 + 2 * n]:
            n += 1
        return n

    rows = [{"sid": bytes([i]), "depth": rng.randint(3, 6), "path": p} for i, p in enumerate(paths)]
    expected = [r["sid"] for i, r in enumerate(rows) if max(levels(r["path"], o["path"]) for o in rows if o is not r) >= r["depth"] or i in (0, len(rows) - 1)]
    kind = pa.schema([("sid", pa.binary()), ("depth", pa.int32()), ("path", pa.binary())])
    for size in (1, 2, 7, 500):
        batches = [pa.RecordBatch.from_pylist(rows[i : i + size], kind) for i in range(0, len(rows), size)]
        got = [x for b in jaccard._sharing(iter([batches[0].slice(0, 0), *batches])) for x in b.column("sid").to_pylist()]
        assert got == expected and len(got) < len(rows)


def test_nothing_set_aside(documents, corpus):
    rows = jaccard.near_duplicates(documents, sifted=False).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links, r.n_linked_texts) for r in rows), key=str) == brute(corpus)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/documents.parquet"), reason="no such table here")
def test_recall_on_the_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    sets = {}
    for doc, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        sets[doc] = frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()
    having = {}
    for doc, shingles in sets.items():
        for s in shingles:
            having.setdefault(s, []).append(doc)
    common = Counter(pair for docs in having.values() for pair in combinations(sorted(docs), 2))
    true = [p for p, c in common.items() if c / (len(sets[p[0]]) + len(sets[p[1]]) - c) >= 0.8]
    found = sum(r.n_links for r in jaccard.near_duplicates(table).collect()) // 2
    print(f"recall {found / len(true):.5f} of {len(true)} links")
    assert 0.99 * len(true) <= found <= len(true)


def test_components(spark):
    edges = spark.createDataFrame([(bytes([a]), bytes([a + 1])) for a in range(40)] + [(bytes([100]), bytes([103])), (bytes([103]), bytes([103]))], "a binary, b binary")
    got = {bytes(r.sid)[0]: bytes(r.root)[0] for r in jaccard.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 103: 100}


def test_one_of_each_class(documents, corpus):
    kept = jaccard.one_of_each_class(documents)
    assert kept.columns == documents.columns
    rows = kept.collect()
    expected = {(d, least) for d, least, _, _ in brute(corpus) if d == least}
    assert {(r.doc_id, r.doc_id) for r in rows} == expected
    assert len({(r.doc_id, r.text) for r in rows}) == len(rows)
    assert all(r["sid"] == "own sid" for r in rows)


@pytest.mark.parametrize("texts", [[], [(1, None), (2, ""), (3, "a b"), (4, "a b"), (5, "a")]])
def test_small_tables(spark, texts):
    got = jaccard.near_duplicates(spark.createDataFrame(texts, "doc_id int, text string")).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links, r.n_linked_texts) for r in got), key=str) == brute(texts)


def test_a_line_that_all_share_links_nothing(spark):
    rng = random.Random(2)
    line = " ".join(f"s{i}" for i in range(12))
    rows = [(i, line + " " + " ".join(f"w{rng.randint(0, 99999)}" for _ in range(60))) for i in range(200)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string"))
    assert got.filter(F.col("class_id") != F.col("doc_id")).count() == 0
