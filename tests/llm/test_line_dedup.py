import hashlib
import random

from tagloom.llm import line_dedup, queries


def brute(rows, min_lines=2, min_chars=40):
    """(id, text) -> (kept text, lines, removed), by looking at every window in order."""
    known = sorted({(d if d is not None else -1, t) for d, t in rows if t is not None}, key=lambda r: (r[0], _hash_order(r[1])))
    seen, gone = {}, {}
    for doc, text in known:
        full = [(i, x) for i, x in enumerate(text.split("\n")) if x.strip(" ")]
        for k in range(len(full)):
            for size in {1, min_lines}:
                if k + size > len(full):
                    continue
                window = tuple(x for _, x in full[k : k + size])
                if size == 1 and min_lines > 1 and len(window[0]) < min_chars:
                    continue
                if window in seen:
                    gone.setdefault((doc, text), set()).update(range(k, k + size))
                else:
                    seen[window] = (doc, k)
    out = {}
    for doc, text in known:
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(" ")]
        away = gone.get((doc, text), set())
        cut = {full[k] for k in away}
        for k in away:
            if k + 1 in away:
                cut |= set(range(full[k], full[k + 1]))
        out[doc, text] = ("\n".join(x for i, x in enumerate(lines) if i not in cut), len(full), len(away))
    return out


def _hash_order(text):
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >= 1 << 63 else h


def test_against_every_window(documents, corpus):
    expected = brute(corpus)
    rows = line_dedup.deduplicate(documents).collect()
    assert len(rows) == len(corpus)
    left = {}
    for doc, text in corpus:
        key = (doc if doc is not None else -1, text)
        kept, lines, removed = expected.get(key, (None, 0, 0))
        left.setdefault((doc, kept, lines, removed), []).append(1)
    got = {}
    for r in rows:
        got.setdefault((r.doc_id, r.text, r.n_lines, r.n_removed), []).append(1)
        assert (r["_d"], r["_row"], r["seq"]) == ("own _d", "own _row", "own seq")
    assert got == left
    assert sum(r.n_removed for r in rows) > 50


def test_every_line_goes_without_a_floor(spark, corpus, tmp_path):
    rows = [*corpus, (700, "One line.\nAll rights reserved."), (701, "Another.\nAll rights reserved.\nAnd more.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    expected = brute(rows, min_lines=1)
    got = queries.QUERIES["op3_every_line_dedup"](spark, str(tmp_path)).collect()
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    wanted = [(d, *((lambda k: (k[1], k[2], digest(k[0])))(expected.get((d if d is not None else -1, t), (None, 0, 0))))) for d, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str)
    assert (701, 3, 1, digest("Another.\nAnd more.")) in wanted


def test_longer_runs(spark):
    run = ["a", "b", "c"]
    docs = spark.createDataFrame([(1, "\n".join(["x", *run])), (2, "\n".join(["y", *run, "z"])), (3, "a\nb\nq")], "doc_id int, text string")
    three = {r.doc_id: r.text for r in line_dedup.deduplicate(docs, min_lines=3).collect()}
    assert three == {1: "x\na\nb\nc", 2: "y\nz", 3: "a\nb\nq"}
    two = {r.doc_id: r.text for r in line_dedup.deduplicate(docs, min_lines=2).collect()}
    assert two == {1: "x\na\nb\nc", 2: "y\nz", 3: "q"}
    one = {r.doc_id: r.text for r in line_dedup.deduplicate(docs, min_lines=1).collect()}
    assert one == {1: "x\na\nb\nc", 2: "y\nz", 3: "q"}


def _suffixes(corpus):
    """Suffixes of all different texts in order, with the lines that each shares with the one before, in plain Python."""
    import xxhash

    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    salt = xxhash.xxh64_intdigest("\u0001".encode(), 42)
    name = lambda x: (signed(xxhash.xxh64_intdigest(x.encode(), 42)), signed(xxhash.xxh64_intdigest(x.encode(), salt)))
    least = {}
    for doc, text in corpus:
        if text is not None:
            least[text] = min(least.get(text, (doc is not None, doc or 0)), (doc is not None, doc or 0))
    every = []
    for text, doc in least.items():
        names = [name(x) for x in text.split("\n") if x.strip(" ")]
        every += [(names[k:], doc, name(text), k + 1) for k in range(len(names))]
    every.sort()
    out, before = [], []
    for names, doc, text, seq in every:
        shared = 0
        while shared < min(len(names), len(before)) and names[shared] == before[shared]:
            shared += 1
        out.append((doc[1] if doc[0] else None, text[0], seq, shared))
        before = names
    firsts = [names[0] for names, *_ in every]
    return [row for row, first in zip(out, firsts) if firsts.count(first) > 1]


def _array(spark, rows, partitions=4):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
        return [(r["_d"], r["_t"], r.seq, r.lcp) for r in sorted(line_dedup.suffix_array(documents).collect(), key=lambda r: r["at"])]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_suffix_array_and_common_prefixes(spark, corpus):
    rng = random.Random(9)
    rows = [r for r in corpus if r[0] not in (506, 600)]
    block = [f"line {rng.randint(0, 3)}" for _ in range(60)]
    for i in range(12):  # long runs in common, periodic ones, and all that lies between
        a, b = sorted(rng.sample(range(61), 2))
        rows.append((700 + i, "\n".join([*[f"x{rng.randint(0, 5)}" for _ in range(rng.randint(0, 4))], *block[a:b], *["again"] * rng.randint(0, 20)])))
    assert _array(spark, rows) == _suffixes(rows)


def test_suffix_array_of_runs_of_every_length(spark):
    lines = [f"l{i}" for i in range(40)]
    rows = [(n, "\n".join(lines[:n] + [f"end {n}"])) for n in range(1, 40)]
    got = _array(spark, rows)
    assert got == _suffixes(rows) and max(x[3] for x in got) == 38


def test_blank_lines_and_empty_tables(spark, no_documents):
    docs = spark.createDataFrame([(1, "a\n\nb\nc"), (2, "a\n \nb\n\nd"), (3, None), (4, "")], "doc_id int, text string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.deduplicate(docs).collect()}
    assert got == {1: ("a\n\nb\nc", 3, 0), 2: ("\nd", 3, 2), 3: (None, 0, 0), 4: ("", 0, 0)}
    assert line_dedup.deduplicate(no_documents).count() == 0
