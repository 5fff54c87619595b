"""Near copies of the pipeline's second stage against all pairs."""

import random

import corpus_pipeline
from lexigrain.llm import nearcopies
from lexigrain.llm.nearcopies import near_copies, shingle_set


def texts_with_copies(rng):
    word = lambda: f"w{rng.randrange(400)}x"
    texts = []
    for _ in range(40):
        base = [word() for _ in range(rng.choice([3, 30, 120, 400]))]
        texts.append(" ".join(base))
        for edits in (0, 1, 2, 4, 8):
            t = list(base)
            for _ in range(edits):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t[: len(t) - edits] if edits % 4 else t + [word()] * edits))
    return texts


def components(sets):
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a and b and len(a & b) / len(a | b) >= 0.8):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [top(i) for i in range(len(sets))]


def test_near_copies_match_all_pairs(spark):
    texts = [*texts_with_copies(random.Random(5)), "", None, " \n"]
    want = components([set(shingle_set(t or "", 5).tolist()) for t in texts])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_copies(docs).collect()}
    assert got == dict(enumerate(want))
    assert 40 < len(set(want)) < len(want)


def test_near_copies_of_no_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (None, "z")], "doc_id long, text string")
    assert sorted((str(r[0]), str(r[1])) for r in near_copies(docs).collect()) == [("7", "7"), ("None", "7"), ("None", "None")]
    assert near_copies(docs.limit(0)).count() == 0


def test_pipeline_drops_edited_appended_and_cut_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(3000)}x" for _ in range(120)]
    edited = [*base[:60], "edited", *base[61:]]
    rows = [(2, base), (301, [*base, "more"]), (302, edited), (303, base[:110]), (304, base[:60])]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {2, 304}


def linked_components(n, pairs):
    root = list(range(n))
    for a, b in pairs:
        old, new = root[a], root[b]
        root = [new if r == old else r for r in root]
    return root


def test_simhash_segments_bring_classes_together(spark):
    texts = texts_with_copies(random.Random(8))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = nearcopies.classes(docs).dropDuplicates(["class"])
    rows = known.select("class", "words").collect()
    place = {r["class"]: i for i, r in enumerate(rows)}
    segments = [[w >> s & 0xFFFFFFFF for w in r["words"] for s in (0, 32)] for r in rows]
    near = [
        (i, j) for i, a in enumerate(segments) for j, b in enumerate(segments[:i])
        if any((x ^ y).bit_count() <= 1 for x, y in zip(a, b, strict=True))
    ]
    got = [(place[r["a"]], place[r["b"]]) for r in nearcopies.segment_pairs(known).collect()]
    assert {(max(p), min(p)) for p in got} <= set(near) and len(near) > 40
    want, have = linked_components(len(rows), near), linked_components(len(rows), got)
    assert len(set(zip(want, have, strict=True))) == len(set(want)) == len(set(have))


def test_a_large_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(9)
    base, texts = [f"w{rng.randrange(3000)}x" for _ in range(150)], []
    for _ in range(240):
        t = list(base)
        for k in range(rng.randrange(9)):
            t[rng.randrange(len(t))] = f"e{len(texts)}x{k}"
        texts.append(" ".join(t))
    common = " ".join(f"c{i}" for i in range(14))
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(8)) + ". " + common for _ in range(240)]
    verified, asked = nearcopies.verified, []
    monkeypatch.setattr(nearcopies, "verified", lambda pairs, *rest: asked.append(pairs.count()) or verified(pairs, *rest))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_copies(docs).collect()}
    assert got == dict(enumerate(components([set(shingle_set(t, 5).tolist()) for t in texts])))
    assert sum(asked) < 20 * len(texts) and asked[-1] < len(texts)


def test_each_link_joins_two_components_once(spark, monkeypatch):
    rng = random.Random(10)
    base, texts = [f"w{rng.randrange(3000)}x" for _ in range(150)], []
    for i in range(240):
        t = list(base)
        for k in range(rng.randrange(6)):
            t[rng.randrange(len(t))] = f"e{i}x{k}"
        texts.append(" ".join(t))
    drift = [f"d{rng.randrange(3000)}x" for _ in range(150)]
    for i in range(60):  # each is near the one before it, the last far from the first
        drift[rng.randrange(150)] = f"d{i}y"
        texts.append(" ".join(drift))
    found, verified, merge, asked, joined = [], nearcopies.verified, nearcopies.connected_components, [], []

    def seen(pairs, *rest):
        asked.append(pairs.count())
        return verified(pairs, *rest)

    def followed(edges, *rest):
        found.extend((r["a"], r["b"]) for r in edges.collect())
        joined.append(edges.count())
        return merge(edges, *rest)

    monkeypatch.setattr(nearcopies, "verified", seen)
    monkeypatch.setattr(nearcopies, "connected_components", followed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_copies(docs).collect()}
    assert got == dict(enumerate(components([set(shingle_set(t, 5).tolist()) for t in texts])))
    assert all(a != b for a, b in found)
    assert sum(joined) < 3 * len(texts) and sum(asked) < 6 * len(texts)


def test_no_step_repeats_the_shuffles_of_another(spark, monkeypatch):
    """The driver's memory grows with shuffles and their tasks: 114 of these plans here when each step joined components and looks anew."""
    store, shuffles = nearcopies.materialise, []

    def counted(df, label):
        shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return store(df, label)

    monkeypatch.setattr(nearcopies, "materialise", counted)
    monkeypatch.setattr(nearcopies, "TURNS", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = texts_with_copies(random.Random(11))[:60]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r["doc_id"]: r["component_id"] for r in near_copies(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == dict(enumerate(components([set(shingle_set(t, 5).tolist()) for t in texts])))
    assert sum(shuffles) < 100
