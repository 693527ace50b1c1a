"""Filter audit, whitening and nearest neighbours against brute force, on
small tables with nulls, empty and very long values, ties, repeated rows, an
empty table and extra columns with clashing names."""

from __future__ import annotations

import random
import re
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest

from cairnspark.llm import filter_audit, neighbours, pii, substring, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, part string, fails int, good boolean, n long, step int, digest binary, words string"


# --- filter audit ------------------------------------------------------------


@pytest.fixture(scope="module")
def documents():
    r = random.Random(3)
    vocab = ["".join(r.choice("abcXYé") for _ in range(r.randint(1, 6))) for _ in range(400)]
    rows = [(i, " ".join(r.choice(vocab[: r.choice([3, 400])]) for _ in range(r.choice([5, 199, 200, 300]))) + r.choice(["", "", " $", "\x0b|"]), r.choice(["en", "fr", None, ""])) for i in range(150)]
    rows += [(150 + i, rows[i % 9][1], r.choice(["en", "de"])) for i in range(40)]
    rows += [(300, "", "en"), (301, None, "en"), (302, " \t\x0b", None), (None, rows[2][1], "en"), (None, None, None), (7, rows[7][1], "en"), (7, rows[7][1], "fr")]
    rows += [(303, "a b " * 200_000, "en"), (304, "\x1c\x85 " * 200, "fr"), (305, "ABC " + "x" * 97, "en")]
    return rows


@pytest.fixture(scope="module")
def labelled():
    r = random.Random(4)
    rows = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 200, 2)]
    return [*rows, (4, 1, 0), (4, 0, 1), (9999, 1, 1), (None, 1, 1)]


def audited(rows, labels):
    """Each filter by itself, then each order step by step over all rows."""
    fails = []
    for d, text, _ in rows:
        t = text or ""
        w = WORD.findall(t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        f["E"] = d is not None and any(x is not None and x < d and (y or "") == t for x, y, _ in rows)
        fails.append({k for k, v in f.items() if v})
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    out = {}
    for part in {lang or "" for _, _, lang in rows}:
        own = [(d, f) for (d, _, lang), f in zip(rows, fails, strict=True) if (lang or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                lost = [x for x in left if letter in x[1]]
                earlier = [x for x in own if letter in x[1] and x[1] & set(order[: step - 1])]
                left = [x for x in left if letter not in x[1]]
                out[part, order, step] = [len(left), len(lost), len(earlier), sum(f == {letter} for _, f in own), sum(d in good for d, _ in lost), sum(d in toxic for d, _ in lost)]
        for letter in "ABCDE":
            mine = [k for k in out if k[0] == part and k[1][k[2] - 1] == letter]
            total = sum(out[k][1] for k in mine)
            for k in mine:
                out[k].append(total)
    return out


def test_filter_audit(spark, documents, labelled):
    docs = spark.createDataFrame([(d, t, lang, "p", 1, True, 2, 3, b"x", "w") for d, t, lang in documents], DOCS)
    labels = spark.createDataFrame([(*x, "t") for x in labelled], "doc_id long, quality int, toxic int, text string")
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in filter_audit.audit(docs, labels).collect()}
    assert got == audited(documents, labelled)
    none = spark.createDataFrame([], DOCS)
    assert filter_audit.audit(none, labels).count() == 0
    assert len(filter_audit.audit(docs, labels.limit(0)).collect()) == len(got)
    assert filter_audit.edges(filter_audit.cells(filter_audit.failures(docs), labels), list("ABCDE")).count() == 80 * len({k[0] for k in got})


def test_filter_audit_of_other_filters(spark, documents, labelled):
    """Two filters of one's own: four steps, and no need of the whole table."""
    docs = spark.createDataFrame([(d, t, lang) for d, t, lang in documents], "doc_id long, text string, lang string")
    labels = spark.createDataFrame(labelled, "doc_id long, quality int, toxic int")
    rules = {"x": lambda text, words: text.contains("X"), "y": lambda text, words: text.contains("Y")}
    out = filter_audit.audit(docs, labels, rules).where("part = 'en'").collect()
    own = [t or "" for _, t, lang in documents if lang == "en"]
    assert {(r["filter_order"], r["step"]): r["kept"] for r in out} == {
        ("xy", 1): sum("X" not in t for t in own), ("xy", 2): sum("X" not in t and "Y" not in t for t in own),
        ("yx", 1): sum("Y" not in t for t in own), ("yx", 2): sum("X" not in t and "Y" not in t for t in own),
    }


# --- whitening ---------------------------------------------------------------

EMBEDDINGS = "vec_id long, embedding array<float>, label int, x binary, d int, v string, n long"


def embedded(spark, rows, kind=EMBEDDINGS):
    return spark.createDataFrame([(i, v, 1, b"x", 2, "v", 3) for i, v in rows], kind)


@pytest.fixture(scope="module")
def points():
    r = np.random.default_rng(2)
    base = r.normal(size=(90, 6)) * [3, 2, 1, 0.5, 0.25, 0.1] + 5
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base)]
    rows += [(100 + i, rows[i % 5][1]) for i in range(45)]
    bad = [(200, None), (201, []), (202, [1.0] * 5), (203, [float("nan")] * 6), (204, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (205, [float("inf")] + [1.0] * 5)]
    return rows + [(3, rows[3][1]), (None, rows[4][1]), (None, [0.0] * 6)], bad


def test_whitening(spark, points):
    good, bad = points
    out = whitening.whitened(embedded(spark, good + bad)).collect()
    x = [[int(np.floor(256.0 * c)) for c in v] for _, v in good]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)] for v in fit])
    values, right = np.linalg.eigh(centred.T @ centred / n)
    values, right = values[::-1], right[:, ::-1]
    assert {(r["n"], r["component"]) for r in out} == {(n, c) for c in (1, 2, 3, 4)} and len(out) == 4 * len(good)
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    want_white = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)] for v in x]) @ right[:, :4] / np.sqrt(values[:4])
    for c in (1, 2, 3, 4):
        rows = [r for r in out if r["component"] == c]
        assert sorted((str(r["vec_id"]), r["deviation"]) for r in rows) == sorted((str(i), d) for (i, _), d in zip(good, deviation, strict=True))
        assert all(int(r["exact_deviation"]) == r["deviation"] for r in rows)
        got = sorted((r["deviation"], r["whitened"]) for r in rows)
        sides = [sorted((d, side * w) for d, w in zip(deviation, want_white[:, c - 1], strict=True)) for side in (1, -1)]
        assert min(max(abs(a[1] - b[1]) for a, b in zip(got, want, strict=True)) for want in sides) < 1e-9
        assert {r["explained"] for r in rows} == {rows[0]["explained"]} and rows[0]["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-12)
        assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and 0 <= rows[0]["identity_error"] < 1e-12


def test_whitening_of_little(spark):
    one = whitening.whitened(embedded(spark, [(1, [1.0, 2.0, 3.0, 4.0, 5.0])] * 3)).collect()
    assert len(one) == 12 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(1, 0, None, None, None)}
    flat = whitening.whitened(embedded(spark, [(i, [float(i), 7.0]) for i in range(9)])).collect()
    assert {r["component"] for r in flat} == {1, 2} and all((r["whitened"] is None) == (r["component"] == 2) for r in flat)
    assert whitening.whitened(embedded(spark, [(1, None)])).count() == 0 and whitening.whitened(embedded(spark, [])).columns == [c.split()[0] for c in whitening.RESULT.split(", ")]


def test_whitening_of_large_numbers(spark):
    """Beyond what a long holds: exact as a decimal as far as that goes."""
    rows = [(i, [1e9 * i, -3e8 * i * i]) for i in range(12)] + [(50, [3e38, -3e38])]
    out = {r["vec_id"]: r for r in whitening.whitened(embedded(spark, rows[:12])).where("component = 1").collect()}
    x = [[int(np.floor(256.0 * float(np.float32(c)))) for c in v] for _, v in rows[:12]]
    sums = [sum(c) for c in zip(*x, strict=True)]
    exact = [sum((12 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    assert [int(out[i]["exact_deviation"]) for i in range(12)] == exact and max(exact) > whitening.LARGEST
    assert [out[i]["deviation"] for i in range(12)] == [e if e <= whitening.LARGEST else None for e in exact]
    assert whitening.whitened(embedded(spark, rows)).where("whitened is not null").count() == 26


def test_factors_meet_in_a_tree(spark):
    """More tasks than one merge takes; equal to the factor of all rows."""
    r = np.random.default_rng(1)
    x = r.integers(-3000, 3000, (400, 5))
    rows = spark.createDataFrame([(v,) for v in whitening.packed(x)], "x binary").repartition(40)
    centre = whitening.Centre(len(x), x.sum(axis=0).tolist())
    f = whitening.factor(rows, centre)
    c = x - x.mean(axis=0)
    assert f.T @ f == pytest.approx(c.T @ c, rel=1e-9, abs=1e-3)


# --- nearest neighbours ------------------------------------------------------


def nearest_by_force(rows, every, k):
    """Every query against every other row, in exact order."""
    fit = {(i, tuple(v)) for i, v in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    fit = sorted(fit)
    m = np.array([v for _, v in fit])
    out = {}
    for i, v in fit:
        if i % every == 0:
            s = neighbours.cosines(m, np.array(v))
            out[i] = sorted((-c, j) for c, (j, w) in zip(s.tolist(), fit, strict=True) if (j, w) != (i, v))[:k]
    return out


@pytest.fixture(scope="module")
def near():
    """Clusters, a hot vector, its multiples, ties and what takes no part."""
    r = np.random.default_rng(8)
    middle = r.normal(size=(20, 8))
    rows = [(i, [float(np.float32(c)) for c in middle[i % 20] + 0.2 * r.normal(size=8)]) for i in range(400)]
    hot = rows[50][1]
    rows += [(400 + i, hot) for i in range(150)] + [(600 + i, [2 * c for c in hot]) for i in range(5)] + [(50, hot), (50, hot), (3, rows[3][1])]
    rows += [(700, None), (750, [0.0] * 8), (800, [1.0] * 7), (850, [1.0] * 7 + [float("nan")]), (900, [1.0] * 7 + [None]), (None, hot), (950, [])]
    return rows


def test_neighbours(spark, near):
    """A radius of all bits finds all; the learned one at least 0.9 of them,
    with the right measure, order and number of rows."""
    want = nearest_by_force(near, 10, 5)
    table = embedded(spark, near)
    rows = neighbours.keyed(table)
    index = neighbours.build(rows, chunk=64)
    queries = rows.where(f"d = {index.d} and vec_id % 10 = 0").select("vec_id", "hash", "v")
    index.radius = neighbours.BITS
    whole: dict = {}
    for r in index.search(queries).orderBy("query_id", "rank").collect():
        whole.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert {q: [j for j, _ in found] for q, found in whole.items()} == {q: [j for _, j in found] for q, found in want.items()}
    assert all(s == pytest.approx(-c, abs=1e-15) for q in want for (_, s), (c, _) in zip(whole[q], want[q], strict=True))
    learned: dict = {}
    for r in neighbours.nearest(table, every=10).collect():
        learned.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert {q: sorted(found) for q, found in learned.items()} == {q: [1, 2, 3, 4, 5] for q in want}
    hits = sum(len(set(learned[q].values()) & {j for _, j in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert neighbours.recall(index, queries.groupBy("hash").agg({"v": "first"}).withColumnRenamed("first(v)", "v")) == 1.0


def test_neighbours_within_a_small_radius_are_completed(spark, near):
    """Queries that find too little in the radius are put to all vectors."""
    table = embedded(spark, near)
    rows = neighbours.keyed(table)
    index = neighbours.build(rows)
    index.radius = 0
    queries = rows.where(f"d = {index.d} and vec_id % 10 = 0").select("vec_id", "hash", "v")
    found = index.search(queries).groupBy("query_id").count().collect()
    assert {r["count"] for r in found} == {5} and len(found) == len(nearest_by_force(near, 10, 5))


def test_neighbours_of_few(spark):
    few = [(50, [1.0] * 8), (51, [1.0] * 7 + [2.0]), (52, [-1.0] * 8)]
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(embedded(spark, few)).orderBy("rank").collect()]
    assert got == [(50, 1, 51), (50, 2, 52)]
    assert neighbours.nearest(embedded(spark, [])).count() == 0 and neighbours.nearest(embedded(spark, few[:1])).count() == 0


def test_tables_reach_every_code_within_the_radius():
    r = np.random.default_rng(5)
    matrix = r.normal(size=(3000, 16))
    rotations = neighbours.learned_rotations(neighbours.units(matrix[:500]))
    assert rotations.shape == (16, neighbours.BITS)
    row = dict(zip(neighbours.Chunk.FIELDS, neighbours.Chunk.built(np.arange(3000), [b"0" * 16] * 3000, matrix, True, rotations), strict=True))
    chunk = neighbours.Chunk(row, 16)
    every = np.arange(3000)
    for q in range(40):
        far = chunk.distances(chunk.codes[q], every)
        for radius in (0, 3, 15, 16, 17, 40, 77, 128):
            rows, found = chunk.within(chunk.codes[q], radius)
            assert rows.tolist() == np.flatnonzero(far <= radius).tolist() and found.tolist() == far[far <= radius].tolist()
    assert all(sum(s + 1 for s in neighbours.shares(radius)) > radius for radius in range(129))


# --- texts of few words that are repeated very often ---------------------------


def removed_by_force(rows):
    """Words covered by a window that starts in a smaller document too."""
    first: dict = {}
    for d, text in rows:
        w = WORD.findall(text)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, text in rows:
        w = WORD.findall(text)
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < d for p in range(k, k + 13)}
        out[d] = (len(w), len(gone))
    return out


def test_repeated_lines_within_documents(spark):
    """Documents of one repeated word or line, alone and shared, in one task
    and in many."""
    r = random.Random(12)
    line = " ".join(f"w{i}" for i in range(17))
    rows = [(1, "a " * 3000), (2, "b " * 2000 + "end"), (3, "x " + "a " * 40 + "y"), (4, f"{line} " * 90), (5, f"z {line} {line} " + "b " * 12), (6, "c " * 5000), (7, "b " * 13), (8, f"{line} " * 30 + "c " * 14)]
    rows += [(10 + i, " ".join(r.choice("pqr") for _ in range(120))) for i in range(20)]
    want = removed_by_force(rows)
    for parts in (1, 12):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert {x["doc_id"]: (x["n_words"], x["n_removed"]) for x in substring.deduplicated(df).collect()} == want


def test_equal_keys_of_a_document_are_one_entry():
    keys = np.repeat(np.arange(3, dtype=np.uint64), 1000)
    out = list(substring.settled_and_sent(16, keys, np.zeros(3000, np.uint64), np.zeros(3000, np.int64), np.zeros(3000, np.int64), np.arange(3000, dtype=np.int32), True, substring.Known()))
    assert sum(len(substring.unpack(b.column("pos")[0].as_py(), "<i4")) for b in out) == 3


# --- what the links of the field add -------------------------------------------


def test_links_find_mentions_that_no_feature_tells(monkeypatch):
    """Mentions repeated in other forms, with the links and without: with
    them more are found, and nothing else is."""
    r = random.Random(9)
    make = (lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)), lambda: f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}")
    plain = lambda: r.choice(["in 1999", "version 2.0.", "1,200 of 3.14", "2024-05-06", "room 7-12"])
    field = pii.train([n for _ in range(200) for n in pii.lessons(f"so {r.choice(make)()} and {plain()} or {plain()} end", 1)])
    cases = []
    for _ in range(80):
        kind = r.choice([1, 3])
        first = make[kind == 3]()
        again = pii.FORMS[kind](r, first)
        text = f"so {first} and {plain()} then {again} or {plain()}"
        base = pii.base_spans(text)
        if [k for k, *_ in base] == [kind]:
            cases.append((text, base, kind, text.rindex(again)))

    def found():
        hits = extra = 0
        for text, base, kind, at in cases:
            got = pii.added_spans(text, base, field)
            hits += any(k == kind and e > at for k, _, e in got)
            extra += sum(e <= at for _, _, e in got)
        return hits, extra

    on = found()
    real = pii.nodes_of

    def unlinked(text, base):
        n = real(text, base)
        n.links = np.zeros((0, 2), np.int64)
        return n

    monkeypatch.setattr(pii, "nodes_of", unlinked)
    off = found()
    assert len(cases) > 50 and on[0] > off[0] + len(cases) // 10 and on[1] == off[1] == 0
