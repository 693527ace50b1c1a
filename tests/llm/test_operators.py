"""Each operator against a brute-force version or its SQL, on a small table
with nulls, empty and very long texts, ties, repeated rows, an empty table
and extra columns with clashing names."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cairnspark.llm import chat, decontaminate, exact_dedup, lm_scoring, mixing, pii, quality, queries, simhash, substring, token_output

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, row string, places string, component_id string"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def rows():
    """Texts of a small vocabulary, with the cases that break things."""
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdeéßXyz") for _ in range(r.randint(1, 7))) for _ in range(300)]
    passage = " ".join(r.choice(vocab) for _ in range(40))
    out = []
    for i in range(120):
        text = " ".join(r.choice(vocab) for _ in range(r.choice([1, 2, 5, 30, 80])))
        if i % 7 == 0:
            text += f"\n{passage} end{i}"
        out.append((i, text))
    out += [(200, out[3][1]), (201, out[3][1].replace(" ", "\t\n ")), (202, out[3][1]), (202, out[3][1]), (203, ""), (204, None), (205, " \x0b\x0c"), (None, out[3][1]), (None, None)]
    out += [(206, " ".join(r.choice(vocab) for _ in range(20000))), (207, "x" * 50000), (208, "\x1c a\x85b  c d"), (209, passage), (202, passage + " other text under the same id")]
    return [(d, t, r.choice(["en", "fr", None]), r.choice(["src0", "src1", "src7", "odd", None]), 1, 5, "k", "r", "p", "c") for d, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_exact_duplicates(docs, rows, empty):
    norm = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t, *_ in rows]
    want = []
    for d, t in norm:
        ids = [x for x, y in norm if y == t]
        keep = min((x for x in ids if x is not None), default=None)
        want.append((d, keep, len(ids), d == keep, hashlib.sha256(t.encode()).hexdigest()))
    cols = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got(exact_dedup.exact_duplicates(docs), *cols) == sorted(want, key=str)
    weak = {"weak": lambda c: F.length(c) % 3, **exact_dedup.DIGESTS}  # identifiers that clash are found out
    assert exact_dedup.verified_digest(exact_dedup.chunked(docs, "doc_id", "text", every=4), weak) == "xxhash64"
    assert got(exact_dedup.exact_duplicates(docs, digests=weak), *cols) == sorted(want, key=str)
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_chunks_join_to_the_text(docs):
    for r in exact_dedup.chunked(docs, "doc_id", "text", every=4).collect():
        assert "".join(r["chunks"]) == r["norm"]


def test_exact_duplicates_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(queries.SQL["op2_exact_dedup"]).fetchall()
    assert got(queries.op2_exact_dedup(spark, sf), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=str)


def brute_fingerprint(text):
    w = words(lower(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates(docs, rows, empty):
    prints = [brute_fingerprint(t) for _, t, *_ in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 2 and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    want = []
    for (d, *_), p, g in zip(rows, prints, group, strict=True):
        ids = [r[0] for r, k in zip(rows, group, strict=True) if k == g and r[0] is not None]
        want.append((d, format(p, "016x"), min(ids, default=None)))
    assert got(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == sorted(want, key=str)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns


def test_links_reach_all_pairs(spark):
    """Chains and dense clusters: same components as all pairs within two bits."""
    r = random.Random(3)
    codes = {r.getrandbits(64) for _ in range(30)}
    for base in list(codes)[:5]:
        for _ in range(60):
            x = base
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.randrange(64)
            codes.add(x)
    x = 0
    for b in range(0, 64, 2):  # a chain of single steps of two bits
        codes.add(x)
        x |= 3 << b
    codes = sorted(codes)
    parent = {c: c for c in codes}

    def top(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for i, a in enumerate(codes):
        for b in codes[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[top(a)] = top(b)
    sign = lambda c: c - (1 << 64) if c >> 63 else c
    df = spark.createDataFrame([(sign(c),) for c in codes], "fp long")
    roots = {r["node"] % (1 << 64): r["root"] for r in simhash.components(simhash.links(df)).collect()}
    ours, want = {}, {}
    for c in codes:
        ours.setdefault(roots.get(c, sign(c)), set()).add(c)
        want.setdefault(top(c), set()).add(c)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("segments, crowded", [(2, 0), (2, 3), (3, 64), (4, 2), (5, 64), (7, 64), (12, 0)])
def test_segment_tables_find_all_links(spark, segments, crowded):
    """Whatever the segments, and where a segment value is crowded: all pairs within two bits are connected, no others."""
    r = random.Random(segments * 100 + crowded)
    codes = {r.getrandbits(64) for _ in range(20)}
    for base in list(codes)[:6]:
        codes |= {base ^ 1 << a ^ 1 << b for a, b in ([r.sample(range(64), 2) for _ in range(12)] + [(63, 62), (0, 63), (31, 32), (63, 63 - 1)])}
        codes |= {base ^ 1 << b for b in (0, 21, 31, 32, 62, 63)}
        codes |= {base ^ 7 << b for b in (0, 30, 61)}
    codes |= {0, (1 << 64) - 1}
    codes, sign = sorted(codes), lambda c: c - (1 << 64) if c >> 63 else c
    assert sum(n for _, n, _ in simhash.segment_widths(segments)) <= 64
    found = {frozenset((x["u"] % (1 << 64), x["v"] % (1 << 64))) for x in simhash.links(spark.createDataFrame([(sign(c),) for c in codes], "fp long"), segments, crowded).collect()}
    want = {frozenset((a, b)) for i, a in enumerate(codes) for b in codes[:i] if (a ^ b).bit_count() <= 2}
    assert found <= want
    if crowded == 64:
        assert found == want

    def classes(pairs):
        top = {c: c for c in codes}
        for _ in range(len(codes)):
            for a, b in map(sorted, pairs):
                top[a] = top[b] = min(top[a], top[b])
        return top

    assert classes(found) == classes(want)


def test_near_duplicates_keep_one_row_of_a_class(spark):
    """Repeated rows, texts that share a doc_id, null ids and columns of clashing names."""
    same, other = "a b c d e f g", "one two three four five six"
    rows = [(1, same, "x"), (1, same, "x"), (1, same, "y"), (2, same, "z"), (1, other, "p"), (3, other, "q"), (None, other, "n"), (None, "alone it stands here now", "m"), (None, "alone it stands here now", "m"), (5, None, "e"), (4, "", "f")]
    df = spark.createDataFrame([(d, t, s, 1, 2, 3) for d, t, s in rows], "doc_id long, text string, source string, _id int, fp int, root int")
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    out = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert out == sorted([(1, same), (1, other), (None, "alone it stands here now"), (4, "")], key=str)
    assert simhash.deduplicated(df.limit(0)).count() == 0


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_token_output(docs, rows, empty):
    t = tokenizer()
    order = sorted(((d, x or "") for d, x, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want, every = [], []
    for d, x in order:
        ids = [*t.encode(x, add_special_tokens=False).ids, 2]
        want.append((d, len(every), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        every += ids
    codes = token_output.write_codes(docs, queries.tokenizer_path(), segment_tokens=500)
    assert sorted(got(token_output.read_index(codes), "doc_id", "start", "n_tokens", "ids_crc32"), key=lambda r: r[1]) == want
    for k in (0, 1, 499, 500, 501, len(every) // 2, len(every) - 1):
        assert token_output.token_at(codes, k) == every[k]
    assert token_output.read_index(token_output.write_codes(empty, queries.tokenizer_path())).count() == 0


def test_words_have_the_ids_of_the_whole_text():
    """Special tokens, letters whose small or normal form is not one letter, marks, signs of all kinds."""
    import pyarrow as pa

    r, t, own = random.Random(1), tokenizer(), token_output.WordTokenizer(queries.tokenizer_path())
    assert own.letters is not own.model
    alpha = "abzé İıßſKÅµªº×÷ÿÀÞ.,!'\"-_<|>DžςΣσ9½٣ \t\nſ́\u0307क़यִיִ한中🙂\u00a0\u2003\u200d\x1c\x85`^~#@"
    whole = ["BİLGİ.", "İ!", "<|endoftext|>", "<|startoftext|>", "it's", "don't.", "we'll", "l'été", "x<|endoftext|>y", "endoftext|>", "É.", "ÀÉ!!", "éa."]
    for _ in range(60):
        texts = ["".join(r.choice(whole) if r.random() < 0.08 else r.choice(alpha) for _ in range(r.randint(0, 40))) for _ in range(100)] + whole
        ids, sizes = own.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65535, 65536, 2**32 - 1], list(range(0, 5000, 7)), [300] * 2000])
def test_codes_round_trip(ids):
    s = token_output.Segment(token_output.encode_segment(np.array(ids, dtype=np.uint32)))
    assert s.all().tolist() == ids
    assert [s.access(i) for i in range(len(ids))] == ids


def test_quality(spark, sf, docs, empty):
    out = queries.op5_quality(spark, sf)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = {r["doc_id"]: r for r in out.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for d, r in found.items())
    held = [d for d in labels if found[d]["held_out"]]
    assert sum(found[d]["predicted"] == labels[d] for d in held) / len(held) >= 0.8
    some = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, quality int")
    assert quality.classified(docs, some).count() == docs.count()
    assert {r["score"] for r in quality.classified(docs, some.limit(0)).collect()} == {0.5}
    assert quality.classified(empty, some).count() == 0


def plain_features(word, s):
    """Buckets of one word, sign by sign in whole numbers."""
    mix = lambda h: (lambda x: (x ^ x >> 13) & (s.buckets - 1))((h ^ h >> 15) * 0x2C1B3C6D % 2**32)
    step, signs, whole, power = 0x9E3779B1, [ord(c) for c in f"<{word}>"], 0, 1
    for c in signs:
        power = power * step % 2**32
        whole = (whole + c * power) % 2**32
    out = [mix(whole ^ 0x85EBCA6B)]
    for n in range(s.ngrams[0], s.ngrams[1] + 1):
        for i in range(len(signs) - n + 1):
            code = 0
            for c in signs[i : i + n]:
                code = (code * step + c) % 2**32
            out.append(mix((code + n) % 2**32))
    return out


def test_quality_scores_against_brute_force(spark, docs, rows):
    s = quality.Settings(buckets=1 << 10)
    r = np.random.default_rng(1)
    model = quality.Model(r.normal(size=s.buckets), 0.3, s)
    want = {}
    for d, t, *_ in rows:
        found = [b for w in words(t) for b in plain_features(w, s)]
        z = 0.3 + sum(model.margins[b] for b in found) / (len(found) + s.smooth)
        want.setdefault(d, []).append(round(1 / (1 + math.exp(-z)), 9))
    mine = {}
    for x in quality.scored(docs, model).collect():
        mine.setdefault(x["doc_id"], []).append(round(x["score"], 9))
    assert {d: sorted(v) for d, v in mine.items()} == {d: sorted(v) for d, v in want.items()}
    import pyarrow as pa

    buckets, share = next(quality.documents(pa.array(["aa bé aa\tx"]), s))
    count = Counter(b for w in ("aa", "bé", "aa", "x") for b in plain_features(w, s))
    assert dict(zip(buckets.tolist(), (share * (sum(count.values()) + s.smooth)).round(3).tolist(), strict=True)) == dict(count)
    kept = quality.accepted(docs, model, 0.5)
    assert kept.columns == docs.columns and kept.count() == sum(x >= 0.5 for v in want.values() for x in v)


def test_quality_cases(spark, docs):
    some = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (4, 1)], "doc_id long, quality int")
    out = quality.classified(docs, some).collect()
    assert {x["held_out"] for x in out if x["doc_id"] is None} == {False} and all(x["held_out"] is not None for x in out)
    small = quality.fit(docs, some, settings=quality.Settings(max_features=1))
    assert not small.margins.any() or small.margins.shape == (quality.Settings().buckets,)
    odd = docs.withColumn("_rated", F.lit("x")).withColumn("_RATED2", F.lit(1))
    assert quality.accepted(odd, quality.Model(np.zeros(1 << 17), 1.0, quality.Settings())).columns == odd.columns


def test_quality_learns():
    r = random.Random(2)
    clean = lambda: " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(50)).encode()
    junk = lambda: " ".join(r.choice(["BUY!!", "NOW##", "alpha"]) for _ in range(50)).encode()
    model = quality.train([(clean(), 1) for _ in range(50)] + [(junk(), 0) for _ in range(50)], (50, 50), quality.Settings())
    rate = quality.Scorer(model)
    assert all(rate(clean()) > 0.5 > rate(junk()) for _ in range(20))
    assert 0 < rate(b"") < 1


def test_lm_scoring(docs, rows, empty):
    tokens = [[*words(lower(t)), None] for _, t, *_ in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, *_ in rows]
    count = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(count.values()), len(count)
    top = {w for w, _ in sorted(count.items(), key=lambda x: -x[1])[:64]}
    cut = sorted(count.values(), reverse=True)[63]
    out = lm_scoring.scored(docs, states=64, batch_words=500)
    want = sorted(
        ((d, h, len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 6)) for (d, *_), t, h in zip(rows, tokens, held, strict=True)), key=str
    )
    mine = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out.collect()), key=str)
    assert [x[:5] for x in mine] == [x[:5] for x in want]
    assert np.allclose([x[5] for x in mine], [x[5] for x in want])
    assert top and cut >= 1
    assert lm_scoring.scored(empty).count() == 0
    assert all(r["score"] == r["base_score"] == 0 for r in lm_scoring.scored(docs.where("doc_id = 9999 or doc_id is null and false")).collect())


def test_lm_scoring_knows_all_pairs(docs, rows):
    """Every observed pair of words counts, however few words are cached."""
    tokens = [[*words(lower(t)), None] for _, t, *_ in rows]
    train = [t for (d, *_), t in zip(rows, tokens, strict=True) if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    count, left, seen = Counter(w for t in train for w in t), Counter(), Counter()
    for t in train:
        for a, b in zip([""] + t, t, strict=False):
            left[a] += 1
            seen[a, b] += 1
    n, v = sum(count.values()), len(count)
    weigh = lambda a, b: math.log10((seen[a, b] + 64 * (count[b] + 1) / (n + v + 1)) / (left[a] + 64))
    want = sorted((str(d), len(t), sum(weigh(a, b) for a, b in zip([""] + t, t, strict=False))) for (d, *_), t in zip(rows, tokens, strict=True))
    for states in (0, 5, 2048):
        mine = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in lm_scoring.scored(docs, states=states, batch_words=500).collect())
        assert [x[:2] for x in mine] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in mine], [x[2] for x in want], rtol=1e-6)


def test_automaton_is_a_distribution_and_one_pass():
    r = np.random.default_rng(1)
    pairs, root = r.integers(0, 4, (7, 6)), r.random(6)
    root /= root.sum()
    a = lm_scoring.Automaton(pairs, root, 3.0)
    for s in range(7):
        assert abs(sum(10 ** a.step(s, c)[1] for c in range(6)) - 1) < 1e-5
    symbols, lens = r.integers(0, 6, 50), np.array([20, 1, 29])
    at, want = 0, []
    for n in lens:
        state = a.start
        for c in symbols[at : at + n]:
            state, w = a.step(state, int(c))
            want.append(w)
        at += n
    assert np.allclose(a.run(symbols, lens), want)


def brute_removed(rows):
    first = {}
    for d, t, *_ in rows:
        w = words(t)
        for s in range(len(w) - 12):
            key = tuple(w[s : s + 13])
            first[key] = min(first.get(key, math.inf), math.inf if d is None else d)
    for d, t, *_ in rows:
        w = words(t)
        gone = set()
        for s in range(len(w) - 12):
            if first[tuple(w[s : s + 13])] < (math.inf if d is None else d):
                gone |= set(range(s, s + 13))
        yield d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()


def test_substring(docs, rows, empty):
    assert got(substring.deduplicated(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute_removed(rows), key=str)
    assert substring.deduplicated(empty).count() == 0


def test_substring_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    cols = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert got(queries.op8_substring(spark, sf), *cols) == sorted(con.sql(f"select {', '.join(cols)} from ({substring.SQL})").fetchall(), key=str)


def test_substring_at_every_offset(spark):
    """Matches of exactly 13 and 12 words at all pairs of offsets modulo 7."""
    rows, k = [], 0
    for a in range(7):
        for b in range(7):
            for n in (12, 13):
                shared = [f"s{k}_{i}" for i in range(n)]
                for d, pad in ((2 * k, a), (2 * k + 1, b)):
                    rows.append((d, " ".join([f"p{d}_{i}" for i in range(pad)] + shared + [f"q{d}_{i}" for i in range(9)])))
                k += 1
    out = substring.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute_removed(rows), key=str)


def test_cover():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))
    assert substring.PERIOD - 1 + substring.ANCHOR <= substring.WINDOW


def plain(text):
    return words("".join((c.lower() if c.isalnum() else " ") if "!" <= c <= "~" else c for c in text or ""))


def test_decontaminate(spark, docs, rows, empty):
    r = random.Random(9)
    items = [(1, rows[0][1][-200:]), (2, " ".join(plain(rows[-2][1])[:12])), (3, "one two"), (4, None), (5, ""), (6, " ".join(plain(rows[-2][1]))), (6, " ".join(plain(rows[-2][1])))]
    items += [(10 + k, " ".join(w if r.random() > 0.01 else "zzz" for w in plain(rows[k][1]))) for k in range(0, 60, 3)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    bag = lambda g: Counter(g)
    want = set()
    for d, t, *_ in rows:
        w = plain(t)
        for item, u in items:
            u = plain(u)
            n = min(5, len(u))
            if not u:
                continue
            mine, theirs = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)], bag(tuple(u[i : i + n]) for i in range(len(u) - n + 1))
            m = min(len(u) - n + 1, len(mine))  # a shorter document is one window as a whole
            best = max((sum((bag(mine[s : s + m]) & theirs).values()) / sum((bag(mine[s : s + m]) | theirs).values()) for s in range(len(mine) - m + 1)), default=0)
            if best >= 0.8:
                want.add((d, item, round(best, 9)))
    mine = {(x["doc_id"], x["item_id"], round(x["similarity"], 9)) for x in decontaminate.contaminated(docs, bench).collect()}
    assert mine == want and len(want) > 20
    dirty = {d for d, *_ in want}
    left = decontaminate.decontaminated(docs, bench)
    assert left.columns == docs.columns and {x["doc_id"] for x in left.collect()} >= {d for d, *_ in rows} - dirty - {None}
    assert decontaminate.contaminated(empty, bench).count() == decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_decontaminate_documents_shorter_than_the_item(spark):
    """All lengths and places of a piece of an item, at and around 0.8."""
    item = [f"w{i}" for i in range(60)]
    pieces = [(a, b) for a in (0, 1, 5, 9) for b in range(40, 61) if a < b]
    pieces += [(0, n) for n in range(1, 40)]
    docs = [(k, " ".join(item[a:b])) for k, (a, b) in enumerate(pieces)]
    docs += [(900, " ".join(item[:30] + ["new"] + item[31:56])), (901, " ".join(item[:5] * 11)), (902, ""), (903, None)]
    items = [(1, " ".join(item)), (2, " ".join(item[:9])), (3, "w0 w1 w2 w3"), (4, " ".join(item[:5] * 12))]
    want = set()
    for d, t in docs:
        w = plain(t)
        for i, u in items:
            u = plain(u)
            n = min(5, len(u))
            mine, theirs = [tuple(w[x : x + n]) for x in range(len(w) - n + 1)], Counter(tuple(u[x : x + n]) for x in range(len(u) - n + 1))
            m = min(len(u) - n + 1, len(mine))
            best = max((sum((Counter(mine[s : s + m]) & theirs).values()) / sum((Counter(mine[s : s + m]) | theirs).values()) for s in range(len(mine) - m + 1)), default=0)
            if best >= 0.8:
                want.add((d, i, round(best, 9)))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert (pieces.index((0, 55)), 1, round(51 / 56, 9)) in want and (901, 4) in {x[:2] for x in want}
    assert {(x["doc_id"], x["item_id"], round(x["similarity"], 9)) for x in decontaminate.contaminated(table, bench).collect()} == want
    assert {x["doc_id"] for x in decontaminate.decontaminated(table, bench).collect()} == {d for d, _ in docs} - {x[0] for x in want}


def test_index_finds_all_within_radius():
    r = np.random.default_rng(4)
    items = [(k, " ".join(f"w{x}" for x in r.integers(0, 999, 20)).encode()) for k in range(30)]
    index = decontaminate.Index(items, 24, 0.8)
    _, ids, _, prints, tables = index.sizes[20]
    for _ in range(200):
        k = int(r.integers(30))
        code = prints[k]
        for b in r.choice(64, int(r.integers(0, 25)), replace=False):
            code ^= np.uint64(1) << np.uint64(b)
        blocks = np.array([code]).view(np.uint8)
        assert any(np.unpackbits(tables[b][blocks[b]])[k] for b in range(8))


def test_mixing_split():
    assert mixing.split(100, [Fraction(1), Fraction(1)], [10, 200]) == [10, 90]
    assert mixing.split(100, [Fraction(1), Fraction(2), Fraction(0)], [500, 500, 500]) == [33, 67, 0]
    assert mixing.split(100, [Fraction(1)], [30]) == [30] and mixing.split(5, [], []) == []
    tree = {"a": (1, {"x": (1, {"s": 1, "t": 1}), "y": (1, {"u": 1})}), "b": (1, {"x": (1, {"v": 1})})}
    got_ = mixing.allocate(tree, {("a", "x", "s"): 5, ("a", "x", "t"): 100, ("a", "y", "u"): 100, ("b", "x", "v"): 100}, 80)
    assert got_ == {("a", "x", "s"): 5, ("a", "x", "t"): 15, ("a", "y", "u"): 20, ("b", "x", "v"): 40}


def spark_hash(*values):
    """Spark's xxhash64 of (width, value) columns, one seeding the next."""
    h = 42
    for width, v in values:
        h = xxhash.xxh64_intdigest(v.encode() if width == "s" else v.to_bytes(width, "little", signed=True), h)
    return h


def brute_budget(tree, supply, budget, path=()):
    """Shares by a common level: each child gets level x weight, at most its capacity; parts of a token to the largest rests."""
    leafs = lambda x, at: sum(leafs(y[1] if isinstance(y, tuple) else None, (*at, k)) for k, y in x.items()) if isinstance(x, dict) else supply.get(at, 0)
    kids = [(k, Fraction(str(x[0] if isinstance(x, tuple) else x)), leafs(x[1] if isinstance(x, tuple) else None, (*path, k)), x) for k, x in tree.items()]
    left, weight = Fraction(min(budget, sum(c for *_, c, _ in kids))), sum(w for _, w, _, _ in kids)
    level = None
    for _, w, c, _ in sorted(kids, key=lambda x: x[2] / x[1]):
        if left * w / weight < c:
            level = left / weight
            break
        left, weight = left - c, weight - w
    exact = [Fraction(c) if level is None else min(Fraction(c), level * w) for _, w, c, _ in kids]
    shares = [int(e) for e in exact]
    for i in sorted(range(len(kids)), key=lambda i: (shares[i] - exact[i], i))[: min(budget, sum(c for *_, c, _ in kids)) - sum(shares)]:
        shares[i] += 1
    out = {}
    for (k, _, _, x), n in zip(kids, shares, strict=True):
        out |= brute_budget(x[1], supply, n, (*path, k)) if isinstance(x, tuple) else {(*path, k): n}
    return out


def brute_mixture(rows, plan):
    """(doc_id, source, tokens) with copies, by plain sorting of hashes worked out here."""
    leaves = {("d", x, s) for x, (_, ss) in plan.weights["d"][1].items() for s in ss}
    data = [(d, lang, source, len(words(t)), spark_hash(("s", t or "")), ("d", lang, source) if ("d", lang, source) in leaves else None) for d, t, lang, source, *_ in rows]
    have = Counter()
    for x in data:
        have[x[5]] += x[3]
    target = brute_budget(plan.weights, {k: have[k] * plan.max_epochs for k in leaves}, int(sum(x[3] for x in data) * plan.share))
    out = Counter()
    for leaf, goal in target.items():
        own = [x for x in data if x[5] == leaf]
        epochs = goal // have[leaf] if have[leaf] else 0
        sign = lambda n: n - (1 << 64) if n >> 63 else n
        own.sort(key=lambda x: (spark_hash((4, plan.seed), (8, epochs), (8, -1 if x[0] is None else x[0]), (8, sign(x[4]))), x[0] if x[0] is not None else -1))
        used = 0
        for x in own:
            used += x[3]
            out[x[0], x[2], x[3], epochs + (used <= goal - epochs * have[leaf])] += 1
    for x in data:
        if x[5] is None:
            out[x[0], x[2], x[3], 0] += 1
    return out


@pytest.mark.parametrize("share, epochs", [(Fraction(1, 2), 2), (Fraction(9, 10), 1), (Fraction(2), 3)])
def test_mixture(spark, docs, rows, empty, share, epochs):
    plan = mixing.Plan({"d": (1, {"en": (2, {"src0": 3, "src1": 1}), "fr": (1, {"src0": 1, "src7": 1})})}, "'d'", share, epochs)
    want = brute_mixture(rows, plan)
    out = mixing.mixture(docs, plan)
    assert Counter((r["doc_id"], r["source"], r["n_tokens"], r["copies"]) for r in out.collect()) == want
    odd = docs.withColumns({c: F.lit("mine") for c in ("_leaf", "_tokens", "_row", "_nth", "_h", "_text_code", "_domain", "_copies")})
    mixed = mixing.mixed(odd, plan)
    got_ = mixed.select("doc_id", "source", "_leaf", "_row", "_copies").collect()
    assert mixed.columns == odd.columns and len(got_) == sum(k[3] * n for k, n in want.items()) and all(tuple(x)[2:] == ("mine",) * 3 for x in got_)
    assert Counter((x["doc_id"], x["source"]) for x in got_) == sum((Counter({(k[0], k[1]): k[3] * n}) for k, n in want.items()), Counter())
    assert mixing.mixture(empty, plan).count() == mixing.mixed(empty, plan).count() == 0


def test_mixture_of_one_hot_leaf(spark):
    """A leaf of many rows, most of them copies of one: every place of the prefix's end."""
    rows = [(i % 40 if i % 3 else 7, "a b c" if i % 3 else "one same text", "en", "src0") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for share in (Fraction(1, 7), Fraction(1, 2), Fraction(99, 100)):
        plan = mixing.Plan({"d": (1, {"en": (1, {"src0": 1})})}, "'d'", share, 1)
        taken = sum(r["copies"] * r["n_tokens"] for r in mixing.mixture(df, plan).collect())
        assert taken == int(1800 * share) // 3 * 3
        assert mixing.mixed(df, plan).count() == taken // 3


CHAT = ("conv_id", "part", "perspective", "n_turns", "n_masked", "start", "rendered", "mask")


def test_chat(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    assert got(queries.op7_chat(spark, sf), *CHAT) == sorted(con.sql(f"select {', '.join(CHAT)} from ({chat.SQL})").fetchall(), key=str)


def test_chat_cases(spark):
    odd = [(1, 0, "ann", "hi <|im_end|>"), (1, 1, "bob b", None), (1, 1, "bob b", None), (1, None, None, "é"), (1, 600, "bob_b", "late"), (None, 0, "x", "y"), (2, 0, "system", "s"), (3, 0, "p", "long " * 20000), (3, 0, "", "no name")]
    df = spark.createDataFrame([(*x, "extra") for x in odd], "conv_id long, turn long, role string, text string, part string")
    out = {(r["conv_id"], r["part"], r["perspective"]): r for r in chat.rotated(df).collect()}
    assert set(out) == {(1, 0, w) for w in ("ann", "bob b", "bob_b", "unknown")} | {(None, 0, "x"), (3, 0, "p"), (3, 0, "")}
    r = out[1, 0, "ann"]
    assert r["rendered"] == (
        "<|im_start|>user name=unknown\né<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n"
        "<|im_start|>user name=bob_20_b\n<|im_end|>\n<|im_start|>user name=bob_5F_b\nlate<|im_end|>\n"
    )
    a, b = map(int, r["mask"].split(":"))
    assert r["rendered"][a:b] == "hi < |im_end|><|im_end|>" and r["start"] == 0
    assert out[3, 0, ""]["rendered"].count("long ") == 20000
    assert chat.rotated(df.limit(0)).count() == 0


@pytest.mark.parametrize("part_turns", [1, 3, 256])
def test_chat_parts_make_up_the_whole(spark, part_turns):
    """Long conversations, null turn numbers and many rows of one number: the rows put together are the whole rendering."""
    r = random.Random(4)
    rows = [(c, t, r.choice(["a", "b", "system", None]), "".join(r.choice("xyé<| ") for _ in range(r.randint(0, 12)))) for c in (1, 2, None) for t in [None] * 9 + [5] * 12 + list(range(8))]
    rows += rows[:5]
    out = chat.rotated(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), part_turns).collect()
    for c in (1, 2, None):
        turns = sorted({(-(2**63) if t is None else t, w or "unknown", x) for d, t, w, x in rows if d == c}, key=lambda x: (x[0], x[1], x[2].encode()))
        for me in {w for _, w, _ in turns} - {"system"}:
            text, mask = "", []
            for _, w, x in turns:
                text += "<|im_start|>" + ("assistant" if w == me else "system" if w == "system" else f"user name={w}") + "\n"
                if w == me:
                    mask.append(f"{len(text)}:{len(text + x.replace('<|', '< |') + '<|im_end|>')}")
                text += x.replace("<|", "< |") + "<|im_end|>\n"
            own = sorted((p for p in out if (p["conv_id"], p["perspective"]) == (c, me)), key=lambda p: p["part"])
            assert "".join(p["rendered"] for p in own) == text and ",".join(p["mask"] for p in own if p["mask"]) == ",".join(mask)
            assert all(text[p["start"] :].startswith(p["rendered"]) and p["n_turns"] <= part_turns for p in own) and sum(p["n_turns"] for p in own) == len(turns)


PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(s[::-1])) % 10 == 0
    fine = (lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")), lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s)), lambda s: 8 <= len(digits(s)) <= 15)
    return [(k, *m.span()) for k in range(4) for m in PATTERNS[k].finditer(text) if fine[k](m[0])]


def test_long_runs_of_digits_are_no_crash():
    """Leading zeros beyond what Python reads as a number, and as many digits."""
    text = "x " + "0" * 5000 + "1.2.3.4 y " + "9" * 5000 + ".1.1.1 z " + "0" * 5000 + ".0.0.0"
    assert [(k, text[a:b]) for k, a, b in pii.base_spans(text) if k == 1] == [(1, "0" * 5000 + "1.2.3.4"), (1, "0" * 5000 + ".0.0.0")]
    short = re.sub("(.)\\1{4999}", lambda m: m[1] * 4000, text)
    assert pii.base_spans(short) == brute_spans(short)


def test_base_spans_against_the_patterns():
    r = random.Random(8)
    for _ in range(6000):
        text = "".join(r.choice("a1@.+-( )%2569é") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(text) == brute_spans(text), text
    cards = "4041894974608795 4041-8949-7460-8795 4041894974608794 00000.1.2.3 1.2.3.4.5.6.7.8"
    assert pii.base_spans(cards) == brute_spans(cards)


def test_personal_data(spark, docs, empty):
    texts = ["call +1 (724) 555-7058 now, again 555-7058. pay 4041894974608795, later 4041.8949.7460.8795", "version 2.0. of 1999", None, "", "a@b.co a@b.co"] * 4
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.personal_data(df).collect()}
    for i, t in enumerate(texts):
        base = brute_spans(t or "")
        listing = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base)
        assert out[i]["base_sha256"] == hashlib.sha256(listing.encode()).hexdigest()
        assert [out[i][f"n_{k}"] for k in pii.KINDS[:4]] == [sum(x[0] == k for x in base) for k in range(4)]
        assert out[i]["n_spans"] == out[i]["n_added"] + len(base)
        assert set(listing.split(",")) <= set(out[i]["spans"].split(",")) and out[i]["n_added"] == len([x for x in out[i]["spans"].split(",") if x]) - len(base)
    assert out[1]["spans"] == "" and out[2]["spans"] == ""
    assert pii.personal_data(docs).count() == docs.count() and pii.personal_data(empty).count() == 0


def test_field_carries_labels_along_skip_links():
    train = [pii.nodes_of(t, pii.base_spans(t)) for t in ["card 4041894974608795 ok", "in 1999 and 2.0.", "ip 10.2.3.44", "mail a1@b.co", "+1 (724) 555-7058"] * 8]
    field = pii.train(train)
    text = "pay 4041894974608795 then 4041.8949.7460.8795, year 1999"
    assert [(pii.KINDS[k], text[s:e]) for k, s, e in pii.added_spans(text, pii.base_spans(text), field)] == [("card", "4041.8949.7460.8795")]
    alone = "only 4041.8949.7460.8795 here"
    assert pii.added_spans(alone, pii.base_spans(alone), field) == []


def test_field_finds_spans_unaided():
    """Mentions in forms that no pattern matches, in texts without a base span; numbers of other kinds stay clean."""
    r = random.Random(6)

    def card():
        d = "4" + "".join(r.choice("0123456789") for _ in range(14))
        return next(d + c for c in "0123456789" if pii.luhn(d + c))

    make = (lambda: f"{r.choice('abc')}{r.randint(10, 99)}@mail.org", lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)), card, lambda: f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}")
    plain = lambda: r.choice(["in 1999", "version 2.0.", str(r.randint(10**15, 10**16)) + "0", "1,200 of 3.14", "2024-05-06"])
    secret = lambda: 'token = "%s"' % "".join(r.choice("0123456789abcdef") for _ in range(40))
    texts = [f"so {r.choice(make)()} and {plain()} or {secret() if r.random() < 0.3 else plain()} end" for _ in range(300)]
    field = pii.train([n for t in texts for n in pii.lessons(t, 1)])
    for _ in range(30):
        c = card()
        dotted = ".".join(c[i : i + 4] for i in (0, 4, 8, 12))
        for text, want in ((f"so {dotted} end", (2, dotted)), ("so (724) 555-7058 end", (3, "(724) 555-7058")), (f"so {(s := secret())} end", (4, s[9:-1]))):
            assert pii.base_spans(text) == [] and [(k, text[a:b]) for k, a, b in pii.added_spans(text, [], field)] == [want]
        text = f"so {plain()} and {plain()}"
        assert pii.added_spans(text, pii.base_spans(text), field) == []


def test_training_mentions_written_anew():
    r, text = random.Random(3), 'é a1@b.co, 10.2.3.44 or 4041894974608795 then +1 (724) 555-7058 token = "0123456789abcdef01"!'
    spans = pii.spans_to_learn(text)
    assert [k for k, *_ in spans] == [0, 1, 2, 3, 4]
    for _ in range(50):
        other, labels = pii.written_anew(text, spans, r)
        assert {k for k, *_ in labels} == {0, 1, 2, 3, 4} and [other[a:b] for k, a, b in labels if k == 4][0] == "0123456789abcdef01"
        assert not [x for x in pii.base_spans(other) if x[0] in (2, 3)]
    assert [len(n.spans) for n in pii.lessons("no mention of 5", 1)] == [1] and pii.lessons("", 1)[0].spans == []


def test_messages_are_exact_on_trees():
    """Neighbour and skip links without a circle: as summing over all labellings."""
    from itertools import product

    r = np.random.default_rng(5)
    for chain, links, sure in (([(0, 1), (1, 2)], [(0, 3)], {0: 2}), ([(1, 2)], [(0, 1), (3, 4)], {0: 1, 3: 4}), ([], [(0, 1), (1, 2), (2, 3)], {0: 5})):
        field, n = pii.Field(r.normal(size=(6, pii.FEATURES)), r.normal(size=(6, 6)), (lambda a: a + a.T)(r.normal(size=(6, 6)))), 5
        x, labels = r.normal(size=(n, pii.FEATURES)).astype(np.float32), np.array([sure.get(i, 0) for i in range(n)])
        pairs = lambda p: np.array(p, dtype=np.int64).reshape(-1, 2)
        nodes = pii.Nodes([(i, i + 1) for i in range(n)], x, labels, pairs(chain), pairs([]), pairs(links))
        want = np.zeros((n, 6))
        for y in product(range(6), repeat=n):
            if all(y[i] == k for i, k in sure.items()):
                score = sum(float(x[i] @ field.emit[y[i]]) for i in range(n) if i not in sure)
                score += sum(field.chain[y[a], y[b]] for a, b in chain) + sum(field.skip[y[a], y[b]] for a, b in links)
                want[range(n), y] += np.exp(score)
        assert np.allclose(field.marginals(nodes), want / want.sum(axis=1, keepdims=True), atol=1e-4)


@pytest.mark.parametrize("base, again, kind", [("+1 (017) 555-7713", "555-7713", 3), ("4041894974608795", "4041.8949.7460.8795", 2)])
def test_field_reaches_all_repeats(base, again, kind):
    """Fifty repeats, with no emission preference: each has the one link's marginal."""
    field = pii.Field(np.zeros((5, pii.FEATURES)), np.zeros((5, 5)), 6 * np.eye(5))
    for n in (1, 2, 50):
        text = f"call {base} now " + " or then ".join([again] * n) + f", then {base} in 1999 " + " and ".join([again] * n)
        spans = pii.base_spans(text)
        nodes = pii.nodes_of(text, spans)
        found = field.marginals(nodes)[[i for i, (s, e) in enumerate(nodes.spans) if not nodes.labels[i] and text[s:e].strip(",") == again]]
        assert len(found) == 2 * n and np.allclose(found[:, kind + 1], np.exp(6) / (np.exp(6) + 4), atol=1e-4)
        assert [(k, text[s:e]) for k, s, e in pii.added_spans(text, spans, field)] == [(kind, again)] * (2 * n)


def test_links_are_to_the_nearest_surest_mention():
    keys = [{"a"}, {"a"}, {"a", "b"}, {"a"}, {"a"}, {"b"}, {"b"}, {"c"}, {"c"}, set()]
    labels = np.array([1, 0, 0, 0, 1, 0, 0, 0, 0, 0])
    assert pii.nearest_links(keys, labels) == {(0, 1), (0, 2), (4, 3), (2, 5), (2, 6)}
    assert pii.nearest_links(keys, labels * 0) == set() == pii.nearest_links([], labels[:0])


def test_repeats_do_not_outvote_an_open_mention():
    emit = np.zeros((5, pii.FEATURES))
    emit[4, 0] = 2  # all tokens look like phones
    field = pii.Field(emit, np.zeros((5, 5)), 6 * np.eye(5))
    found = []
    for n in (1, 50):
        text = "mail bob1@x.org then bob1@5557713 or " + " or then ".join(["1-555-7713"] * n)
        nodes = pii.nodes_of(text, pii.base_spans(text))
        m = field.marginals(nodes)
        assert len(m) == n + 2 and (m[1:].argmax(axis=1) == 1).all()
        found.append(m[1])
    assert np.allclose(*found, atol=0.02)


def test_messages_run_until_they_are_still():
    """Along a chain of neighbours: as exact as summing over all labellings forwards and backwards."""
    r = np.random.default_rng(3)
    field = pii.Field(r.normal(size=(5, pii.FEATURES)) * 0.05, 5 * np.eye(5), 4 * np.eye(5))
    text = "x 10.2.3.44 " + " ".join(f"k{i}" for i in range(60))
    nodes = pii.nodes_of(text, pii.base_spans(text))
    own = nodes.x @ field.emit.T
    own[0] = np.where(np.arange(5) == nodes.labels[0], 0, -1e9)
    own, pot, n = np.exp(own), np.exp(field.chain), len(own)
    ahead, back = own.copy(), np.ones_like(own)
    for i in range(1, n):
        ahead[i] *= (ahead[i - 1] / ahead[i - 1].sum()) @ pot
    for i in range(n - 2, -1, -1):
        back[i] = pot @ (own[i + 1] * back[i + 1] / back[i + 1].sum())
    want = ahead * back
    assert len(nodes.chain) == 60 and np.allclose(field.marginals(nodes), want / want.sum(axis=1, keepdims=True), atol=1e-4)


def test_pipeline_stages_on_odd_rows(spark, rows, sf):
    """Nulls, repeated rows, columns of clashing names and an empty table, in every stage."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, _rated string, _judged string, _leaf string, code long, fp long, row string, _id int"
    odd = spark.createDataFrame([(d, t, lang, source, 1, "r", "j", "l", 1, 2, "x", 3) for d, t, lang, source, *_ in rows] + [(5, "again", None, None, None, None, None, None, None, None, None, None)] * 2, schema)
    odd.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/odd_rows")
    odd = spark.read.parquet(path)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out, none = stage(spark, odd, sf), stage(spark, odd.limit(0), sf)
        assert none.count() == 0, name
        if k < 4:
            assert out.columns == none.columns == odd.columns, name
            left = Counter(map(str, out.collect()))
            whole = Counter(map(str, odd.collect()))
            assert set(left) <= set(whole) and (k == 3 or left <= whole), name
            if k == 1:
                assert left == Counter(dict.fromkeys(left, 1))
                classes = {x["fingerprint"] for x in simhash.near_duplicates(odd).collect()}
                assert sum(left.values()) <= len(classes)
            if k == 2:
                dirty = {x["doc_id"] for x in decontaminate.contaminated(odd, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
                assert sum(left.values()) == sum(x["doc_id"] not in dirty or x["doc_id"] is None for x in odd.collect())
        else:
            assert sorted((x["doc_id"] is not None, x["doc_id"] or 0) for x in out.collect()) == sorted((d["doc_id"] is not None, d["doc_id"] or 0) for d in odd.collect())


def test_pipeline_quality_and_mixture_against_brute_force(spark, sf):
    """What the classifier and the mixture decide is what the stages do."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = set()
    for d in docs.collect():
        found = [b for w in words(d["text"]) for b in plain_features(w, model.settings)]
        if model.bias + sum(model.margins[b] for b in found) / (len(found) + model.settings.smooth) >= 0:
            want.add(d["doc_id"])
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, docs, sf).collect()} == want
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixture(docs, mixing.production_plan()).collect()}
    assert Counter(r["doc_id"] for r in corpus_pipeline.STAGES[3][1](spark, docs, sf).collect()) == Counter({d: n for d, n in copies.items() if n})


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    prior = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, prior, sf)
        out.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/pipe{k}")
        out = spark.read.parquet(path)
        if k < 4:
            assert out.columns == docs.columns
        kept = [r["doc_id"] for r in out.select("doc_id").collect()]
        before = {r["doc_id"]: r["text"] for r in prior.select("doc_id", "text").collect()}
        assert set(kept) <= set(before)
        if k == 1:  # one document of each group, as brute force groups them
            prints = {d: brute_fingerprint(t) for d, t in before.items()}
            group = {d: d for d in before}
            changed = True
            while changed:
                changed = False
                for a in before:
                    for b in before:
                        if (prints[a] ^ prints[b]).bit_count() <= 2 and group[a] > group[b]:
                            group[a], changed = group[b], True
            assert sorted(kept) == sorted(d for d in group if group[d] == d)
        if k == 2:
            items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert not [d for d in kept if any(i in before[d] for i in items)]
            assert len(kept) >= 0.9 * len(before)
        prior = out
    assert got(corpus_pipeline.run(spark, sf), "start", "doc_id", "n_tokens", "ids_crc32") == got(prior, "start", "doc_id", "n_tokens", "ids_crc32")
