"""The filter audit, suffix-array deduplication and vector codes against plain versions."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from quillon.llm import audit, codes, suffixes

# --- the filter audit --------------------------------------------------------------------------------


def brute_audit(rows, labels):
    """All orders one after another over rows of (doc_id, text, source)."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = []
    for i, t, source in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": t in least and (i is None or i > least[t])}
        docs.append((source or "", {f for f in fails if fails[f]}, [q for x, q, _ in labels if x == i and i is not None], [q for x, _, q in labels if x == i and i is not None]))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone, stay = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(stay), len(gone), sum(f in d[1] for d in mine) - len(gone), sum(d[1] == {f} for d in mine), sum(1 in d[2] for d in gone), sum(1 in d[3] for d in gone)]
                left = stay
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_filter_audit(spark, odd):
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(i, t, "odd" if i else None) for i, t in odd]
    texts = [" ".join(r.choice(vocabulary[: r.choice([20, 300])]) for _ in range(r.choice([150, 200, 260]))) for _ in range(25)]
    for i in range(90):
        text = r.choice(texts)
        text = r.choice([text, text, text.upper(), text + " #", text[:400]])
        rows.append((100 + i, text, r.choice(["a", "b", None, ""])))
    rows += [(300, "", "only"), (301, texts[0], "only"), (301, texts[0], "only"), (None, texts[0], "b"), (None, "alone", "b"), (None, "alone", "b")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(100, 190)] + [(100, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 part", "'x' h", "2 first", "3 good", "'y' A", "4 state", "5 at", "6 s")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(x.part, x.filter_order, x.step): [x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley] for x in audit.audit(docs, marks).collect()}
    assert got == brute_audit(rows, labels)
    assert audit.audit(docs.limit(0), marks).count() == 0
    assert audit.audit(docs, marks.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


def test_trie_visits_each_state_once(spark):
    table = spark.createDataFrame([("p", True, False, True, False, False, True, False)], "part string, A boolean, B boolean, C boolean, D boolean, E boolean, good boolean, toxic boolean")
    counted = audit.execute(table)
    assert sorted(counted) == list(range(32))
    assert all(c.agg({"n": "sum"}).first()[0] in ((1,) if not s & audit.mask("AC") else (None,)) for s, c in counted.items())


# --- suffixes ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(12))
def test_collection_is_the_sorted_suffixes(seed):
    r = random.Random(seed)
    strings = [bytes(r.choice(b"ab" if seed % 2 else b"abcd") for _ in range(r.randrange(30))) for _ in range(r.randrange(1, 14))]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    c = suffixes.Collection(np.frombuffer(b"".join(strings), dtype=np.uint8), bounds)
    order = sorted((tuple(x + 1 for x in s[k:]) + (0, i), i, k) for i, s in enumerate(strings) for k in range(len(s) + 1))
    assert c.bwt.tolist() == [strings[i][k - 1] + 1 if k else 0 for _, i, k in order]
    common = lambda x, y: next((n for n, (p, q) in enumerate(zip(x[:-2], y[:-2])) if p != q), min(len(x), len(y)) - 2)
    assert c.lcp.tolist() == [0] + [common(a[0], b[0]) for a, b in zip(order, order[1:])]
    for length in (1, 3, 7):
        who, start, number = c.windows(length)
        found = {(int(w), int(s)): int(n) for w, s, n in zip(who, start, number)}
        assert set(found) == {(i, k) for i, s in enumerate(strings) for k in range(len(s) - length + 1)}
        text = {n: strings[i][k : k + length] for (i, k), n in found.items()}
        assert all(strings[i][k : k + length] == text[n] for (i, k), n in found.items()) and len(set(text.values())) == len(text)


def brute_suffixes(rows, length):
    """rows: (doc_id, text), in the order of documents; equal rows once."""
    seen, out = set(), {}
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            if data[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(data[s : s + length])
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.setdefault((i, text), (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept))
    return out


@pytest.mark.parametrize("length, gram, most", [(20, 9, 4096), (20, 9, 1), (12, 12, 4096), (100, 48, 4096)])
def test_suffix_dedup(spark, documents, odd, length, gram, most, monkeypatch):
    monkeypatch.setattr(suffixes, "COLLECTION", 16)
    r = random.Random(length + most)
    passages = ["".join(r.choice("abcdé \n") for _ in range(r.choice([15, 40, 150, 400]))) for _ in range(8)]
    rows = [(i, t) for i, t in odd if i is not None and i < 8] + [(11, "one " * 500), (12, "x" * 700), (13, "xy" * 300)]
    for i in range(60):
        parts = [r.choice(passages)[r.choice([0, 0, 3]) :] if r.random() < 0.6 else "".join(r.choice("abcdefgh ") for _ in range(30)) for _ in range(r.randrange(1, 6))]
        rows.append((100 + i, "".join(parts)))
    rows += [(200, passages[3]), (200, passages[3]), (201, passages[3])]
    want = brute_suffixes(sorted(set(rows), key=lambda x: x[0]), length)
    got = suffixes.deduplicate(documents(rows, extra=True), length, gram, most).collect()
    assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in got) == sorted((i, *want[i, t]) for i, t in rows)
    assert sum(x.n_removed for x in got) > 1000


def test_suffix_dedup_of_rows_without_ids(spark, documents, monkeypatch):
    monkeypatch.setattr("quillon.llm.suffixes.SLICE_BYTES", 256)  # long texts are scanned in pieces
    r = random.Random(5)
    text, other = ("".join(r.choice("abcdefghij") for _ in range(3000)) for _ in range(2))
    got = suffixes.deduplicate(documents([(None, text), (7, text[500:2500]), (None, other), (None, None), (9, other + text[:99])])).collect()
    assert sorted(((x.doc_id is None, x.doc_id or 0, x.n_bytes, x.n_removed, x.n_spans) for x in got)) == [(False, 7, 2000, 0, 0), (False, 9, 3099, 0, 0), (True, 0, 0, 0, 0), (True, 0, 3000, 2000, 1), (True, 0, 3000, 3000, 1)]
    assert suffixes.deduplicate(documents([])).count() == 0


# --- vector codes ------------------------------------------------------------------------------------


def brute_codes(rows, rounds=6, parts=8, entries=16):
    """Plain Lloyd rounds over (vec_id, embedding, label), in Python's integers."""
    kept = [(i, v, l) for i, v, l in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    k = width // parts
    kept = [(i, [int(np.floor(4096 * float(x))) for x in v] + [0] * (width - len(v)), l) for i, v, l in kept]
    first = sorted(kept, key=lambda x: (x[0] is None, x[0], x[1]))[:entries]
    books = [[v[p * k : (p + 1) * k] for _, v, _ in first] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(nearest(v[p * k : (p + 1) * k], books[p])[1], []).append(v[p * k : (p + 1) * k])
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else old for e, old in enumerate(books[p])]
    out, of_label = [], Counter()
    for i, v, l in kept:
        found = [nearest(v[p * k : (p + 1) * k], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), l))
        of_label[l] += sum(d for d, _ in found)
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return Counter((i, code, e, of_label[l], digest) for i, code, e, l in out)


@pytest.mark.parametrize("chunk, offsets", [(4096, 100_000), (40, 0)])
def test_vector_codes(spark, chunk, offsets, monkeypatch):
    monkeypatch.setattr(codes, "CHUNK", chunk)
    monkeypatch.setattr(codes, "OFFSET_ROWS", offsets)
    r = np.random.default_rng(chunk)
    rows = [(int(i), r.normal(size=24).round(1).astype(np.float32).tolist(), int(r.integers(4)) or None) for i in r.permutation(300)]
    rows += [(400 + i, rows[0][1], 2) for i in range(40)] + [(500, [0.25] * 17, 1), (500, [0.25] * 17, 1), (None, [0.5] * 24, 3), (None, [], 1), (501, None, 1), (502, [float("nan")] * 24, 1), (503, [float("inf")] * 24, 1), (504, [None] * 24, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 code", "'x' ids", "2 n", "3 part", "4 _l")
    got, _ = codes.compress(df)
    assert Counter((x.vec_id, x.code, x.error, x.label_error, x.codebooks_sha256) for x in got.collect()) == brute_codes(rows)


def test_vector_codes_few_empty_and_huge(spark):
    schema = "vec_id long, embedding array<double>, label int"
    few = [(3, [1.0, 2.0], 1), (1, [0.5, -0.25], None)]
    assert Counter(tuple(x[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for x in codes.compress(spark.createDataFrame(few, schema))[0].collect()) == brute_codes(few)
    assert codes.compress(spark.createDataFrame([], schema))[0].count() == 0
    assert codes.compress(spark.createDataFrame([(1, None, 1)], schema))[0].count() == 0
    huge = codes.compress(spark.createDataFrame([(i, [(-1.0) ** i * 1e300] * 64, 1) for i in range(40)], schema))[0].collect()
    assert len(huge) == 40 and all(0 <= x.error < 1 << 62 for x in huge)


@pytest.mark.parametrize("seed", range(6))
def test_elimination_keeps_nearest_entries(seed):
    r = np.random.default_rng(seed)
    points, book = r.integers(-6, 7, size=(500, 3)), r.integers(-6, 7, size=(16, 3))
    tree = codes.Tree(points)
    code, error = codes.nearest(tree, book)
    distance = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    assert (code == distance.argmin(axis=1)).all() and (error == distance.min(axis=1)).all()
    sums, counts = codes.totals(tree, book)
    assert (counts == np.bincount(code, minlength=16)).all() and (sums == np.array([points[code == e].sum(axis=0) for e in range(16)])).all()
    whole = sum(int((end - first).sum()) for kind, _, first, end, _ in codes.descend(tree, 20 * book) if kind == "nodes")
    assert whole > 100  # far entries leave whole subtrees to one
