"""MinHash groups, Merkle manifest and vector codes against brute force, on small tables with odd rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from panelwright.llm import merkle_manifest as M
from panelwright.llm import minhash_dedup as N
from panelwright.llm import vector_codes as V

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, node string, leaf string, tree string, rank long, set string, bands string"


def documents(spark, rows):
    """(doc_id, text, lang): other columns clash with names that the operators use inside."""
    return spark.createDataFrame([(i, t, lang, None if i is None else f"s{i % 3}", None if t is None else len(t), 1, "n", "l", "t", 0, "s", "b") for i, t, lang in rows], DOCS).repartition(3)


# ---- MinHash ----


def sets_of(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if w else frozenset()


def brute_components(rows):
    sets = [sets_of(t) for _, t, _ in rows]
    distinct = sorted({s for s in sets if s}, key=sorted)
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x in range(len(distinct)):
        for y in range(x):
            both = len(distinct[x] & distinct[y])
            if 100 * both >= 85 * (len(distinct[x]) + len(distinct[y]) - both):
                root[find(x)] = find(y)
    place = {s: find(k) for k, s in enumerate(distinct)}
    least = collections.defaultdict(lambda: None)
    for (i, _, _), s in zip(rows, sets):
        if s and i is not None:
            r = place[s]
            least[r] = i if least[r] is None else min(least[r], i)
    out = collections.Counter()
    for (i, _, _), s in zip(rows, sets):
        c = least[place[s]] if s else i
        out[i, len(s), c, i == c] += 1
    return out


@pytest.fixture(scope="module")
def family():
    """Copies of a few texts with up to 15 edits each, so that many lie just inside or outside of a link; odd rows besides."""
    rng = random.Random(5)
    word = lambda: rng.choice(["ax", "by", "cu", "do", "el"]) + str(rng.randrange(30))
    rows = []
    for base in range(3):
        text = [word() for _ in range(150)]
        for _ in range(130):
            copy = list(text)
            for _ in range(rng.randrange(0, 15)):
                k = rng.randrange(len(copy))
                kind = rng.randrange(4)
                copy[k : k + 1] = [] if kind == 0 else [copy[k], word()] if kind == 1 else [word()]
            rows.append((" ".join(copy), "en"))
    rows += [(" ".join(word() for _ in range(80)), "fr") for _ in range(40)]
    rows += [(t, None) for t in (None, "", " \n\t", "one", "One", "two words", "a b c", "A b C", " ".join(word() for _ in range(20_000)))]
    rows += rows[:5]
    out = [(i, t, lang) for i, (t, lang) in enumerate(rows)]
    return out + [out[3], (None, rows[0][0], "en"), (None, "nothing like it here at all", "en"), (None, None, None), (7, "another text under an id that is taken", "en")]


def test_groups_equal_brute_force(spark, family):
    got = N.op11(documents(spark, family)).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == brute_components(family)
    assert N.op11(documents(spark, [])).count() == 0


def test_groups_of_a_bucket_that_goes_several_rounds(spark, family):
    """With one bucket for all texts every link has to be found through centres and remainders."""
    rows = [(i, t, lang) for i, t, lang in family if i is not None and len(sets_of(t)) > 5][:250]
    distinct = {s: k for k, s in enumerate(sorted({sets_of(t) for _, t, _ in rows}, key=sorted))}
    text = {distinct[sets_of(t)]: t for _, t, _ in rows}
    buckets = spark.createDataFrame([(1, k, len(s)) for s, k in distinct.items()], "key long, node long, n long")
    texts = spark.createDataFrame(list(text.items()), "node long, text string")
    links = [(r["a"], r["b"]) for r in N.text_links(buckets, texts, rest=8).collect()]
    names = {k: s for s, k in distinct.items()}
    assert all(100 * len(names[a] & names[b]) >= 85 * len(names[a] | names[b]) for a, b in links)
    want = brute_components([(k, t, "") for k, t in text.items()])
    root = dict(zip(text, text))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert {k: find(k) for k in text} == {i: c for i, _, c, _ in want}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for share in (0.5, 0.85, 0.95):
        for size in (20, 90, 400):
            for _ in range(20):
                both = rng.integers(1, 1 << 62, int(size * share)).astype(np.uint64)
                rest = lambda: rng.integers(1, 1 << 62, size - int(size * share)).astype(np.uint64)
                a, b = np.unique(np.r_[both, rest()]), np.unique(np.r_[both, rest()])
                truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
                errors.append((N.signature(a) == N.signature(b)).mean() - truth)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.12
    assert len(set(N.signature(np.array([5], np.uint64)).tolist())) == 1  # one shingle fills all bins


# ---- Merkle ----


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    i, _, lang = row
    values = [i, None if i is None else f"s{i % 3}", lang, None if row[1] is None else len(row[1]), text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def brute_manifest(rows):
    by = collections.defaultdict(list)
    for row in rows:
        by[row[2]].append((row[0] is not None, row[0] or 0, leaf_of(row, row[1]), row))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: levels_of([x[2] for x in sorted(by[lang], key=lambda x: x[:3])]) for lang in langs}
    upper = levels_of([trees[lang][-1][0] for lang in langs])
    out = collections.Counter()
    for at, lang in enumerate(langs):
        for k, (_, _, leaf, row) in enumerate(sorted(by[lang], key=lambda x: x[:3])):
            text = row[1]
            if text is not None and zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % 3 == 0:
                text = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            proof, folded = "", leaf_of(row, text)
            for levels, place in ((trees[lang], k), (upper, at)):
                for level in levels[:-1]:
                    run = level[place // 8 * 8 : place // 8 * 8 + 8]
                    proof += "".join(run[: place % 8] + run[place % 8 + 1 :])
                    folded = h(*run[: place % 8], folded, *run[place % 8 + 1 :])
                    place //= 8
            out[row[0], leaf, trees[lang][-1][0], upper[-1][0], h(proof), folded, folded == upper[-1][0]] += 1
    return out


def test_manifest_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "", "Über A", "plain", "MIT License " * rng.randrange(5)]), rng.choice(["en"] * 8 + ["de", None, "", "é", "-"])) for i in rng.sample(range(5000), 1300)]
    rows += [(10_000 + k, "x", f"lang {k}") for k in range(70)] + rows[:3] + [(rows[0][0], "another text", rows[0][2]), (None, "No id", "en"), (None, None, None), (None, "No id", "en"), (-5, "X" * 300_000, "en")]
    got = M.op12(documents(spark, rows)).collect()
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert collections.Counter(tuple(r[c] for c in columns) for r in got) == brute_manifest(rows)
    assert {r["verified"] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 513])
def test_manifests_of_few_rows(spark, n):
    rows = [(i, f"T{i}", "en") for i in range(n)]
    got = M.op12(documents(spark, rows)).collect()
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert collections.Counter(tuple(r[c] for c in columns) for r in got) == brute_manifest(rows)


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_addresses_fill_their_block(levels):
    places = np.concatenate([M.veb_address(d, np.arange(8**d), levels) for d in range(levels)])
    assert sorted(places.tolist()) == list(range(M.veb_size(levels)))
    assert M.veb_address(0, np.array([0]), levels)[0] == 0
    if levels == 4:  # a subtree of half the height stands in one piece
        piece = [int(M.veb_address(2, np.array([9]), 4)[0]), *M.veb_address(3, np.arange(72, 80), 4).tolist()]
        assert piece == list(range(piece[0], piece[0] + 9))


# ---- vector codes ----

VECTORS = "vec_id long, embedding array<double>, label int, q string, code string, salt long, error string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, "q", "c", 1, "e") for i, v, y in rows], VECTORS).repartition(3)


def brute_codes(rows):
    kept = [(i, np.floor(np.array(v) * 4096).astype(np.int64).reshape(8, -1), y) for i, v, y in rows if v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.ascontiguousarray(r[1].astype("<i4")).tobytes()))
    books = [np.array([r[1][p] for r in kept[:16]]) for p in range(8)]

    def near(p):
        far = np.array([[((r[1][p] - e) ** 2).sum() for e in books[p]] for r in kept])
        return far.argmin(axis=1), far.min(axis=1)

    for _ in range(6):
        for p in range(8):
            at, _ = near(p)
            for e in range(len(books[p])):
                mine = [r[1][p] for r, a in zip(kept, at) if a == e]
                if mine:
                    books[p][e] = np.sum(mine, axis=0) // len(mine)
    found = [near(p) for p in range(8)]
    errors = sum(d for _, d in found)
    by = collections.Counter()
    for r, e in zip(kept, errors):
        by[r[2]] += int(e)
    name = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    return collections.Counter((r[0], "".join(f"{found[p][0][k]:02x}" for p in range(8)), int(errors[k]), by[r[2]], name) for k, r in enumerate(kept))


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(0, 0.3, 16).tolist(), int(rng.integers(0, 4)) if i % 5 else None) for i in range(300)]
    rows += [(1000 + k, rows[40][1], 2) for k in range(60)]  # copies of one vector
    rows += [(2000, None, 1), (2001, [0.5] * 15 + [None], 1), (2002, [float("nan")] * 16, 1), (2003, [float("inf")] + [0.0] * 15, 1), (2004, [0.1] * 8, 1), (2005, [], 1), (None, [0.25] * 16, None), rows[9]]
    got = V.op13(vectors(spark, rows)).collect()
    assert collections.Counter(map(tuple, got)) == brute_codes(rows)
    kept, size = V.usable(vectors(spark, rows))
    books = V.codebooks(kept, size)
    coded = V.encode(kept, size, books)
    back = {r["vec_id"]: r["vector"] for r in V.decode(coded, books).collect()}
    for r in coded.collect():  # a code's vector lies as far as its error says
        if r["vec_id"] is not None and r["vec_id"] not in (9,) and r["vec_id"] < 300:
            q = np.floor(np.array(rows[r["vec_id"]][1]) * 4096)
            assert ((q - np.array(back[r["vec_id"]]) * 4096) ** 2).sum() == r["error"]


def test_codes_of_few_rows(spark):
    for rows in ([], [(1, None, 1)], [(3, [0.5] * 16, None)], [(k, [k / 7] * 16, 0) for k in range(5)]):
        got = V.op13(vectors(spark, rows)).collect()
        want = brute_codes(rows) if any(v for _, v, _ in rows) else collections.Counter()
        assert collections.Counter(map(tuple, got)) == want


def test_cells_keep_the_nearest_entry():
    rng = np.random.default_rng(8)
    for width in (1, 7, 200, 5000):
        book = rng.integers(-900, 900, (16, 3))
        grid = V.Grid(book, width, {}, np.empty((0, 16), bool))
        parts = rng.integers(-1500, 1500, (500, 3))
        at, far = grid.nearest(parts)
        want = ((parts[:, None] - book[None]) ** 2).sum(2)
        assert (at == want.argmin(1)).all() and (far == want.min(1)).all()
        again, _ = grid.nearest(parts[:50])
        assert (again == at[:50]).all()


def test_label_totals_by_either_join(spark):
    coded = spark.createDataFrame([(k, None if k % 3 else k % 4, f"{k:02x}", k) for k in range(50)], "vec_id long, label int, code string, error long")
    some, many = (sorted(map(tuple, V.with_label_error(coded, n).select("vec_id", "label_error").collect())) for n in (100, 0))
    assert some == many and len(some) == 50


def test_a_benchmark_row_that_repeats_is_searched_once(spark):
    from panelwright.llm import decontamination

    item = "the quick brown fox jumps over the lazy dog and then sleeps"
    rows = [(i % 40, item) for i in range(400)] + [(None, item), (900, item.upper()), (901, "one two three four five six seven"), (902, None), (903, "")]
    benchmark = spark.createDataFrame(rows, "item_id long, text string")
    (index, texts), = decontamination.benchmark_slices(benchmark)
    assert len(texts) == 4 and len(index.items) == 2
    docs = spark.createDataFrame([(1, "so " + item + " well"), (2, "nothing here"), (None, item), (4, None)], "doc_id long, text string")
    got = decontamination.contaminations(docs, benchmark, any_length=True).collect()
    assert len(got) == 2 * 402 and {r.distance for r in got} == {0}
    assert sum(r.item_id is None for r in got) == 2 and sum(r.item_id == 7 for r in got) == 20 and {r.first_word for r in got if r.doc_id == 1} == {1}
    assert {r.doc_id for r in decontamination.drop_contaminated(docs, benchmark).collect()} == {2, 4}
