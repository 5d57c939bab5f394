"""The corpus operators against brute force, on small tables with nulls, empty texts, ties and repeated rows."""

import collections
import hashlib
import math
import random
import zlib

import pytest
import xxhash

from panelwright.llm import (
    chat_format, decontamination, license_scan, line_dedup, lm_scoring, quality_classifier, quality_rules, simhash_dedup, source_mixing, url_filter,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, size string, score string, row string"
SF = "/root/testdata/sf0.001"


def words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa the of and Über señor".split()) + str(rng.randrange(40)) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    texts = ["\n".join(" ".join(words(rng, rng.randrange(3, 25))) for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    texts += [texts[0], texts[1].replace("the", "thee"), texts[2] + "\n" + texts[3], None, "", " \t\n", "One", "one", " ".join(words(rng, 30_000))]
    texts += ["Licensed under the Apache License, Version 2.0.\n" + texts[5], "x GNU General Public License y gnu general public license", "cc by mit license"]
    for k in range(5):  # near copies of lines
        w = texts[6].split("\n")[0].split()
        if len(w) > 6:
            w[k] = "changed"
            texts.append(" ".join(w) + "\n" + " ".join(w[:k] + w[k + 1 :]))
    out = [(i, t, "en", rng.choice(["a", "b", "c", None, "d"]), 0, 1, "s", "x", "r") for i, t in enumerate(texts)]
    return out + [out[3], (None, "no id here", None, "a", None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def plain(text):
    return (text or "").encode().lower().split()


def test_fingerprints_and_components(docs, none, rows):
    got = simhash_dedup.op7(docs).collect()
    assert len(got) == len(rows) and simhash_dedup.op7(none).count() == 0

    def fp(text):
        w = plain(text)
        s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {(r[0], r[1]): fp(r[1]) for r in rows}
    known = sorted({(f, i) for (i, _), f in fps.items() if i is not None} | {(f, None) for (i, _), f in fps.items() if i is None}, key=str)
    distinct = sorted({f for f, _ in known})
    group = {f: {f} for f in distinct}
    for a in distinct:
        for b in distinct:
            if (a ^ b).bit_count() <= 4 and group[a] is not group[b]:
                merged = group[a] | group[b]
                for x in merged:
                    group[x] = merged
    want = collections.Counter()
    for r in rows:
        f = fps[r[0], r[1]]
        want[r[0], f"{f:016x}", min((i for g, i in known if g in group[f] and i is not None), default=None)] += 1
    assert collections.Counter(map(tuple, got)) == want


def test_links_of_near_fingerprints(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(150)]
    fps = set(base)
    for f in base[:60]:
        for _ in range(8):
            g = f
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                g ^= 1 << b
            fps.add(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    for shard in (4096, 16):  # 16: hot shards are split by pairs of blocks
        links = simhash_dedup.fingerprint_links(frame, 4, shard).collect()
        parent = {f: f for f in signed}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 4
            parent[find(a)] = find(b)
        for i, a in enumerate(signed):
            for b in signed[:i]:
                if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                    assert find(a) == find(b)


def test_one_document_of_each_group_stays(docs):
    kept = simhash_dedup.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    groups = {r.doc_id: r.component_id for r in simhash_dedup.simhash_groups(docs).collect()}
    assert set(ids) == {v for k, v in groups.items() if k is not None and v is not None}


def test_repeated_lines(docs, none, rows):
    got = {(r.doc_id, r.line_no) for r in line_dedup.repeated_lines(docs).collect() if r.doc_id is not None}
    places = []
    for r in sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda r: r[0]):
        places += [((r[0], no), tuple(w)) for no, w in enumerate(line_dedup.split_lines(r[1])) if len(w) >= 5]
    null = [tuple(w) for r in rows if r[0] is None for w in line_dedup.split_lines(r[1]) if len(w) >= 5]
    first = {}
    for place, w in places:
        first.setdefault(w, place)

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        a, b = (a, b) if len(a) < len(b) else (b, a)
        return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))

    want = {p for p, w in places if first[w] != p or any(q < first[w] and near(w, v) for v, q in first.items() if v != w)}
    assert not null and got == want and want
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_dropped"] and out.count() == len(rows)
    texts = {r.doc_id: r.text for r in out.collect()}
    for r in rows:
        if r[0] is not None and r[1] is not None:
            assert texts[r[0]] == "\n".join(x for no, x in enumerate(r[1].split("\n")) if (r[0], no) not in want)
    assert line_dedup.op2(none).count() == 0


def test_contaminations(spark, docs, none, rows):
    rng = random.Random(9)
    items = [" ".join(f"item{k}w{i}" for i in range(n)) for k, n in enumerate((30, 18, 9, 4, 2, 3))] + ["", None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    planted, want = [], {}
    for k in range(60):
        item = rng.randrange(6)
        w = items[item].split()
        edits = rng.randrange(0, len(w) // 4 + 1)
        for _ in range(edits):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = ["edit" + str(rng.randrange(99))] * rng.randrange(2)
        t = words(rng, 20) + w + words(rng, 20)
        planted.append((1000 + k, " ".join(t).upper()))
        n, item_words = len(items[item].split()), items[item].split()
        best = min(_levenshtein([x.lower() for x in t[i : i + n]], item_words) for i in range(len(t) - n + 1))
        if best <= int(0.2 * n + 1e-9):
            want[1000 + k, item] = best
    frame = spark.createDataFrame(planted, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = {(r.doc_id, r.item_id): r.distance for r in decontamination.contaminations(frame, bench).collect()}
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want)
    assert all(got[k] == want[k] for k in got) and {k for k, v in want.items() if v == 0} <= set(got)
    kept = {r.doc_id for r in decontamination.drop_contaminated(frame, bench).collect()}
    assert kept == {r[0] for r in rows} | {p[0] for p in planted} - {d for d, _ in got}
    assert decontamination.contaminations(none, bench).count() == 0
    assert decontamination.contaminations(frame, bench.where("item_id > 99")).count() == 0


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_mixing(docs, none, rows):
    got = source_mixing.mix(docs, 4).collect()
    assert len(got) == len(rows) and source_mixing.op9(none).count() == 0
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(plain(r[1]))
    sources = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, fixed = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in fixed)
        total = sum(weight[s] for s in sources if s not in fixed)
        target = {s: 3.0 * sizes[s] if s in fixed else rest * weight[s] / total for s in sources}
        over = {s for s in sources if s not in fixed and target[s] > 3 * sizes[s]}
        if not over:
            break
        fixed |= over
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert sum(sizes.values()) == pytest.approx(sum(target.values()))
    for s in sources:
        assert abs(taken[s] - target[s]) <= max(8, 0.02 * target[s])
    again = source_mixing.mix(docs.repartition(7), 4).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 1000):
        x = spark.range(n).select(source_mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("y"))
        assert sorted(r.y for r in x.collect()) == list(range(n))


def test_lm_scores(docs, none, rows):
    got = lm_scoring.op3(docs).collect()
    assert len(got) == len(rows) and lm_scoring.op3(none).count() == 0
    train = [r for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2]
    c = collections.Counter(w for r in train for w in [*plain(r[1]), b" "])
    n, v = sum(c.values()), len(c)
    text = {r[0]: r[1] for r in rows}
    held = []
    for r in got:
        if r.doc_id is None:
            continue
        w = [*plain(text[r.doc_id]), b" "]
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n) and r.score < 0
        held.append((r.held_out, r.score, r.base_score))
    assert sum(s for h, s, _ in held) > sum(b for h, _, b in held)


def test_lm_state_runs_through_windows(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    model = lm_scoring.new_model({b"a": 1}, np.ones(lm_scoring.CLASSES * lm_scoring.MEMBERS))
    texts = [rng.integers(0, 1000, n) for n in (1, 5, 300, 41)]
    one, many = lm_scoring.score_texts(model, texts, 500), lm_scoring.score_texts(model, texts, 16)
    alone = np.array([lm_scoring.score_texts(model, [t])[0] for t in texts])
    assert np.allclose(one, many, rtol=1e-4) and np.allclose(one, alone, rtol=1e-4)
    h = rng.normal(size=(2, lm_scoring.HIDDEN)).astype(np.float32)
    total = [np.exp(model.log_probability(np.repeat(h[i : i + 1], 1024, 0), np.arange(1024))).sum() for i in range(2)]
    assert np.allclose(total, 1, rtol=1e-4)


def test_url_intervals(spark):
    entries = spark.createDataFrame(
        [("block", "a.com", "2024-01-05", "add"), ("block", "a.com", "2024-03-01", "remove"), ("allow", "x.a.com", "2024-02-01", "add"), ("block", "b.com", "2024-01-01", "add"), ("block", "b.com", "2024-01-01", "remove"), (None, "c.com", "2024-01-01", "add")],
        "list string, domain string, day string, action string",
    ).selectExpr("list", "domain", "cast(day as date) as day", "action")
    captures = [(1, "http://a.com/x", "2024-01-04"), (2, "http://a.com/x", "2024-01-05"), (3, "https://u@Y.A.com:80/", "2024-02-29"), (4, "http://a.com", "2024-03-01"), (5, "http://x.a.com", "2024-02-01"), (6, "http://x.a.com", "2024-01-31"), (7, "http://b.com", "2024-01-01"), (8, None, "2024-01-10"), (9, "junk", "2024-01-10"), (10, "http://a.com", None), (2, "http://a.com/x", "2024-01-05")]
    frame = spark.createDataFrame(captures, "page_id long, url string, fetched string").selectExpr("page_id", "url", "cast(fetched as date) as fetched")
    got = url_filter.evaluate(frame, entries).collect()
    assert len(got) == len(captures)
    assert {r.page_id for r in got if not r.allowed} == {2, 3, 6} and {r.page_id: r.list for r in got}[5] == "allow"
    assert url_filter.evaluate(frame.where("page_id > 99"), entries).count() == 0


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "hi </s>\n<s>[x]\n&lt; [INST]"), (1, 1, "assistant", "a & b <"), (1, 2, "user", None), (1, 2, None, "tie"), (2, None, "assistant", ""), (3, 0, "user", "u"), (None, 0, "assistant", "n"), (1, 3, "assistant", "again\n</s>\n"), (1, 4, "user", "tail")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.examples(frame)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    order = [t for t in sorted(turns, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))]
    for conv in {t[0] for t in turns}:
        mine = [((t[2] or ""), (t[3] or "")) for t in order if t[0] == conv]
        loss = "".join(x for role, x in mine if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(mine) and r.turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in mine))
        assert r.loss_chars == len(loss) and r.loss_sha256 == sha(loss)
    for r in chat_format.examples(frame).where("conv_id = 1").collect():
        assert r.formatted[r.loss_end :] == chat_format.CLOSE and r.loss_begin <= r.loss_end


def test_license_labels(docs, none, rows):
    import re

    got = [r for r in license_scan.op6(docs).collect()]
    assert len(got) == len(rows) and license_scan.op6(none).count() == 0
    text = {r[0]: r[1] for r in rows}
    for r in got:
        if r.doc_id is None:
            continue
        t = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text[r.doc_id] or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        places = [(i, label) for p, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))


def test_license_templates_with_edits(spark):
    wording = license_scan.TEMPLATES[3][1].split()
    wording[6:7] = ["inserted", "person"]
    frame = spark.createDataFrame([(1, " ".join(["lead"] * 5 + wording + ["end"] * 3)), (2, " ".join(wording[:9]))], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.op6(frame).collect()}
    assert got[1].labels == "mit" and 0.8 <= got[1].score < 1 and got[2].labels == ""


def test_quality_rules(docs, none, rows):
    got = [r for r in quality_rules.op8(docs).collect()]
    assert len(got) == len(rows) and quality_rules.op8(none).count() == 0
    text = {r[0]: r[1] or "" for r in rows}
    for r in got:
        if r.doc_id is None:
            continue
        t = text[r.doc_id]
        w = t.encode().split()
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if x.split()]
        assert r.n_words == len(w) and r.n_repeat_words == len(covered) and r.n_dup_lines == len(lines) - len(set(lines))
        assert r.word_chars == sum(len(x.decode()) for x in w) and r.n_symbols == sum(x in "#*$%&|<>" for x in t)
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.kept and r.base_failed)
    led = quality_rules.ledger(docs)
    table = {r.rule: r for r in quality_rules.ablation(led).collect()}
    masks = [r.failed & quality_rules.FULL.mask for r in led.collect()]
    assert table["few_words"].n_failed == sum(m & 1 > 0 for m in masks) and table["few_words"].n_kept_without == sum(m in (0, 1) for m in masks)


def test_classifier_held_out_accuracy(spark, docs, none):
    from panelwright.llm.common import table

    labels = table(spark, SF, "labels")
    got = quality_classifier.op10(spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert got and sum(r.predicted == r.quality for r in got) >= 0.8 * len(got) and all(0 <= r.score <= 1 for r in got)
    none_known = quality_classifier.classify(docs, labels.where("doc_id < 0"))
    assert {r.score for r in none_known.collect()} == {0.5}
    assert quality_classifier.classify(none, labels).count() == 0


def test_pipeline_runs(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF).collect()
    assert out and all(0 < r.taken <= 3 * r["size"] for r in out)
    assert len({r.doc_id for r in out}) == len(out)
