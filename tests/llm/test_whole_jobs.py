"""The corpus operators do their whole job: cases that a bound or a floor once left out."""

import hashlib
import math
import random

import pytest

from panelwright.llm import chat_format, decontamination, license_scan, line_dedup, lm_scoring, simhash_dedup, source_mixing


def test_language_model_learns_from_a_text_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "PASS_TOKENS", 1, raising=False)  # one pass is enough here
    frame = spark.createDataFrame([(5, "a b " * 130_000), (1, "a b " * 500)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scoring.op3(frame).collect()}
    assert got[1].held_out and not got[5].held_out
    assert got[1].base_score < -250 and got[1].score > 0.5 * got[1].base_score


def test_slices_and_units_train_on_every_training_token(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "UNIT_TOKENS", 300)
    monkeypatch.setattr(lm_scoring, "PASS_TOKENS", 1)
    seen = []
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    collect = type(frame).collect

    def spy(self):
        out = collect(self)
        if self.columns == ["group", "n", "weights"]:
            seen.extend(r["n"] for r in out)
        return out

    monkeypatch.setattr(type(frame), "collect", spy)
    got = lm_scoring.op3(frame).collect()
    assert sum(seen) == got[0].train_tokens == sum(r.n_tokens for r in got if not r.held_out) and len(seen) > 8


def test_short_lines_that_repeat_exactly_go(spark):
    texts = [(1, "enststung ench.\nその行\n\nfour words stand here"), (2, "Enststung  ench.\nその行\n\nfour words stood here\nnew"), (3, "new\nnew\n \nenststung ench")]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.op2(frame).collect()}
    assert got == {1: (texts[0][1], 0), 2: ("\nfour words stood here\nnew", 2), 3: (" \nenststung ench", 2)}


def _nearest(t, item):
    found = [(_levenshtein(t[i:j], item), i) for i in range(len(t)) for j in range(i + 1, len(t) + 1) if abs(j - i - len(item)) <= len(item) // 5 + 1]
    return min(found, default=(len(item), 0))


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_leaks_of_any_length(spark):
    rng = random.Random(5)
    items = [[f"item{k}w{i % 7 if k == 1 else i}" for i in range(n)] for k, n in enumerate((20, 16, 9, 5, 4, 2))]
    texts, want = [], {}
    for k in range(150):
        item = k % len(items)
        w = list(items[item])
        for _ in range(rng.randrange(0, len(w) // 4 + 2)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = ["edit"] * rng.randrange(2)
        side = rng.choice([0, 0, 12])  # documents that are the passage alone, and longer ones
        t = [f"x{i}" for i in range(side)] + w + [f"y{i}" for i in range(side)]
        texts.append((k, " ".join(t)))
        for j, words in enumerate(items):
            d, first = _nearest(t, words)
            if d <= len(words) // 5:
                want[k, j] = (d, first)
    texts += [(1000, " ".join(items[0][:9] + items[0][10:])), (1001, " ".join(["x"] * 30 + items[0][:8] + items[0][11:] + ["y"] * 30)), (1002, " ".join([*items[3][:2], "z", *items[3][3:]]))]
    want |= {(1000, 0): (1, 0), (1001, 0): (3, 30), (1002, 3): (1, 0)}
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.distance, r.first_word) for r in decontamination.contaminations(frame, bench, any_length=True).collect()}
    assert got == want
    kept = {r.doc_id for r in decontamination.drop_contaminated(frame, bench, any_length=True).collect()}
    assert kept == {k for k, _ in texts} - {d for d, _ in want}


def test_recall_of_the_search_by_item_length():
    """Against every window: at least 0.9 of the leaks at the full number of edits are found, and all exact ones."""
    rng = random.Random(17)
    for n in [*range(1, 13), 16, 20, 33]:
        items = [[f"i{k}w{rng.randrange(40)}" for _ in range(n)] for k in range(12)]
        index, k = decontamination.build_index([(i, " ".join(w)) for i, w in enumerate(items)]), n // 5
        texts, owner = [], []
        for i, item in enumerate(items):
            for edits in [0, *[k] * 8]:
                w = list(item)
                for _ in range(edits):
                    at = rng.randrange(len(w))
                    w[at : at + rng.randrange(2)] = ["edit"] * rng.randrange(2)
                if w and _nearest(w, item)[0] <= k:
                    texts.append(" ".join(["lead"] * 9 + w + ["tail"] * 9))
                    owner.append((i, _nearest(w, item)[0]))
        found = decontamination.leaks(texts, index, any_length=True)
        hits = [any(row == i for row, _, _ in rows) for (i, _), rows in zip(owner, found)]
        assert sum(hits) >= 0.9 * len(hits), n
        assert all(h for h, (_, d) in zip(hits, owner) if d == 0)


def test_benchmark_with_repeated_items(spark):
    bench = spark.createDataFrame([(1, None), (1, "one two three four five"), (2, "ONE two, three four five"), (None, "x y"), (3, "")], "item_id long, text string")
    docs = spark.createDataFrame([(7, "a one two three four five b"), (7, "x y"), (None, "one two three 4 five"), (8, None), (9, "")], "doc_id long, text string")
    got = sorted(decontamination.contaminations(docs, bench, any_length=True).collect(), key=str)
    assert sorted((str(r.doc_id), str(r.item_id), r.distance) for r in got) == sorted([("7", "1", 0), ("7", "2", 0), ("7", "None", 0), ("None", "1", 1), ("None", "2", 1)])
    assert sorted(str(r.doc_id) for r in decontamination.drop_contaminated(docs, bench, any_length=True).collect()) == ["8", "9"]


def test_kept_line_stays_where_near_copies_chain(spark):
    lines = ["a b c d e f", "a b c d e X", "a b c d Y X", "q r s t u v"]
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(lines)] + [(9, "a b c d Y X", "own")], "doc_id long, text string, n_dropped string")
    gone = {r.doc_id: r.kept_doc_id for r in line_dedup.repeated_lines(docs).collect()}
    assert gone == {1: 0, 2: 0, 9: 0}
    assert line_dedup.dedup_lines(docs).columns == ["doc_id", "text", "own_n_dropped", "n_dropped"]
    plain = line_dedup.dedup_lines(docs, count=None)
    assert plain.columns == docs.columns and {r.n_dropped for r in plain.collect()} == {"own"}


def test_rows_of_one_id_are_judged_each_by_its_text(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (None, a, 4), (None, b, 5), (3, a, 6), (8, None, 7), (9, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    kept = [(r.doc_id, r.text) for r in simhash_dedup.keep_one_per_group(docs).collect()]
    assert sorted(kept, key=str) == sorted([(3, a), (5, b), (8, None)], key=str)


def test_classifier_forward_pass_and_odd_rows(spark):
    from panelwright.llm import quality_classifier as Q

    rng = random.Random(6)
    good, bad = "calm river stone light".split(), "buy cheap now click".split()
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) + str(rng.randrange(5)) for _ in range(30)), "mine") for i in range(300)]
    rows += [(300, None, "x"), (301, "", "x"), (None, rows[0][1], "x"), rows[1], (302, "long " * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    net = Q.fit(docs, labels)

    def forward(text):
        words, n = (text or "").encode().lower().split(), 0
        x = [0.0] * (3 * net.vectors.shape[1] + 2)
        if words:
            n, x = len(words), []
            shapes = [w[-3:] for w in (text or "").encode().translate(Q.SHAPE).split()]
            import zlib

            kinds = [[zlib.crc32(w) % Q.BUCKETS for w in words], [zlib.crc32(w[-3:], 1) % Q.BUCKETS for w in words], [zlib.crc32(w, 2) % Q.BUCKETS for w in shapes]]
            for units in kinds:
                for j in range(net.vectors.shape[1]):
                    x.append(sum(float(net.vectors[u, j]) for u in units) / n)
            x += [math.log1p(n) / 8, len(set(kinds[0])) / n]
        z = [(v - m) / s for v, m, s in zip(x, net.mean, net.scale)]
        hidden = [math.tanh(sum(v * net.w1[i][h] for i, v in enumerate(z)) + net.b1[h]) for h in range(len(net.b1))]
        return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(hidden, net.w2)) + net.b2) / net.temperature))

    got = Q.classify(docs, labels)
    assert got.columns == ["doc_id", "text", "own_score", "held_out", "score", "predicted"]
    out = got.collect()
    assert len(out) == len(rows)
    for r in out[:20] + out[300:304]:
        assert r.score == pytest.approx(forward(r.text), abs=1e-4) and r.predicted == (r.score >= 0.3)
    assert len({r.score for r in out if r.text == rows[1][1]}) == 1
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in out)
    assert Q.classify(docs.where("doc_id > 999"), labels).count() == 0 and {r.score for r in Q.classify(docs, labels.where("doc_id > 999")).collect()} == {0.5}


def common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for k, y in enumerate(b):
            row.append(before[k] + 1 if x == y else max(before[k + 1], row[k]))
    return row[-1]


def brute_labels(words, templates):
    """Labels of the templates that a text of one copy holds, by the whole table of common subsequences."""
    out = set()
    for label, wording, needs, bars in license_scan.pieces(templates):
        grams = {tuple(wording[k : k + 3]) for k in range(len(wording) - 2)}
        whole = any(tuple(words[k : k + 3]) in grams for k in range(len(words) - 2))
        pairs = set(map(" ".join, zip(words, words[1:])))
        held = all(set(n) & pairs for n in needs) and not set(bars) & set(words)
        if whole and held and common_length(words, wording) >= license_scan.COVER * len(wording) - 1e-9:
            out.add(label)
    return out


def test_labels_equal_brute_force_over_edits(spark):
    """One edited wording a text: words lost, replaced and put in; all labels are compared, found ones and others."""
    rng, rows, want = random.Random(2), [], {}
    for k in range(240):
        _, wording, _, _ = license_scan.TEMPLATES[k % len(license_scan.TEMPLATES)]
        w = wording.split()
        most = license_scan.spared(len(w)) + 1
        for _ in range(rng.randrange(0, most + 1)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], ["other"], ["other"]])
        for _ in range(rng.randrange(0, min(most, 3))):
            w.insert(rng.randrange(len(w) + 1), "between")
        words = ["lead"] * 4 + w + ["end"] * 4
        rows.append((k, " ".join(words), "x", 1))
        want[k] = brute_labels(words, license_scan.TEMPLATES)
    frame = spark.createDataFrame(rows, "doc_id long, text string, label string, size int")
    base = {r.doc_id: set(r.base_labels.split(",")) - {""} for r in license_scan.op6(frame).collect()}
    for r in license_scan.op6(frame).collect():
        assert set(r.labels.split(",")) - {""} == want[r.doc_id] | base[r.doc_id], (rows[r.doc_id], want[r.doc_id])
    assert sum(bool(x) for x in want.values()) > 60 and sum(not x for x in want.values()) > 20


def test_distinguishing_words_decide(spark):
    gpl = "this program is free software you can redistribute and or modify it under terms of the gnu public license as published by the free software foundation"
    texts = {
        1: ("licensed under a creative commons attribution 4 0 international license", "cc-by"), 2: (license_scan.TEMPLATES[5][1], "gpl"), 3: ("released under the apache license", "apache"), 4: (gpl, "gpl"),
        5: (license_scan.TEMPLATES[5][1].replace("general", "lesser general"), "lgpl"), 6: ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"), 7: ("Released under the license", ""),
        8: (license_scan.TEMPLATES[5][1] + " . The Lesser license is another.", "gpl"),
    }
    frame = spark.createDataFrame([(k, f"Some code. {t}. More text.") for k, (t, _) in texts.items()], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in license_scan.op6(frame).collect()} == {k: label for k, (_, label) in texts.items()}


def test_whole_license_texts_as_templates(spark):
    rng = random.Random(4)
    word = lambda: "w" + str(rng.randrange(400))
    long = [word() for _ in range(500)]
    templates = (("own", " ".join(long), long[250], "never"), ("other", " ".join(word() for _ in range(61)), "", ""))
    assert [len(x[1]) for x in license_scan.pieces(templates)] == [55, 56, 55, 56, 55, 56, 55, 56, 56, 30, 31]
    edited = [w for k, w in enumerate(long) if k % 9]
    frame = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(edited)), (3, " ".join(rng.sample(long, 400))), (4, None), (5, " ".join(long * 20))], "doc_id long, text string")
    got = {r.doc_id: (r.labels, round(r.score, 2)) for r in license_scan.scan(frame, templates).collect()}
    assert got[1] == ("own", 1.0) and got[2][0] == "own" and 0.8 <= got[2][1] < 0.95 and got[3] == ("", 0.0) and got[4] == ("", 0.0) and got[5] == ("own", 1.0)


def test_shard_draws_follow_the_targets(spark):
    sources = spark.createDataFrame([(1, 70_000.4), (2, 59_999.3), (3, 0.0), (4, 1_000.3)], "source_no long, slots double")
    counts = source_mixing.shard_counts(sources).collect()
    shards = {r.shard for r in counts}
    assert len(shards) == 2 and sum(r.n for r in counts) == 131_000
    for shard in shards:
        n = {r.source_no: r.n for r in counts if r.shard == shard}
        for no, slots in ((1, 70_000.4), (2, 59_999.3), (3, 0.0), (4, 1_000.3)):
            assert slots / 2 - 1 <= n.get(no, 0) <= slots / 2 + 4
        assert n.get(3, 0) == 0
    again = source_mixing.shard_counts(sources.repartition(3)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, counts))


def test_many_equal_rows_are_mixed_as_documents_of_their_own(spark):
    docs = spark.createDataFrame([(1, "one two three", "a")] * 50 + [(None, None, None)] * 5 + [(2, "x", None)], "doc_id long, text string, source string")
    got = source_mixing.mix(docs, 4).collect()
    assert len(got) == 56 and {r.source_size for r in got if r.source == "a"} == {150}
    taken = sum(r.taken for r in got if r.source == "a")
    assert abs(taken - got[0].target if got[0].source == "a" else 0) <= 8 and all(0 <= r.taken <= 3 * r["size"] for r in got)


def test_chat_turns_without_a_number_and_long_texts(spark):
    rows = [(1, 2, "assistant", "b" * 300_000, "z"), (1, None, "user", "a", "z"), (1, 2, "assistant", "a", "z"), (2, 1, "user", "u", "z")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example string")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.examples(frame)).collect()}
    assert got[1].loss_chars == 300_001 and got[1].loss_sha256 == hashlib.sha256(("a" + "b" * 300_000).encode()).hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(("user\na\nassistant\na\nassistant\n" + "b" * 300_000 + "\n").encode()).hexdigest()
    assert (got[2].n_examples, got[2].loss_chars) == (0, 0) and chat_format.examples(frame.where("conv_id > 9")).count() == 0


def test_stages_on_odd_tables(spark):
    import corpus_pipeline as P

    columns = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "", None, None, None), (1, "a b c\na b c", "en", "s", 9), (2, "a b c\na b c", "en", "s", 9)], columns)
    for name, stage in P.STAGES:
        out = stage(spark, odd, "/root/testdata/sf0.001")
        assert out.count() <= 4 and (name == P.STAGES[-1][0] or out.columns == odd.columns), name
        assert stage(spark, spark.createDataFrame([], columns), "/root/testdata/sf0.001").count() == 0
