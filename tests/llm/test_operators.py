"""Each operator against a brute-force version, and its defined results for odd input."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import licenses, lines, mixing, neardup, neighbours, packing, quality, repeats, toxicity, warc, work

BLANK = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, source string, id long, n long, key string, row string, __text string"


def docs(spark, *rows):
    """(doc_id, text[, source]) rows, with extra columns whose names clash with internal ones."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "s", 7, 8, "k", "r", "t") for r in rows]
    return spark.createDataFrame(full, DOCS)


def words_of(text):
    for c in BLANK:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def prose(rng, n, vocabulary=4000):
    return " ".join("w" + "".join("abcdefghij"[int(d)] for d in str(rng.randrange(vocabulary))) for _ in range(n))


# -- near duplicates


def groups(rows, size, percent=80):
    sets = {}
    for doc, text in rows:
        w = words_of(ascii_lower(text or ""))
        s = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        if doc is not None:
            sets.setdefault(doc, []).append(s)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {d: find(d) for d in sets}


def near_rows():
    rng = random.Random(5)
    rows, base = [], prose(rng, 120).split()
    for i in range(40):  # copies of one text with more and more edits: chains and near misses
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(w)))
    rows += [(300 + i, prose(rng, rng.randrange(1, 60))) for i in range(30)]
    one, two = prose(rng, 100), prose(rng, 100)  # ids 505 and 511 have two texts each, and join five documents
    rows += [(505, one), (505, two), (509, two + " x"), (511, one + " y"), (511, "quite another text"), (513, "quite another text"), (505, one)]
    rows += [(1, rows[3][1].upper()), (2, None), (3, ""), (4, " \n"), (5, "one two"), (6, "ONE\ttwo"), (7, "ONE two three"), (None, "one two")]
    return rows


@pytest.mark.parametrize("listed", [256, 4])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, listed):
    monkeypatch.setattr(neardup, "LISTED", listed)  # 4: buckets are split into cells
    monkeypatch.setattr(work, "TOGETHER", listed)  # 4: rows of frequent pivots are spread
    rows = near_rows()
    got = neardup.near_duplicates(docs(spark, *rows), shingle=4).collect()
    assert len(got) == len(rows)
    want = groups(rows, 4)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id in (2, 3, 4, 5, 7)} == {2: 0, 3: 0, 4: 0, 5: 1, 7: 1}


def test_verifier_tells_texts_of_one_id_and_length_apart():
    import pyarrow as pa

    one, two = "a b c d e f", "u v w x y z"
    batch = pa.RecordBatch.from_pydict({"a": [1, 1], "b": [2, 3], "text_a": [one, two], "text_b": [one, two]})
    got = [r["b"] for out in neardup._verifier(3, 80)(iter([batch])) for r in out.to_pylist()]
    assert got == [2, 3]


def thue_morse(n):
    """A word of 2^n letters, and it with its letters exchanged: equal under polynomial hashes modulo 2^64."""
    word = [bin(i).count("1") % 2 for i in range(1 << n)]
    return "".join("ab"[x] for x in word), "".join("ba"[x] for x in word)


def test_words_made_to_collide_stay_apart(spark):
    one, other = thue_morse(10)
    got = neardup.near_duplicates(docs(spark, (1, one), (2, other), (3, one)), shingle=4).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 1}


def test_links_are_told_by_words():
    from recordloom.llm.shingles import linked

    rng = random.Random(21)
    for _ in range(200):
        size = rng.choice([1, 2, 4, 5])
        a = [rng.choice("abcABC") for _ in range(rng.randrange(12))]
        b = list(a) if rng.random() < 0.5 else [rng.choice("abc") for _ in range(rng.randrange(12))]
        if b and rng.random() < 0.5:
            b[rng.randrange(len(b))] = "x"
        want = groups([(1, " ".join(a)), (2, "\n".join(b))], size, 60)
        assert linked(" ".join(a), "\n".join(b), size, 60) == (want[2] == 1)
    many = " ".join(f"w{i}" for i in range(200_000))  # words too many for packed keys
    assert linked(many, many + " x", 5, 99) and not linked(many, many[: len(many) // 2], 5, 60)


def test_near_duplicates_of_long_texts(spark):
    rng = random.Random(22)
    long = [f"w{rng.randrange(5000)}" for _ in range(300_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:-1000])), (3, "x" * 2_000_000), (4, "x" * 2_000_000 + "y"), (5, " \n" * 1_000_000), (6, "a " * 500_000), (7, "A\n" * 700_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs(spark, *rows), shingle=4).collect()}
    assert [c for _, c in (got[i] for i in range(1, 8))] == [1, 1, 3, 4, 5, 6, 6] and got[3][0] == 1 and got[5][0] == 0 and got[6][0] == 1


def test_components_of_long_paths_take_few_rounds(spark, monkeypatch):
    rng, written, n = random.Random(9), [], 1000
    names = list(range(n))
    rng.shuffle(names)
    star = [(5000, 4000 + i) for i in range(50)]  # its centre has the largest id
    edges = [(i, i + 1) for i in range(n - 1)] + [(10_000 + names[i], 10_000 + names[i + 1]) for i in range(n - 1)] + star + [(7, 7), (20_001, 20_000)]
    write = neardup.materialize
    monkeypatch.setattr(neardup, "materialize", lambda df, label: (written.append(label), write(df, label))[1])
    got = {r.id: r.component for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(n)} | {10_000 + i: 10_000 for i in range(n)} | {4000 + i: 4000 for i in range(50)} | {5000: 4000, 20_000: 20_000, 20_001: 20_000}
    assert got == want and written.count("edges") <= 12
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_an_empty_table(spark):
    assert neardup.near_duplicates(docs(spark)).count() == 0


def test_estimate_follows_the_similarity():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    for common in (500, 1500, 1900):
        a, b = np.sort(h[:2000]), np.sort(np.concatenate([h[:common], h[2000 : 4000 - common]]))
        regs = neardup.registers([a, b])
        true = common / (len(a) + len(b) - common)
        assert abs(neardup.estimate(regs[:1], regs[1:], np.array([len(a)]), np.array([len(b)]))[0] - true) < 0.15


# -- quality


def quality_by_hand(text):
    text = text or ""
    w = words_of(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_counts_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", "a", "a b c a b c", "x\nx\n\nx\n y", "# % é 🙂 | <b>", "Und " * 300, "!! " * 60, prose(rng, 400, 20), prose(rng, 300), "v" * 5000]
    texts += [prose(rng, 300, 6), "\n".join([prose(rng, 9)] * 8 + [prose(rng, 60)])]
    rows = list(enumerate(texts)) + [(None, prose(rng, 80)), (0, None)]
    got = quality.quality_cascade(docs(spark, *rows), sample_rows=5).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for doc, text in rows[:-1]:
        r = by_id[doc]
        want = quality_by_hand(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, doc
        assert r.base_failed == (want[0] < 50 or 2 * want[4] > want[0])
        assert r.kept == (r.rejected_by is None) and not (r.base_failed and r.kept)
    assert by_id[9].kept and by_id[None].kept and not by_id[7].kept
    assert quality.quality_cascade(docs(spark)).count() == 0


def test_rule_order_does_not_change_verdicts(spark, monkeypatch):
    rng = random.Random(4)
    table = docs(spark, (1, prose(rng, 90)), (2, prose(rng, 60) + " ###" * 40), (3, ("word !! " * 70) + prose(rng, 300)))
    first = {r.doc_id: r.kept for r in quality.quality_cascade(table).collect()}
    monkeypatch.setattr(quality, "order_rules", lambda *a: list(quality.RULES)[::-1])
    assert first == {r.doc_id: r.kept for r in quality.quality_cascade(table).collect()} == {1: True, 2: False, 3: False}


def test_cheap_rules_come_before_costly_ones(spark):
    rng = random.Random(6)
    table = docs(spark, *[(i, prose(rng, 300) + (" bad" if i % 2 else "")) for i in range(120)], (500, "short and bad"))
    costly = "length(regexp_replace(regexp_replace(text, '([a-j])([a-j])', '$2$1'), '([a-j])(.)', '$2$1')) > 0 and text like '% bad'"
    rules = {"costly": costly, "never": "n_words < 0", "cheap": "text like '% bad'"}
    assert quality.order_rules(table, rules, "text", 50, 200, 1) == ["cheap", "costly", "never"]
    based = quality.with_base(table, "text").withColumn("text", F.col("__text")).where("n_words >= 50")
    found = {name: (seconds, share) for name, seconds, share in quality.measured(based.cache(), rules)}
    assert found["costly"][0] > 3 * found["cheap"][0] and found["cheap"][1] == found["costly"][1] == 0.5  # "short and bad" isn't among them
    assert quality.order_rules(docs(spark), rules, "text", 50, 200, 1) == quality.order_rules(docs(spark, (1, "short")), rules, "text", 50, 200, 1) == list(rules)


# -- lines


def lines_by_hand(rows, least=10):
    key = lambda line: ascii_lower(line.strip(BLANK))
    first, holders = {}, defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(doc)
    first = {k: min(v) for k, v in holders.items() if len(v) > 1}
    out = []
    for doc, text in rows:
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if first.get(key(x), doc) == doc]
        out.append((doc, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup_equals_brute_force(spark):
    long = "The same line of text"
    rows = [(1, f"{long}\nown one is here\n{long}"), (2, f" {long.upper()}\t\nshort"), (3, "short\n\n"), (4, None), (5, ""), (6, f"{long}\nÉÉÉÉÉÉÉÉÉÉ x"), (7, "éééééééééé x\nÉÉÉÉÉÉÉÉÉÉ x"), (8, "own one is here\r\nlast line of eight"), (8, "own one is here")]
    got = lines.line_dedup(docs(spark, *rows))
    assert set(docs(spark).columns) < set(got.columns)
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == lines_by_hand(rows)
    assert lines.line_dedup(docs(spark)).count() == 0


def test_null_ids_stand_last_and_apart(spark):
    shared = "a line that some have"
    rows = [(None, shared), (9, shared), (None, "a line that two have not\nx"), (None, "y\na line that two have not"), ((1 << 63) - 1, shared + "\nz"), (None, shared)]
    got = Counter((r.doc_id, r.text) for r in lines.line_dedup(docs(spark, *rows)).collect())
    assert got[(9, shared)] == 1 and got[((1 << 63) - 1, "z")] == 1 and got[(None, "")] == 2
    assert {t for d, t in got if d is None and t} in ({"a line that two have not\nx", "y"}, {"x", "y\na line that two have not"})


def test_line_dedup_of_a_long_text(spark):
    many = [f"line number {i} of the long text" for i in range(20_000)]
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in lines.line_dedup(docs(spark, (1, "\n".join(many)), (2, "\n".join(many[::-1] + ["own"])))).collect()}
    assert got == {1: (20_000, 0), 2: (20_001, 20_000)}


# -- repeated strings


def repeats_by_hand(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    n = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                hit[i : i + length] = True
        spans = int((hit[1:] & ~hit[:-1]).sum() + hit[0]) if len(b) else 0
        out.append((len(b), int(hit.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~hit])).hexdigest()))
    return out


@pytest.mark.parametrize("sorted_", [512, 3, 1])
def test_repeats_equal_brute_force(spark, monkeypatch, sorted_):
    monkeypatch.setattr(repeats, "SORTED", sorted_)  # 3: buckets are split and their parts sorted; 1: parts are split to the end
    rng = random.Random(8)
    passage, other = prose(rng, 60), prose(rng, 45)
    texts = [prose(rng, rng.randrange(0, 120)) + passage[rng.randrange(60) :] + " é" + prose(rng, rng.randrange(0, 90)) for _ in range(12)]
    texts += [None, "", "ab" * 400, "a" * 199, "a" * 200, "b" * 201, other, other, other[:200], other[1:199], passage + other + passage, texts[0], "é" * 300]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(1, texts[1])]
    got = repeats.remove_repeats(docs(spark, *rows)).collect()
    want = repeats_by_hand([t for _, t in rows])
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got) == Counter((d, *w) for (d, _), w in zip(rows, want))


@pytest.mark.parametrize("sorted_", [512, 8])
def test_repeats_of_one_large_bucket(spark, monkeypatch, sorted_):
    """Copies of one passage between different texts: its anchors have many runs, its inner ones many equal runs."""
    monkeypatch.setattr(repeats, "SORTED", sorted_)
    rng = random.Random(9)
    passage = prose(rng, 50)
    rows = [(i, prose(rng, rng.randrange(3)) + passage[: 230 + i % 40] + "xyz"[i % 3] + prose(rng, 2)) for i in range(40)]
    rows += [(100 + i, passage[i : 180 + i] + prose(rng, 20, 3)) for i in range(30)]
    got = repeats.remove_repeats(docs(spark, *rows)).collect()
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got} == {(d, *w) for (d, _), w in zip(rows, repeats_by_hand([t for _, t in rows]))}


@pytest.mark.parametrize("long_text", [prose(random.Random(10), 700), "a" * 2900])
def test_slices_list_the_runs_of_the_whole(monkeypatch, long_text):
    def suffixes():
        """(start, anchor) of every suffix."""
        return sorted((s + i, p) for *_, (_, starts, sizes, anchors, _) in repeats._listed(repeats.pa.array([long_text]), 200) for s, n, p in zip(starts, sizes, anchors) for i in range(n))

    whole = suffixes()
    monkeypatch.setattr(repeats, "SLICE", 700)
    assert suffixes() == whole and len(whole) == len(long_text) - 199


def test_hot_keys_are_spread_without_loss(spark, monkeypatch):
    rows = spark.range(9000).selectExpr("named_struct('id', id, 'tag', id % 7) row", "id start", "if(id < 5000, 0, id % 50) key")
    keys = rows.groupBy("key").agg(F.count("*").alias("copies")).where("key % 2 = 0")
    got = repeats._spread(rows, keys, ["key"])
    assert sorted(r.start for r in got.collect()) == [i for i in range(9000) if i < 5000 or i % 2 == 0]


def test_repeats_of_an_empty_table(spark):
    assert repeats.remove_repeats(docs(spark)).count() == 0


def test_difference_cover_covers():
    d = repeats.difference_cover(repeats.COVER)
    assert {(a - b) % repeats.COVER for a in d for b in d} == set(range(repeats.COVER)) and len(d) < 12


# -- toxicity


def toxic_rows(n, seed):
    rng = random.Random(seed)
    bad, rows = ["nasty", "vile", "awful", "rotten"], []
    for i in range(n):
        toxic = i % 5 == 0
        w = prose(rng, 40).split()
        for _ in range(rng.randrange(2, 9) if toxic else 0):
            w[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows, test = toxic_rows(500, 1), toxic_rows(200, 2)
    labels = spark.createDataFrame([(d, t) for d, _, t in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs(spark, *[(d, x) for d, x, _ in rows]), labels)
    assert list(model.thresholds) == sorted(model.thresholds)
    table = docs(spark, *[(d, x) for d, x, _ in test], (None, None), (900, ""))
    got = {r.doc_id: r for r in toxicity.score(table, model).collect()}
    assert len(got) == 202 and not got[None].toxic and not got[900].toxic
    assert np.mean([got[d].toxic == bool(t) for d, _, t in test]) > 0.97
    many = {d: x.split() for d, x, t in test if t}
    hits = {d: len(set(w) & {"nasty", "vile", "awful", "rotten"}) for d, w in many.items()}
    assert np.corrcoef([hits[d] for d in hits], [got[d].severity for d in hits])[0, 1] > 0.5
    kept = toxicity.drop_toxic(table, model)
    assert kept.columns == table.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, r in got.items() if not r.toxic)


def test_likelihood_and_slopes_equal_brute_force():
    rng = np.random.default_rng(4)
    n, width, top, penalty = 30, 6, 3, 0.01
    has = rng.random((n, width)) < 0.4
    rows, cols = np.nonzero(has)
    grades = rng.integers(0, top + 1, n)
    w, t = rng.normal(size=width), np.array([0.3, -0.5, 0.2])

    def by_hand(w, t):
        theta = [t[0], t[0] + np.exp(t[1]), t[0] + np.exp(t[1]) + np.exp(t[2])]
        total = 0.0
        for i in range(n):
            above = [1.0, *(1 / (1 + np.exp(-(w[has[i]].sum() - k))) for k in theta), 0.0]
            total -= np.log(above[grades[i]] - above[grades[i] + 1])
        return total / n + penalty / 2 * (w @ w)

    loss, by_w, by_t = toxicity.loss_and_slope(w, t, rows, cols, grades, penalty)
    assert abs(loss - by_hand(w, t)) < 1e-12
    step = 1e-6
    for i, e in enumerate(np.eye(width) * step):
        assert abs((by_hand(w + e, t) - by_hand(w - e, t)) / (2 * step) - by_w[i]) < 1e-7
    for i, e in enumerate(np.eye(top) * step):
        assert abs((by_hand(w, t + e) - by_hand(w, t - e)) / (2 * step) - by_t[i]) < 1e-7


def test_equal_tables_give_equal_models(spark):
    rows = toxic_rows(300, 7)
    labels = spark.createDataFrame([(d, t) for d, _, t in rows] + [(4, 0), (4, 1)], "doc_id long, toxic int")
    table = docs(spark, *[(d, x) for d, x, _ in rows], (4, "another text of four"), (None, "vile"), (2, None))
    one = toxicity.train(table, labels)
    assert one.weights and one == toxicity.train(table.repartition(7, "text"), labels.repartition(3).orderBy(F.desc("toxic")))
    few = toxicity.labelled(table, labels, "doc_id", "text", "toxic", 50).collect()
    assert len(few) == len({r.id for r in few}) <= 50


def test_scores_equal_brute_force(spark):
    rows = toxic_rows(300, 8)
    model = toxicity.train(docs(spark, *[(d, x) for d, x, _ in rows]), spark.createDataFrame([(d, t) for d, _, t in rows], "doc_id long, toxic int"))
    for r in toxicity.score(docs(spark, *[(d, x) for d, x, _ in rows[:40]]), model).collect():
        features = {toxicity._feature(w) for w in rows[r.doc_id][1].lower().split()}
        total = sum(model.weights.get(f, 0.0) for f in features)
        want = sum(1 / (1 + np.exp(-(total - k))) for k in model.thresholds)
        assert abs(r.severity - want) < 1e-6 and r.toxic == (r.severity >= model.cutoff) and r.grade == round(r.severity)


def test_toxicity_without_toxic_labels(spark):
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs(spark, (1, "some words")), labels)
    assert [r.toxic for r in toxicity.score(docs(spark, (1, "some words")), model).collect()] == [False]
    assert toxicity.score(docs(spark), model).count() == 0


# -- mixing


def test_mix_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(0, 50)), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(400)]
    rows += [(None, "three words here", "a"), (5, rows[5][1], rows[5][2]), (7000, None, "b"), (7001, "", "e")]
    table = docs(spark, *rows)
    got = mixing.mix_sources(table).collect()
    assert len(got) == len(rows)
    total, by = sum(r.size for r in got), defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r.size
    for own in by.values():
        assert sum(r.size for r in own) == own[0].source_size
        assert sum(r.taken for r in own) == round(own[0].target) and own[0].target <= 3 * own[0].source_size
    assert abs(sum(own[0].target for own in by.values()) - total) < 1e-6
    free = [own[0].target / w for (s, own), w in zip(sorted(by.items(), key=lambda x: (x[0] is None, x[0] or "")), (1, 2, 3, 1, 2, 3)) if own[0].target < 3 * own[0].source_size - 1e-6]
    assert max(free) - min(free) < 1e-6
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_sources(table.repartition(5)).collect()), key=repr)
    assert mixing.mix_sources(docs(spark)).count() == 0


def test_inclusion_follows_the_weights(spark):
    """A document is in the mix as often as its weight says, whole copies first."""
    long, short, n = " ".join(["w"] * 40), "w w w", 1500  # weights 6 and 2
    rows = [(i, short if i % 2 else long, "a") for i in range(2 * n)] + [(10_000 + i, "one two " * 9, "b") for i in range(5000)]
    got = mixing.mix_sources(docs(spark, *rows)).collect()
    level = next(r.target for r in got if r.source == "a") / (n * 3 * 2 + n * 40 * 6)
    assert 6 * level < 3
    for size, weight in ((3, 2), (40, 6)):
        copies = [r.taken / r.size for r in got if r.source == "a" and r.size == size]
        share = level * weight - int(level * weight)
        assert abs(np.mean(copies) - level * weight) < 4 * np.sqrt(share * (1 - share) / n), (size, np.mean(copies), level * weight)
        assert int(level * weight) <= min(copies) and max(copies) <= int(level * weight) + 1


def test_documents_at_their_limit_are_not_drawn_again(spark):
    """Source a comes near three times its size, so its heaviest documents have three whole copies and no chance of more."""
    sizes = [81, 150, 420, 150, 664, 505, 133, 103, 512, 357]
    rows = [(i, "w " * n, "a") for i, n in enumerate(sizes)] + [(100, "w " * 23_394, "b")]
    got = mixing.mix_sources(docs(spark, *rows)).collect()
    assert all(r.taken <= 3 * r.size for r in got) and {r.taken for r in got if r.size in (512, 664)} == {3 * 512, 3 * 664}
    assert sum(r.taken for r in got if r.source == "a") == 8823


def test_mix_carries_columns(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (1, "d e f", "s"), (None, "x y", "s"), (None, "z w v", "s"), (2, None, None)]
    got = mixing.mix_sources(docs(spark, *rows), carry=("text", "n", "id")).collect()
    assert Counter((r.doc_id, r.carried.text) for r in got) == Counter((d, t) for d, t, _ in rows)
    assert all((r.carried.n, r.carried.id) == (8, 7) for r in got)
    plain = mixing.mix_sources(docs(spark, *rows)).collect()
    key = lambda r: (r.doc_id, r.source, r.size, r.taken)
    assert Counter(map(key, got)) == Counter(map(key, plain)) and sum(r.taken for r in got) == 14


def test_mix_of_texts_without_words(spark):
    got = mixing.mix_sources(docs(spark, (1, None, "a"), (2, "", None))).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


# -- WARC

PAGES = "page_id long, url string, html string, digest string, capture long"


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "http://a/x y\n", "<p>é</p>"), (1, "http://b", "<p>é</p>"), (2, None, None), (4, "http://c", ""), (5, "u", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n"), (None, "v", "<p>é</p>"), (1, "http://b", "<p>é</p>"), (6, "w", "z" * 200_000)]
    table = spark.createDataFrame([(*r, "d", 1) for r in rows], PAGES)
    warc.write_pages(table, f"file://{tmp_path}/a")
    found = warc.read_records(spark, f"file://{tmp_path}/a")
    assert found.count() == 3 * len(rows) and found.where("verified = false").count() == 0
    captures = warc.assemble(found)
    assert captures.where("request is null or metadata is null or response is null").count() == 0
    got = Counter(map(tuple, warc.captured_pages(captures).collect()))
    import base64

    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    n = lambda h: len((h or "").encode())
    want = Counter()
    for i, (p, _, h) in enumerate(rows):
        same = [k for k, r in enumerate(rows) if (r[2] or "") == (h or "")]
        first = min(same, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
        want[(p, n(h), digest(h), "response" if i == first else "revisit", None if i == first else rows[first][0])] += 1
    assert got == want


def test_warc_of_two_writes_keeps_every_capture(spark, tmp_path):
    for name, ids in (("a", (1, 2)), ("b", (3, 4))):
        warc.write_pages(spark.createDataFrame([(i, "u", f"page {i % 2}", "d", 1) for i in ids], PAGES), f"file://{tmp_path}/{name}")
    found = warc.read_records(spark, f"file://{tmp_path}/*")
    assert found.count() == found.select("record_id").distinct().count() == 12
    got = sorted((r.page_id, r.record_type) for r in warc.captured_pages(warc.assemble(found)).collect())
    assert got == [(i, "response") for i in (1, 2, 3, 4)]


def _piece(kind, block, **more):
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:{kind}>", "Content-Length": len(block), **{k.replace("_", "-"): v for k, v in more.items()}}
    return b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items()) + b"\r\n" + block + b"\r\n\r\n"


def test_warc_reader_streams_foreign_archives(spark, tmp_path):
    import gzip

    payload = b"\xff WARC/1.1\r\nWARC-Type: x WARC/1.0\r\n\r\n\x00"
    response = _piece("response", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + payload, WARC_Target_URI="http://x/WARC/1.0")
    parts = [_piece("warcinfo", b""), response, _piece("request", b"GET", WARC_Concurrent_To="<urn:response>"), _piece("metadata", b"page-id: 8\r\n", WARC_Concurrent_To="<urn:response>")]
    (tmp_path / "members.gz").write_bytes(b"".join(map(gzip.compress, parts)))  # one gzip member for each record
    (tmp_path / "whole.gz").write_bytes(gzip.compress(b"".join(parts)))
    (tmp_path / "empty.gz").write_bytes(gzip.compress(b""))
    found = warc.read_records(spark, f"file://{tmp_path}")
    assert Counter(r.type for r in found.collect()) == {"warcinfo": 2, "response": 2, "request": 2, "metadata": 2}
    one = found.where("type = 'response'").first()
    assert (one.payload_bytes, one.target_uri) == (len(payload), "http://x/WARC/1.0")
    (row,) = warc.captured_pages(warc.assemble(found)).collect()  # both archives hold the same records
    assert (row.page_id, row.payload_bytes, row.record_type, row.refers_to) == (8, len(payload), "response", None)


def test_broken_archives_raise(spark, tmp_path):
    import gzip

    whole = _piece("response", b"HTTP/1.1 200 OK\r\n\r\nabc")
    for name, content in (("cut", whole[:-8]), ("head", whole[:30]), ("other", b"abc" + whole), ("tail", whole + b"x")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.gz").write_bytes(gzip.compress(content))
        with pytest.raises(Exception, match="WARC record|within a record|record's end"):
            warc.read_records(spark, f"file://{tmp_path}/{name}").collect()


def test_warc_leaves_small_payloads_alone(spark, tmp_path):
    table = spark.createDataFrame([(1, "u", "ab", "", 1), (2, "u", "ab", "", 1), (3, "u", "abcd", "", 1), (4, "u", "abcd", "", 1)], PAGES)
    warc.write_pages(table, f"file://{tmp_path}/a", min_bytes=3)
    got = {r.page_id: r.record_type for r in warc.captured_pages(warc.assemble(warc.read_records(spark, f"file://{tmp_path}/a"))).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_warc_of_an_empty_table(spark, tmp_path):
    warc.write_pages(spark.createDataFrame([], PAGES), f"file://{tmp_path}/a")
    assert warc.read_records(spark, f"file://{tmp_path}/a").count() == 0


# -- licences


def test_license_variants(spark):
    mit = licenses.LICENSES["MIT"]
    changed = "Copyright (c) 2019 Someone Else\n\n" + mit.upper().replace(", ", ",\n   ").replace("LICENSE", "licence")
    rows = [(1, mit), (2, changed), (3, mit + " More."), (4, None), (5, ""), (6, "Released under the MIT licence"), (None, mit), (1, mit), (7, "Ünrelated " * 50)]
    got = licenses.scan_licenses(docs(spark, *rows)).collect()
    assert Counter((r.doc_id, r.license) for r in got) == Counter([(1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (6, "MIT notice"), (None, "MIT"), (1, "MIT"), (7, None)])
    assert licenses.scan_licenses(docs(spark)).count() == 0


def test_spellings_are_replaced_word_by_word(spark):
    got = {r.doc_id: r.digest for r in licenses.scan_licenses(docs(spark, (1, "licence licence favour licence"), (2, "License, license favor LICENSE"), (3, "sublicence licence"))).collect()}
    assert got[1] == got[2] != got[3]
    assert not set(licenses.SPELLINGS) & set(licenses.SPELLINGS.values())


def test_lines_that_reserve_rights_are_no_part_of_a_licence(spark):
    bsd = licenses.LICENSES["BSD-3-Clause"]
    rows = [(1, "Copyright (c) 2020, Someone\nAll rights reserved.\n\n" + bsd), (2, "# All Rights Reserved\n" + bsd), (3, bsd + " all rights reserved")]
    assert {r.doc_id: r.license for r in licenses.scan_licenses(docs(spark, *rows)).collect()} == {1: "BSD-3-Clause", 2: "BSD-3-Clause", 3: None}


# -- neighbours


def test_neighbours_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[100:160] = x[100]  # more equal vectors than are asked for
    rows = [(i, [float(v) for v in x[i]]) for i in range(900)]
    odd = [(2000, None), (2010, [0.0] * 8), (2020, [float("nan")] + [1.0] * 7), (2030, [None] + [1.0] * 7), (None, [1.0] * 8), (2040, [1.0] * 3), (2050, [])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("part", F.lit("x"))
    monkeypatch.setattr(neighbours, "LEAF", 32)
    got = neighbours.nearest(table, table.where("vec_id % 20 = 0"), k=10, relax=1.0, shard_rows=300, block_rows=20, lot_blocks=2)
    by = defaultdict(list)
    for r in got.collect():
        by[r.query_id].append((r.rank, r.vec_id, r.score))
    s = x.astype(float) @ x.astype(float).T
    for q in range(0, 900, 20):
        others = [i for i in range(900) if i != q]
        want = sorted(others, key=lambda i: (-round(s[q, i], 12), i))[:10]
        assert [v for _, v, _ in sorted(by[q])] == want
    assert set(by) == set(range(0, 900, 20))
    assert neighbours.nearest(table.limit(0), table.limit(0)).count() == 0


@pytest.mark.parametrize("leaf", [512, 8])
def test_neighbours_that_tie_come_by_id(spark, monkeypatch, leaf):
    monkeypatch.setattr(neighbours, "LEAF", leaf)
    rng = np.random.default_rng(5)
    tied = [(i, [1.0, float(v), float(w)]) for i, (v, w) in enumerate(rng.normal(size=(200, 2)), 1)]  # all score 1
    rows = [(0, [1.0, 0.0, 0.0]), *tied, *[(i, [0.5, float(i), 0.0]) for i in range(300, 400)]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(table, table.where("vec_id = 0"), relax=1.0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, 1.0) for i in range(1, 21)]


def test_trees_prune_and_keep_recall(monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 16)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 4000)] + 0.15 * rng.normal(size=(4000, 16))
    tree, order = neighbours.Tree.build(x)
    assert sorted(order.tolist()) == list(range(4000)) and (tree.vectors == x[order]).all() and len(tree.nodes) > 100
    q = x[::40]
    best = [set(np.argsort(-(x @ v), kind="stable")[:20].tolist()) for v in q]
    looked = []
    matmul = neighbours.Tree._visit
    monkeypatch.setattr(neighbours.Tree, "_visit", lambda self, node, active: (looked.append(len(active) * (self.nodes[int(node)][4] < 0)), matmul(self, node, active))[1])
    for relax, least, most in ((1.0, 1.0, 1.0), (1.1, 0.95, 1.0), (2.0, 0.5, 1.0)):
        looked.clear()
        query, row = tree.search(q, 20, relax)
        got = [set(order[row[query == i]].tolist()) for i in range(len(q))]
        recall = np.mean([len(a & b) / 20 for a, b in zip(got, best)])
        assert least <= recall <= most, (relax, recall)
        assert sum(looked) < len(q) * (tree.nodes[:, 4] < 0).sum()  # some leaves are skipped


def test_fewer_candidates_than_asked(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [3.0, 3.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, neighbours.nearest(table, table.where("vec_id = 0")).collect()))
    assert got == [(0, 1, 20, 9.0), (0, 2, 1, 4.0)]


# -- packing


def test_ids_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(packing.default_tokenizer())
    reference.encode_special_tokens = True
    rng = random.Random(1)
    texts = ["", " ", "a", "  two  spaces ", "it's we'll\n\n tab\t x", "é naïve ñ 你好 🙂 ½ ²", "<|endoftext|> a b c d e f g h i", "x\x1cy a b c d e f g h", "word nbsp a b c d e f g", prose(rng, 300), "a b c d e f g h\ni j k l", "\n a b c d e f g h i", "a b c d e f g h "]
    texts += ["".join(rng.choice(" \n\tabcé1½_'.,!🙂　") for _ in range(200)) for _ in range(200)]
    encoder = packing.Encoder(packing.default_tokenizer())
    for t in texts * 2:  # twice: from memory as well
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == reference.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("text", ["x" + " " * 1_200_000 + "y", " " * 2_000_000, "a\n" + "\n" * 1_100_000 + " b c", "\u2003 \t" * 400_000, "x" * 1_500_000, "é" + "\x85" * 5000 + "1"])
def test_ids_of_long_runs_equal_the_tokenizer(text):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.Encoder(path).encode(text), np.uint32).tolist() == want


def test_packing_emits_added_tokens(spark):
    import zlib

    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(packing.default_tokenizer())
    mark = "<|endoftext|>"
    texts = ["the " + mark + " token", mark, mark * 3, mark + "\n\n a b c d e f g h i " + mark, "a b c d e f g h i" + mark + " a b c d e f g h i", "<|endoftext| >", " " + mark + "  "]
    want = {}
    for i, t in enumerate(texts):
        ids = np.array(reference.encode(t, add_special_tokens=False).ids + [0], "<u4")
        want[i] = ids
    assert want[0].tolist() == [1169, 220, 50256, 11241, 0]
    got = packing.pack(docs(spark, *enumerate(texts))).collect()
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        assert r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes())


def test_packing_keeps_every_id_once(spark, monkeypatch):
    import zlib

    rng = random.Random(2)
    rows = [(i, prose(rng, rng.choice([0, 1, 5, 40, 300, 2500]))) for i in range(60)] + [(100, None), (None, "x"), (5, "again")]
    monkeypatch.setattr(packing, "POOL", 16)
    got = packing.pack(docs(spark, *rows)).collect()
    encoder = packing.Encoder(packing.default_tokenizer())
    want = Counter()
    pieces = defaultdict(list)
    for r in got:
        pieces[(r.doc_id, r.doc_tokens)].append(r)
    for doc, text in rows:
        want[(doc, len(encoder.encode(text or "")) // 4 + 1)] += 1
    assert {k: sum(r.length for r in v) for k, v in pieces.items()} == {k: k[1] * n for k, n in want.items()}
    texts = {d: t for d, t in rows if d != 5}
    for r in got:
        if r.doc_id in texts:
            ids = encoder.encode(texts[r.doc_id] or "") + b"\0\0\0\0"
            assert r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at == own[0].window <= 1024 and at & (at - 1) == 0
    steps = Counter()
    for own in sequences.values():
        steps[own[0].step_group] += own[0].window
    assert max(steps.values()) <= 65536
    assert packing.pack(docs(spark)).count() == 0


def test_step_groups_are_full_whatever_the_partitions(spark):
    rng = random.Random(4)
    table = docs(spark, *[(i, prose(rng, rng.choice([3, 30, 90, 700]))) for i in range(400)])
    for parts in (1, 13):
        got = packing.pack(table.repartition(parts), step_tokens=4096).select("sequence_id", "window", "step_group").distinct().collect()
        assert len({r.sequence_id for r in got}) == len(got)
        tokens, tiers = Counter(), defaultdict(set)
        for r in got:
            tokens[r.step_group] += r.window
            tiers[r.window].add(r.step_group)
        assert sum(map(len, tiers.values())) == len(tokens)  # no group has two tiers
        for window, groups_ in tiers.items():
            assert all(tokens[g] == 4096 for g in sorted(groups_)[:-1]) and tokens[max(groups_)] <= 4096
