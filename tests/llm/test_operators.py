"""Each operator against a brute-force version, on small tables with nulls, empty texts, ties, repeats and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard_join, mixing, quality_classifier, quality_rules, sharding, suffix_dedup, token_output, url_filters, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = {c: c + 32 for c in range(65, 91)}


def make_rows(seed: int = 1, n: int = 60) -> list[tuple]:
    """Texts that share passages and copies, with every odd case among them."""
    rng = random.Random(seed)
    vocabulary = [f"{rng.choice('abcdefgh')}{rng.choice(['an', 'or', 'el'])}{i}" for i in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    rows, texts = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        kind = rng.random()
        if kind < 0.2 and texts:
            words = rng.choice(texts).split() or ["x"]
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        text = " ".join(words)
        if kind > 0.8:
            text += "\n" + passage + "\nlast line\nlast line"
        texts.append(text)
        rows.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None]), len(text)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "a", 0), (n + 2, " \n\t", "en", "a", 3), (n + 3, "Ab C", "en", "b", 4), (n + 4, "aB c", "fr", "b", 4)]
    return rows


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, a null id, one long text, and columns named like results."""
    rows = [*ROWS[:6], ROWS[0], ROWS[0], (None, "a null id", "en", "a", 9), (7, "other text of a repeated id", "en", "b", 5), (7, "other text of a repeated id too", "en", "b", 5), (8, "word " * 30000, "en", "a", 1)]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS + ", size int, score string").withColumn("shard", F.lit(3)).withColumn("host", F.lit("h")).withColumn("kept", F.lit("k"))


# --- 1


def test_classifier_separates_and_ignores_labels_of_the_held_out(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        words = [rng.choice(["lorem", "ipsum", "dolor", "amet", "sit", "et"]) + rng.choice("abcdefghij") for _ in range(rng.randint(30, 80))]
        rows.append((i, " ".join(words) + "." if good else " | ".join(words).upper() + "###"))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = quality_classifier.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).toPandas()
    assert (one.held_out == one.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    held = one[one.held_out]
    assert (held.predicted == held.doc_id.map(lambda d: int(d % 4 != 0))).all()
    flipped = [(d, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q) for d, q in labels]
    two = quality_classifier.classify(docs, spark.createDataFrame(flipped, "doc_id long, quality int")).toPandas()
    assert np.allclose(one.sort_values("doc_id").score, two.sort_values("doc_id").score)


def test_classifier_scores_as_plain_densities_do(spark):
    rng = np.random.default_rng(3)
    kinds = rng.integers(0, 2, 400)
    x = rng.normal(0, 1 + kinds[:, None] * 0.5, (400, len(quality_classifier.NAMES))) + kinds[:, None] * 0.7
    x[:, 1] += x[:, 0]
    folds = np.arange(400) % 4 + 1
    rows = spark.createDataFrame(pd.DataFrame(x, columns=quality_classifier.NAMES).assign(label=kinds, fold=folds))

    def plain(shrinkage, known, at):
        """Log odds by full covariances and their inverses."""
        out = np.zeros(len(at))
        pooled = sum(np.cov(x[known & (kinds == k)].T, bias=True) * (known & (kinds == k)).sum() for k in (0, 1)) / known.sum()
        for k, sign in ((0, -1), (1, 1)):
            own = x[known & (kinds == k)]
            cov = (1 - shrinkage.pooled) * np.cov(own.T, bias=True) + shrinkage.pooled * pooled
            cov = (1 - shrinkage.diagonal) * cov + shrinkage.diagonal * np.diag(np.diag(cov)) + shrinkage.floor * np.eye(len(cov))
            d = at - own.mean(axis=0)
            out += sign * (np.log(len(own)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
        return out

    def loss(shrinkage):
        odds = np.concatenate([plain(shrinkage, folds != f, x[folds == f]) for f in range(1, 5)])
        sign = np.concatenate([kinds[folds == f] * 2 - 1 for f in range(1, 5)])
        return np.log1p(np.exp(-odds * sign)).sum()

    model = quality_classifier.fit(rows)
    best = min(quality_classifier.CHOICES, key=loss)
    assert model.shrinkage == best
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(-plain(best, np.ones(400, bool), x))))


def test_classifier_edge_cases(spark, docs, odd, empty):
    labels = spark.createDataFrame([(0, 1), (1, None), (None, 1)], "doc_id long, quality int")
    out = quality_classifier.classify(docs, labels).toPandas()
    assert len(out) == len(ROWS) and out.score.between(0, 1).all()
    assert quality_classifier.classify(odd, labels).count() == odd.count()
    assert quality_classifier.classify(empty, labels).count() == 0
    assert quality_classifier.classify(docs, labels.limit(0)).filter("score <> 0.5").count() == 0


# --- 2


def test_decontamination_finds_edited_copies_and_no_others(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(2000)] + ["the", "of", "and"] * 200
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(15, 50)))) for i in range(20)]
    rows, dirty = [], set()
    for i in range(200):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        if i % 4 == 0:
            copy = [w if rng.random() > 0.1 else rng.choice(vocabulary) for w in items[i % 20][1].upper().split()]
            words[5:5] = copy
            dirty.add((i, i % 20))
        rows.append((i, " ".join(words)))
    rows += [(300, None), (301, "")]
    found = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*items, (90, None), (91, ""), (92, "tiny item")], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == dirty


def test_decontamination_finds_every_edited_copy_beside_an_exact_one(spark):
    rng = random.Random(11)
    items = [[f"w{rng.randrange(5000)}" for _ in range(rng.randint(16, 59))] for _ in range(60)]
    rows, wanted = [], set()
    for i, item in enumerate(items):
        for k in range(6):
            copy = [w if k == 0 or rng.random() > 0.2 else f"x{rng.randrange(10**6)}" for w in item]
            rows.append((6 * i + k, " ".join(copy)))
            kept = any(copy[j : j + 4] == item[j : j + 4] for j in range(len(item) - 3))
            a, b = (np.array([[int(w[1:]) + (10**7 if w[0] == "x" else 2) for w in words]]) for words in (item, copy))
            if kept and decontaminate.align(a, b)[0][0] >= len(item):
                wanted.add((6 * i + k, i))
    tables = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(*tables).collect()} == wanted


def test_decontamination_equals_alignment_of_all_pairs(spark):
    rng = random.Random(31)
    common = [f"c{i}" for i in range(30)]
    items = [[rng.choice(common) if rng.random() < 0.3 else f"w{rng.randrange(4000)}" for _ in range(rng.randint(6, 40))] for _ in range(25)]
    docs = []
    for i in range(150):
        words = [rng.choice(common) if rng.random() < 0.3 else f"v{rng.randrange(4000)}" for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            copy = []
            for w in rng.choice(items):
                kind = rng.random()
                copy += [w] if kind > 0.3 else [w, *(f"x{rng.randrange(99)}" for _ in range(rng.randint(1, 3)))] if kind > 0.15 else [] if kind > 0.08 else ["z"]
            words[len(words) // 2 : len(words) // 2] = copy
        docs.append(words)
    code = {w: i + 2 for i, w in enumerate(sorted({w for x in items + docs for w in x}))}
    grams = lambda words: {tuple(words[i : i + 4]) for i in range(len(words) - 3)}
    score, seeded = {}, set()
    for d, words in enumerate(docs):
        for i, item in enumerate(items):
            if words:
                best = decontaminate.align(np.array([[code[w] for w in item]]), np.array([[code[w] for w in words]]))[0][0] / (2 * len(item))
                if best >= 0.5:
                    score[d, i] = best
                    if grams(item) & grams(words):
                        seeded.add((d, i))
    found = decontaminate.matches(spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.score for r in found.collect()}
    assert set(got) == seeded and all(abs(got[k] - score[k]) < 1e-9 for k in got)
    assert len(seeded) >= 0.9 * len(score) > 20


def test_a_phrase_that_many_items_share_is_no_seed(spark):
    rng = random.Random(5)
    phrase = "which of the following"
    items = [(f"q{i}", f"{phrase} " + " ".join(f"w{rng.randrange(9000)}" for _ in range(rng.randint(14, 30)))) for i in range(40)]
    docs = [(f"d{d}", " ".join(f"v{rng.randrange(9000)}" for _ in range(30)) + f" {phrase} v1 v2") for d in range(200)] + [("copy", "some words before " + items[7][1])]
    docs, items = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string")
    known = decontaminate.item_grams(items, 4)
    name = known.groupBy("gram").count().filter("count = 40").first()["gram"]
    counted = decontaminate.gram_counts(docs, decontaminate.bitmap(known, F.col("gram")), 4, [])
    assert {r.gram: r.n for r in counted.filter(F.col("gram") == name).collect()} == {name: 201}
    seeds = decontaminate.rare_seeds(known, counted)
    per_item = {r.item_id: (r.seeds, r.all) for r in seeds.groupBy("item_id", F.size("words").alias("all")).agg(F.count("*").alias("seeds")).collect()}
    assert seeds.filter(F.col("gram") == name).count() == 0 and all(n == size - 3 - (size - 3) // 12 for n, size in per_item.values())
    assert [(r.doc_id, r.item_id, r.score) for r in decontaminate.matches(docs, items).collect()] == [("copy", "q7", 1.0)]


@pytest.mark.parametrize("edits", [0.1, 0.15, 0.2, 0.25])
def test_recall_of_edited_copies_beside_exact_ones_and_in_groups(spark, edits):
    """Copies of which words are replaced, each there five times, so that what they keep is more common than what they lost."""
    rng = random.Random(int(edits * 100))
    items = [[f"w{rng.randrange(5000)}" for _ in range(rng.randint(16, 59))] for _ in range(60)]
    rows, wanted, findable = [], set(), set()
    for i, item in enumerate(items):
        rows += [(1000 + 3 * i + k, " ".join(item)) for k in range(3)]
        copy = [w if rng.random() > edits else f"x{rng.randrange(10**6)}" for w in item]
        rows += [(10_000 + 5 * i + k, f"before{k} " + " ".join(copy)) for k in range(5)]
        exact, edited = {(1000 + 3 * i + k, i) for k in range(3)}, {(10_000 + 5 * i + k, i) for k in range(5)}
        a, b = (np.array([[int(w[1:]) + (10**7 if w[0] == "x" else 2) for w in words]]) for words in (item, copy))
        keeps_a_run = any(copy[j : j + 4] == item[j : j + 4] for j in range(len(item) - 3))
        wanted |= exact | edited
        findable |= exact | (edited if keeps_a_run and decontaminate.align(a, b)[0][0] >= len(item) else set())
    tables = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(*tables).collect()}
    assert found <= findable and len(found) >= 0.97 * len(findable) and len(found) >= 0.9 * len(wanted)


def test_decontamination_finds_short_items_and_scripts_without_spaces(spark):
    han, thai = "山川日月水火木金土天地人", "กขคงจฉชซ"
    items = [(1, "quick Brown fox"), (2, "zyzzyva"), (3, han), (4, "two words"), (5, thai), (6, "山川")]
    docs = [
        (1, "the quick, brown fox ran home today"), (2, "quick brown fox"), (3, "a zyzzyva here and - more words"), (4, "quick brown dog fox and more"), (5, "前文前文" + han + "後文、後文"),
        (6, "two - words of few"), (7, "x y " + "ดต" + thai + "ถ"), (8, "quick brown"), (9, "fox"), (10, "two"), (11, "words quick"), (12, "brown fox ran"),
    ]
    found = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (2, 1), (3, 2), (5, 3), (5, 6), (6, 4), (7, 5)}


def test_alignment_scores_as_a_plain_table_does():
    def plain(a, b):
        h, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
                best = max(best, h[i, j])
        return best

    rng = np.random.default_rng(4)
    a, b = rng.integers(2, 8, (30, 12)), rng.integers(2, 8, (30, 25))
    assert list(decontaminate.align(a, b)[0]) == [plain(x, y) for x, y in zip(a, b, strict=True)]


def test_decontamination_edge_cases(spark, odd, empty):
    items = spark.createDataFrame([(1, ROWS[0][1])], "item_id long, text string")
    assert decontaminate.clean(odd, items).columns == odd.columns
    assert decontaminate.clean(odd, items).filter("doc_id = 0").count() == 0
    assert decontaminate.matches(empty, items).count() == 0
    assert decontaminate.matches(odd, items.limit(0)).count() == 0


# --- 3


def targets_by_hand(sizes: dict, weights=(5, 2, 1)) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, out = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in out]
        level = (budget - sum(out.values())) / max(1e-9, sum(weight[s] for s in rest))
        over = [s for s in rest if level * weight[s] > 2 * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in rest}
        out |= {s: 2.0 * sizes[s] for s in over}


def test_mixing_targets_and_copies(docs):
    out = mixing.copies(docs).toPandas()
    sizes: dict = defaultdict(int)
    for _, text, _, source, _ in ROWS:
        sizes[source] += len(re.findall(WORD, text or ""))
    wanted = targets_by_hand(sizes)
    out["source"] = out.source.astype(object).where(out.source.notna(), None)
    for source, part in out.groupby("source", dropna=False):
        source = None if source != source else source
        assert part["size"].sum() == sizes[source] == part.source_size.iloc[0]
        assert abs(part.target.iloc[0] - wanted[source]) < 1e-3
        assert abs((part["size"] * part.n_copies).sum() - wanted[source]) <= part["size"].max() + 1
    assert out.n_copies.between(0, 2).all() and len(out) == len(ROWS)
    pd.testing.assert_frame_equal(out.sort_values("doc_id", ignore_index=True), mixing.copies(docs).toPandas().sort_values("doc_id", ignore_index=True), check_dtype=False)


def test_mix_repeats_rows_as_the_copies_say(docs, odd, empty):
    taken = {r.doc_id: r.n_copies for r in mixing.copies(docs).collect()}
    assert Counter(r.doc_id for r in mixing.mix(docs).collect()) == Counter({k: v for k, v in taken.items() if v})
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == mixing.copies(odd).agg(F.sum("n_copies")).first()[0]
    assert mixing.mix(empty).count() == 0


# --- 4


def components_by_hand(rows, n, percent):
    sets = []
    for _, text, *_ in rows:
        w = re.findall(WORD, (text or "").translate(UPPER))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    least: dict = {}
    for i, row in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 1 << 60), row[0])
    return {row[0]: (len(sets[i]), least[find(i)]) for i, row in enumerate(rows)}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_join_components(docs, n, percent):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link(docs, n, percent).collect()}
    assert found == components_by_hand(ROWS, n, percent)


def test_join_of_many_near_copies_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "WEIGHT", 150)
    rng = random.Random(6)
    rows = []
    for _ in range(3):
        base = [f"w{rng.randint(0, 500)}" for _ in range(60)]
        for _ in range(40):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                words[rng.randrange(60)] = f"x{rng.randint(0, 9999)}"
            rows.append((len(rows), " ".join(words)))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == components_by_hand(rows, 3, 90)


def test_links_come_from_tries(spark, docs, monkeypatch):
    """Without the tries' links no two different sets are in one component; with them, all are that should be."""
    want = components_by_hand(ROWS, 3, 90)
    linked = len(want) - len({c for _, c in want.values()})
    monkeypatch.setattr(jaccard_join, "trie_links", lambda rows, percent: pd.DataFrame({"a": [], "b": []}, dtype="int64"))
    alone = {r.doc_id: r.component_id for r in jaccard_join.link(docs).collect()}
    sets = {}
    for doc_id, text, *_ in ROWS:
        words = tuple(re.findall(WORD, (text or "").translate(UPPER)))
        sets.setdefault(frozenset(words[i : i + 3] for i in range(max(1, len(words) - 2))) if words else doc_id, []).append(doc_id)
    assert alone == {d: min(group) for group in sets.values() for d in group}
    assert linked > len(want) - len(sets)


@pytest.mark.parametrize(("n", "percent", "size"), [(3, 90, 11), (5, 80, 8), (1, 50, 1), (3, 90, 29)])
def test_join_of_a_text_and_the_same_with_one_word_more(spark, n, percent, size):
    rows = []
    for i in range(20):
        words = [f"t{i}w{j}" for j in range(size + 1)]
        rows += [(2 * i, " ".join(words[:-1])), (2 * i + 1, " ".join(words))]
    out = jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()
    assert {r.doc_id: r.component_id for r in out} == {d: d - d % 2 for d, _ in rows}


def test_one_of_each(docs, odd, empty):
    kept = {r.doc_id for r in jaccard_join.one_of_each(docs).collect()}
    assert kept == {d for d, (size, c) in components_by_hand(ROWS, 5, 80).items() if size == 0 or c == d}
    out = jaccard_join.one_of_each(odd)
    assert out.columns == odd.columns and out.filter("doc_id = 0").count() == 1
    assert jaccard_join.one_of_each(empty).count() == 0


def test_stages_go_by_row_where_doc_ids_are_null_or_repeated(spark):
    rng = random.Random(13)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    item, twins, other, nulls = text(), text(), text(), text()
    rows = [
        (None, item + " and more"), (None, other), (7, item), (7, other + " own"), (8, text()),
        (3, twins), (3, twins + " more"), (None, nulls), (None, nulls + " more"), (9, ""), (9, ""), (9, None), (5, "same text twice"), (5, "same text twice"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = decontaminate.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert Counter(map(tuple, clean.collect())) == Counter(r for r in rows if not (r[1] or "").startswith(item))
    # Copies in a component: one row each, with a doc_id where there is one.  Texts without words all stay.
    kept = [tuple(r) for r in jaccard_join.one_of_each(docs).collect()]
    starts = lambda x: sum((t or "").startswith(x) for _, t in kept)
    assert [starts(x) for x in (item, twins, other, nulls, "same")] == [1] * 5 and len(kept) == 9
    assert (7, item) in kept and (7, other + " own") in kept and kept.count((9, "")) == 2


# --- 5


def test_url_rules(spark):
    rows = [
        (1, "https://A.Example.NET/en/1?x"), (2, "http://example.net/de/"), (3, "http://net"), (4, "http://x.net?q"), (5, "ftp://b.example.com/de/x#y"), (6, "http://myexample.com/de/x"),
        (7, "http://fr.org/fr/a"), (8, "http://fr.org/frx"), (9, None), (10, "no scheme"), (11, "http://m.ads-track.example.com/en/1"), (12, "http://a.com/p?phpsessid=1"), (13, "http://a.com/p?b=1&phpsessid=1"), (14, "http://a.com/xphpsessid=1"), (1, "https://A.Example.NET/en/1?x"), (15, "://"),
        (16, "http://evil.com?x.net/"), (17, "http://a.org?u=b.example.com/de/x"), (18, "http://a.org#z.net/"), (19, "http://www.free-bets.org/x"), (20, "http://a.org/?free-bets."),
    ]
    out = url_filters.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")))
    found = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect())
    assert found[(1, "a.example.net", "/en/1", "example.net/en/", "allow")] == 2
    rest = {k[0]: k[1:] for k in found}
    assert rest[2] == ("example.net", "/de/", "net/", "block")
    assert rest[3] == ("net", "", None, "allow") and rest[4] == ("x.net", "", None, "allow")
    assert rest[5] == ("b.example.com", "/de/x", "example.com/de/", "block") and rest[6][2:] == (None, "allow")
    assert rest[7][2:] == ("org/fr/", "allow") and rest[8][2:] == (None, "allow")
    assert rest[9] == ("", "", None, "allow") and rest[10] == ("", "", None, "allow") and rest[15] == ("", "", None, "allow")
    assert [rest[i][2:] for i in (11, 12, 13, 14)] == [(None, "block")] * 3 + [(None, "allow")]
    assert [rest[i][2:] for i in (16, 17, 18, 19, 20)] == [(None, "allow")] * 3 + [(None, "block"), (None, "allow")]
    assert out.count() == len(rows)
    assert url_filters.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_rules_from_a_table(spark):
    rules = [("en", "||a.com/en/", "allow", "host"), ("end", "/x.html|", "block", "pattern"), ("any", "/p*q/", "block", "pattern"), ("sep", "||b.com^", "block", "pattern"), ("but", "||b.com^ok^", "allow", "pattern")]
    table = spark.createDataFrame(rules[:2] + rules[3:], url_filters.RULE_SCHEMA)
    got = {r.rule: (r.regex, sorted(r.tokens)) for r in url_filters.compiled(table).collect()}
    assert got["en"][1] == ["a", "com", "en"] and got["end"][1] == ["html", "x"] and got["sep"][1] == ["b", "com"]
    urls = ["http://b.com", "http://b.com/ok/1", "http://b.com:80/ok", "http://ab.com/", "http://c.com/x.html", "http://c.com/x.html?y", "http://b.comx/"]
    out = {r.url: r.verdict for r in url_filters.judge(spark.createDataFrame([(u,) for u in urls], "url string"), table).collect()}
    assert [out[u] for u in urls] == ["block", "allow", "block", "allow", "block", "allow", "allow"]
    with pytest.raises(ValueError, match="literal"):
        url_filters.judge(spark.createDataFrame([(1, "http://a")], "page_id long, url string"), spark.createDataFrame(rules[2:3], url_filters.RULE_SCHEMA))


@pytest.mark.parametrize("most", [0, 50_000])
def test_ten_thousand_rules_joined_by_shuffle_and_by_broadcast(spark, monkeypatch, most):
    """Host rules on 2,000 sites and their sections, and rules on words of a path, against trying every rule on every URL."""
    monkeypatch.setattr(url_filters, "BROADCAST_RULES", most)
    rng = random.Random(9)
    site = lambda: f"s{rng.randrange(2000)}.{rng.choice(['com', 'org'])}"
    hosts = {f"{site()}/" + (f"a{rng.randrange(40)}/" if rng.random() < 0.7 else ""): rng.choice(["block", "allow"]) for _ in range(9000)}
    words = {f"/w{i}/": "allow" if i % 7 == 0 else "block" for i in range(2500)}
    rules = [(h, f"||{h}", v, "host") for h, v in hosts.items()] + [(w, w, v, "pattern") for w, v in words.items()]
    assert len(rules) > 10_000
    urls = [f"http://{rng.choice(['', 'www.', 'x.y.'])}{site()}/a{rng.randrange(40)}/w{rng.randrange(5000)}/p" for _ in range(600)]

    def plain(url):
        host, _, path = url.removeprefix("http://").partition("/")
        labels = host.split(".")
        fits = [h for i in range(len(labels)) for k in (0, 1) if (h := ".".join(labels[i:]) + "/" + "/".join(path.split("/")[:k]) + "/" * k) in hosts]
        word = f"/{path.split('/')[1]}/"
        best = max(fits, key=len, default=None)
        return best, hosts[best] if best else words.get(word, "allow")

    out = url_filters.judge(spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame(rules, url_filters.RULE_SCHEMA))
    assert {(r.url, r.rule, r.verdict) for r in out.collect()} == {(u, *plain(u)) for u in urls}


# --- 6


def test_matrix_has_exact_sums_and_the_right_law():
    matrix = np.array(sharding.communication_matrix([5, 0, 100, 17], 8, 1))
    assert list(matrix.sum(axis=1)) == [5, 0, 100, 17] and set(matrix.sum(axis=0)) <= {15, 16}
    rng = np.random.default_rng(5)
    drawn = Counter(sharding.hypergeometric(rng, 4, 6, 5) for _ in range(20000))
    law = {0: 6 / 252, 1: 60 / 252, 2: 120 / 252, 3: 60 / 252, 4: 6 / 252}
    assert all(abs(drawn[k] / 20000 - p) < 0.015 for k, p in law.items())
    assert 0 <= sharding.hypergeometric(rng, 10**12, 10**13, 10**6) <= 10**6


def test_shards(docs, odd, empty):
    out = sharding.shard(docs).toPandas()
    counts = out.groupby("shard").size()
    assert len(out) == len(ROWS) and counts.max() - counts.min() <= 1
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    again = sharding.shard(docs).toPandas()
    assert out.set_index("doc_id")[["shard", "slot"]].sort_index().equals(again.set_index("doc_id")[["shard", "slot"]].sort_index())
    assert sharding.shard(odd).count() == odd.count() and sharding.shard(empty).count() == 0


def test_slots_and_shards_are_uniform(spark):
    """Chi-square of shard by block of the input, and of slot by block, over 20,000 rows."""
    out = sharding.shard(spark.range(20000).withColumnRenamed("id", "doc_id")).toPandas()
    out["from"], out["place"] = out.doc_id // 2000, out.slot // 250
    for column, kinds in (("shard", 8), ("place", 10)):
        table = np.zeros((10, kinds))
        np.add.at(table, (out["from"].to_numpy(), out[column].to_numpy()), 1)
        expected = table.sum(axis=0) / 10
        chi = ((table - expected) ** 2 / expected).sum()
        free = 9 * (kinds - 1)
        assert abs(chi - free) < 4.5 * np.sqrt(2 * free), column


# --- 7


def removed_by_hand(rows, length=100):
    seen, out = set(), {}
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if data[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(data[i : i + length])
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[doc_id] = (len(data), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_repeated_bytes(spark, docs):
    more = [(101, "ab" * 300), (102, "a" * 500), (103, "x" * 99), (104, "ab" * 100 + "Q" + "ab" * 80), (105, "é" * 120), (106, "x" * 100), (107, "x" * 99 + "y" + "x" * 100)]
    rows = [(r[0], r[1]) for r in ROWS] + more
    found = suffix_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == removed_by_hand(sorted(rows))


def test_repeated_bytes_edge_cases(odd, empty):
    out = suffix_dedup.remove(odd, texts=True).toPandas()
    assert len(out) == odd.count() and suffix_dedup.remove(empty).count() == 0
    assert sorted(out[out.doc_id == 0].n_removed) == [0] + [len(ROWS[0][1].encode())] * 2
    row = out[out.doc_id == 8].iloc[0]
    assert row.n_bytes == 150000 and row.n_removed == 150000 - 5 and len(row.kept) == 5 and len(row.spans) == 1


def test_repeated_bytes_of_texts_longer_than_a_segment(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    text = " ".join(word() for _ in range(400_000))
    assert len(text) > suffix_dedup.PIECE
    edge = suffix_dedup.PIECE
    rows = [(1, text), (2, text[edge - 500 : edge + 700] + "x" + text[50:400]), (3, "y" * 120 + text[edge - 60 : edge + 200]), (4, text[-300:])]
    found = suffix_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == removed_by_hand(rows)


def test_ranges_of_anchors_are_known_before_they_are_named(spark):
    from bisect import bisect_right

    rng = random.Random(23)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    texts = [" ".join(word() for _ in range(600)) for _ in range(150)] + ["x" * 60_000, "é" * 40, ""]
    docs = spark.createDataFrame([(i, 0, bytearray(t.encode())) for i, t in enumerate(texts)], "uid long, begin long, data binary")
    bounds = suffix_dedup.ranges(docs, 100, 40)
    rows = suffix_dedup.positions(docs, 100, 40, bounds).toPandas()
    keys = list(rows[["name", "rest", "uid", "spot"]].itertuples(index=False, name=None))
    assert len(bounds) == 3 and list(rows.part) == [bisect_right(bounds, k) for k in keys]
    # The run of one letter, which is two thirds of the rows, is cut like the others.
    assert sorted(keys) == sorted(suffix_dedup.positions(docs, 100, 40).toPandas().itertuples(index=False, name=None))
    assert rows.part.value_counts().max() < len(rows) / 2 and (rows.uid == 150).sum() > len(rows) / 2
    key = [(rng.randrange(-3, 3), rng.randrange(-2, 2), rng.randrange(3), rng.randrange(3)) for _ in range(500)]
    some = sorted({*key[:20], (0, -1, -(1 << 63), (1 << 63) - 1)})
    frame = pd.DataFrame(key, columns=["name", "rest", "uid", "spot"])
    assert list(suffix_dedup.part_of(frame, some, suffix_dedup.wide(*np.array(some).T))) == [bisect_right(some, k) for k in key]


def test_rows_whose_ranges_are_known_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def make(i):
        made.add(1)
        return (i // 300, i // 3, i % 50, i, 0)

    source = spark.sparkContext.parallelize(range(900), 3).map(make)
    rows = spark.createDataFrame(source, "a long, b long, c long, spot long, uid long").withColumn("part", F.col("a").cast("int"))
    got = {tuple(r) for r in suffix_dedup.rerank(rows, ["a"], ["b"], parts=3).collect()}
    assert made.value == 900
    assert got == {tuple(r) for r in suffix_dedup.rerank(rows.drop("part"), ["a"], ["b"]).collect()} and len(got) == 900


def test_ranks_are_dense_over_partitions(spark):
    rng = random.Random(22)
    rows = [(rng.randrange(40), rng.randrange(3), i // 7, i) for i in range(3000)]
    out = suffix_dedup.rerank(spark.createDataFrame(rows, "a long, b long, uid long, spot long").repartition(7), ["a"], ["b"]).collect()
    keys = {(uid, at): (a, b) for a, b, uid, at in rows}
    place = {k: i for i, k in enumerate(sorted(set(keys.values())))}
    outer = {a: i for i, a in enumerate(sorted({a for a, _ in keys.values()}))}
    seen = set()
    for r in sorted(out, key=lambda r: (r.uid, r.spot)):
        key = keys[r.uid, r.spot]
        assert (r.outer, r.inner, r.first) == (outer[key[0]], place[key], key not in seen)
        seen.add(key)
    assert len(out) == 3000


# --- 8


def base_by_hand(text):
    words = re.findall(WORD, text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if re.search(WORD, line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(repeated)


def test_base_counts(docs, odd, empty):
    for df in (docs, odd):
        texts = sorted((r.doc_id or -1, r.text or "") for r in df.collect())
        got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.apply(df).collect())
        assert got == sorted((d, *base_by_hand(t)) for d, t in texts)
    assert quality_rules.apply(empty).count() == 0
    assert quality_rules.keep(odd).columns == odd.columns
    kept = quality_rules.apply(docs).filter("kept").count()
    assert quality_rules.keep(docs).count() == kept


def test_fertility_is_that_of_whole_texts():
    text = "Ordinary words, and some more words. Éléments déjà vus ünd 漢字 words"
    vocab = quality_rules.vocabularies()
    row = quality_rules.measure([text, ""], vocab).iloc[0]
    ids = vocab.piece.encode(text)
    p = np.array(list(Counter(ids).values())) / len(ids)
    assert row.n_tokens == len(ids) and np.isclose(row.fallback_share, np.mean([vocab.piece.is_byte(i) for i in ids]))
    assert np.isclose(row.entropy_ratio, -(p * np.log2(p)).sum() / np.log2(len(ids)))


def test_kept_is_what_plain_bands_keep(spark, docs):
    """Both vocabularies on whole words, quartiles by sorting, fences by hand."""
    vocab, rows = quality_rules.vocabularies(), []
    for doc_id, text, lang, *_ in ROWS:
        words = re.findall(WORD, text or "")
        ids = [t for w in words for t in vocab.piece.encode(w)]
        n_bytes, chars, p = sum(len(vocab.byte.encode_ordinary(" " + w)) for w in words), sum(map(len, words)), np.array(list(Counter(ids).values()))
        values = {} if len(ids) < 2 else {
            "chars_per_piece": chars / len(ids), "chars_per_byte_token": chars / n_bytes, "fallback_share": float(np.mean([vocab.piece.is_byte(t) for t in ids])),
            "entropy_ratio": float(-(p / len(ids) * np.log2(p / len(ids))).sum() / np.log2(len(ids))),
        }
        rows.append((doc_id, lang, len(ids), values, base_by_hand(text)))
    want = {}
    for doc_id, lang, n, values, base in rows:
        ok = base[0] >= 10 and 100 * base[4] <= 20 * base[0]
        for m, band in quality_rules.BANDS.items() if values else ():
            of = sorted(v[m] for _, other, _, v, _ in rows if other == lang and v)
            q1, q3 = (of[int(np.ceil(q * len(of))) - 1] for q in (0.25, 0.75))
            wide = np.sqrt(1 + band.short / n)
            low = -np.inf if band.low is None else q1 - max((q3 - q1) * band.low, band.least) * wide
            high = np.inf if band.high is None else q3 + max((q3 - q1) * band.high, band.least) * wide
            ok = ok and low <= values[m] <= high
        want[doc_id] = ok
    assert {r.doc_id: r.kept for r in quality_rules.apply(docs).collect()} == want


def test_bands_reject_what_leaves_a_languages_range(spark):
    rng = random.Random(8)
    good = [(i, " ".join(rng.choice(["water", "house", "people", "little", "number", "sound", "great"]) + rng.choice(["", "s", "ed"]) for _ in range(60)), "en") for i in range(200)]
    bad = [(1000, " ".join("".join(rng.choice("ΞΨ鬱龘🀄𝕏") for _ in range(6)) for _ in range(60)), "en")]
    out = {r.doc_id: r.failed for r in quality_rules.apply(spark.createDataFrame(good + bad, "doc_id long, text string, lang string")).collect()}
    assert "fallback_share" in out[1000] and sum(bool(v) for k, v in out.items() if k < 1000) <= 2


def test_bands_reject_junk_words_and_keep_prose(spark):
    # 1000 texts of prose, with chars per byte token from 2.0 to 2.3 (quartiles near 2.11 and 2.19), and junk below.
    rng = random.Random(12)
    row = lambda i, per_byte, n, ratio=0.7: (i, "en", n, n, 0, n, 2.2 + rng.gauss(0, 0.04), per_byte, 0.0, ratio + rng.gauss(0, 0.03))
    good = [row(i, 2.15 + max(-0.15, min(0.15, rng.gauss(0, 0.06))), rng.choice([200, 600, 2000])) for i in range(1000)]
    junk = [row(2000 + i, 1.93, rng.choice([400, 700, 2000])) for i in range(20)]
    loops = [row(3000 + i, 2.15, 600, 0.35) for i in range(20)]
    schema = "doc_id long, lang string, n_words long, word_chars long, n_repeat_words long, n_tokens long, chars_per_piece double, chars_per_byte_token double, fallback_share double, entropy_ratio double"
    out = {r.doc_id: r.failed for r in quality_rules.judge(spark.createDataFrame(good + junk + loops, schema)).collect()}
    assert all(out[2000 + i] == ["chars_per_byte_token"] for i in range(20))
    assert all(out[3000 + i] == ["entropy_ratio"] for i in range(20))
    assert sum(bool(out[i]) for i in range(1000)) <= 10


# --- 9


def test_warc_round_trip(spark, tmp_path):
    rows = [(5, "http://a/\r\n%", "<p>é</p>"), (3, None, "<p>é</p>"), (4, "http://b", None), (2, "http://c", ""), (1, "u", "x" * 200000), (5, "http://a/\r\n%", "<p>é</p>"), (None, "n", "lonely")]
    path = str(tmp_path / "warc")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)), path)
    got = warc.read(spark, path).collect()
    assert Counter((r.page_id, r.url) for r in got) == Counter((r[0], r[1]) for r in rows)
    for r in got:
        payload = next((h or "").encode() for i, u, h in rows if i == r.page_id and u == r.url)
        assert r.payload_bytes == len(payload) and r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first = min((i for i, _, h in rows if (h or "").encode() == payload and i is not None), default=None)
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first else ("revisit", first))
        assert r.record_type == "revisit" or bytes(r.payload) == payload
    import zstandard

    for file in (tmp_path / "warc").rglob("part-*"):
        data = file.read_bytes()
        assert data[:4] == b"\x5d\x2a\x4d\x18"
        size = int.from_bytes(data[4:8], "little")
        book = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        assert zstandard.ZstdDecompressor(dict_data=book).stream_reader(data[8 + size :]).read(8) == b"WARC/1.1"


def test_warc_urls_stand_as_they_are(spark, tmp_path):
    """Archives read by nothing but a Zstandard library: the dictionary is the first frame's content."""
    urls = ["http://a/%20x?q=%C3%A9", "", " lead and trail ", "tab\t\x0b", "é:// ü#", "http://b/%0D%250A", "line\r\nends"]
    path = str(tmp_path / "warc")
    warc.write(spark.createDataFrame([(i, u, f"<p>{i}</p>" * 50) for i, u in enumerate(urls)], "page_id long, url string, html string"), path)
    found = {}
    for file in (tmp_path / "warc").rglob("part-*"):
        data = file.read_bytes()
        end = 8 + int.from_bytes(data[4:8], "little")
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:end])).stream_reader(data[end:], read_across_frames=True)
        for record in reader.read().split(b"WARC/1.1\r\n")[1:]:
            fields = dict(line.split(b": ", 1) for line in record.partition(b"\r\n\r\n")[0].split(b"\r\n"))
            found[int(fields[b"WARC-Record-ID"][12:-1])] = fields[b"WARC-Target-URI"].decode()
    assert [found[i] for i in range(len(urls))] == [*urls[:-1], "line%0D%0Aends"]
    assert {r.page_id: r.url for r in warc.read(spark, path).collect()} == dict(enumerate(urls))


def test_warc_archives_are_of_bounded_size(spark, tmp_path):
    rows = [(i, f"http://a/{i}", f"page {i} " * 100) for i in range(200)] + [(500, "u", "long " * 20000)]
    path = str(tmp_path / "many")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), path, archive_bytes=20000)
    files = sorted((tmp_path / "many").rglob("part-*"))
    assert len(files) > 8 and len({f.parent for f in files}) > 4
    for file in files:
        assert sum(r[2] for r in list(warc.parse(file.read_bytes()))[:-1]) < 20000
    assert Counter((r.page_id, bytes(r.payload).decode()) for r in warc.read(spark, path).collect()) == Counter((i, h) for i, _, h in rows)


def test_warc_small_payloads_and_empty_table(spark, tmp_path):
    rows = [(1, "a", "abc"), (2, "b", "abc"), (3, "c", "d" * 50), (4, "d", "d" * 50)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"), least_bytes=10)
    assert {r.page_id: r.refers_to for r in warc.read(spark, str(tmp_path / "w"), payloads=False).collect()} == {1: None, 2: None, 3: None, 4: 3}
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0


# --- 10


def test_token_files(spark, docs, odd, empty, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_output.word_bpe_path())
    start = 0
    token_output.write(docs, str(tmp_path / "t"))
    got = {r.doc_id: tuple(r)[1:] for r in token_output.digests(spark, str(tmp_path / "t")).collect()}
    for doc_id, text, *_ in sorted(ROWS):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert got[doc_id] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    token_output.write(odd, str(tmp_path / "o"))
    assert token_output.digests(spark, str(tmp_path / "o")).count() == odd.count()
    token_output.write(empty, str(tmp_path / "e"))
    assert token_output.digests(spark, str(tmp_path / "e")).count() == 0


def test_word_encoder_equals_the_tokenizer_on_odd_texts():
    encoder = token_output.encoder(token_output.word_bpe_path())
    rng = random.Random(9)
    alphabet = "aAbB.,!#'’sİıßΣσςéÉ́̈ñ Ⅷ1२٣?\t\n\x1c\x1f 漢😀ﬁÅ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(3000)] + ["<|endoftext|> x<|startoftext|>.", "don't we're.", ""]
    ids, n = encoder.texts(texts)
    for text, got in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert list(got) == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_runs_are_cut_from_the_bytes_of_a_column():
    import pyarrow as pa

    codes, counts, found = token_output.runs(pa.array(["The the, THE.\nthe", None, "", " \t", "thé!the", "a\0b a\0c"]))
    assert [found[c] for c in codes] == ["the", "the", ",", "the", ".", "the", "thé", "!", "the", "a\0b", "a\0c"]
    assert list(counts) == [6, 0, 0, 0, 3, 2]
    encoder = token_output.encoder(token_output.word_bpe_path())
    rng = random.Random(10)
    alphabet = [*"aZé×÷ñÀß,.!-_(#'’sS1²ª \n\x1c\x85\xa0\0", "̸", "́", "=", "漢", "<|", "|>", "STARTOFTEXT", "endoftext", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts[7] = texts[9] = None
    ids, n = encoder.column(pa.array(texts, pa.string())[5:])
    for text, got in zip(texts[5:], np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert list(got) == [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
    assert [len(x) for x in encoder.column(pa.array([], pa.string()))] == [0, 0]


def test_token_file_layout(docs, tmp_path):
    import pyarrow.parquet as pq

    token_output.write(docs, str(tmp_path / "t"))
    meta = pq.ParquetFile(next((tmp_path / "t").glob("part-*.parquet"))).metadata
    columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in str(columns["ids.list.element"].encodings)
    assert all(c.has_offset_index for c in columns.values())


# --- clashing columns

#: Names that the operators use inside, or have used.
INSIDE = (
    "row key hash copy part first second third place block start n rows k id id_ source_ size size_ rank tie count cuts chunk parts subject host other path rule verdict cid comp node name rest uid spot "
    "outer inner at low high open reach gram grams words passage fold label score doc _n _rows _id _size _k _copy _src _sz _row _part _first _cuts _start _place _block _keep _dirty _key _kept _rest _subject _host"
).split()


@pytest.mark.parametrize("half", [0, 1])
def test_columns_of_any_name_come_through(spark, half):
    own = [c for c in INSIDE if c not in ("host", "path", "rule", "verdict")][half::2]
    wide = spark.createDataFrame([(*r, *(f"{c}{r[0]}" for c in own)) for r in ROWS[:25]], DOCS + "".join(f", `{c}` string" for c in own))
    items = spark.createDataFrame([(1, ROWS[3][1])], "item_id long, text string")
    found = {
        "mix": mixing.mix(wide),
        "shard": sharding.shard(wide).drop("shard", "slot"),
        "one_of_each": jaccard_join.one_of_each(wide),
        "clean": decontaminate.clean(wide, items),
        "keep": quality_rules.keep(wide),
        "judge": url_filters.judge(wide.withColumn("url", F.lit("http://a.net/"))).drop("url", "host", "path", "rule", "verdict", "pattern_rule"),
    }
    want = {r["doc_id"]: tuple(r) for r in wide.collect()}
    for name, out in found.items():
        assert out.columns == wide.columns, name
        rows = out.collect()
        assert rows and all(tuple(r) == want[r["doc_id"]] for r in rows), name
    for out in (suffix_dedup.remove(wide), jaccard_join.link(wide), quality_rules.apply(wide), token_output.tokenise(wide), mixing.copies(wide), decontaminate.matches(wide, items)):
        assert out.count() <= len(want)


def test_ids_may_be_texts(spark, docs, tmp_path):
    """Each operator gives for ids that are texts what it gives for numbers."""
    rows = [(*r[:4], r[4]) for r in ROWS]
    named = spark.createDataFrame([(f"d{r[0]:05}", *r[1:]) for r in rows], DOCS.replace("doc_id long", "doc_id string"))
    same = lambda of: sorted((str(r[0])[1:].lstrip("0") or "0", *r[1:]) for r in of(named).collect()) == sorted((str(r[0]), *r[1:]) for r in of(docs).collect())
    assert same(lambda d: mixing.copies(d).select("doc_id", "size", "n_copies"))
    assert same(lambda d: suffix_dedup.remove(d))
    assert same(lambda d: quality_rules.apply(d).select("doc_id", "n_words", "n_repeat_words", "kept"))
    token_output.write(docs, str(tmp_path / "n"))
    token_output.write(named, str(tmp_path / "s"))
    assert same(lambda d: token_output.digests(spark, str(tmp_path / "sn"[d is docs]), "bigint" if d is docs else "string"))
    items = spark.createDataFrame([(f"i{i}", r[1]) for i, r in enumerate(ROWS[:5])], "item_id string, text string")
    assert same(lambda d: decontaminate.matches(d, items))
    assert mixing.mix(named).columns == decontaminate.clean(named, items).columns == quality_rules.keep(named).columns == named.columns


def test_equal_rows_in_very_many_are_dealt_by_number(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MANY", 20)
    rows = spark.createDataFrame([(1, "same")] * 90 + [(2, "other")] * 3 + [(i, "own") for i in range(10, 50)], "doc_id long, text string")
    out = sharding.shard(rows).toPandas()
    counts = out.groupby("shard").size()
    assert len(out) == 133 and counts.max() - counts.min() <= 1 and (out.doc_id == 1).sum() == 90
    assert all(sorted(part.slot) == list(range(len(part))) for _, part in out.groupby("shard"))


def test_mixing_many_rows_that_are_alike(spark):
    rows = spark.createDataFrame([(1, "a b c", "s")] * 40 + [(None, "d e", None)] * 30 + [(i, "f g h i", "t") for i in range(5, 25)], "doc_id long, text string, source string")
    taken = mixing.copies(rows).groupBy("doc_id").agg(F.sum("n_copies").alias("n")).collect()
    assert Counter(r.doc_id for r in mixing.mix(rows).collect()) == Counter({r.doc_id: r.n for r in taken if r.n})


# --- the pipeline


def test_pipeline_stages_keep_columns_and_clean_documents(spark, docs, tmp_path):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    folder = tmp_path / "sf"
    docs.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, ROWS[3][1])], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    current = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, str(folder))
        assert current.columns == docs.columns
    out = corpus_pipeline.run(spark, str(folder))
    assert {"doc_id", "shard", "slot"} <= set(out.columns)
    good = {r.doc_id for r in quality_rules.apply(docs).filter("kept").collect()}
    rows = [r for r in ROWS if r[0] in good]
    first = {d for d, (size, c) in components_by_hand(rows, 5, 80).items() if size == 0 or c == d}
    kept = docs.filter(F.col("doc_id").isin(list(first)))
    dirty = {r.doc_id for r in decontaminate.matches(kept, spark.read.parquet(str(folder / "benchmark.parquet"))).collect()}
    taken = {r.doc_id: r.n_copies for r in mixing.copies(kept.filter(~F.col("doc_id").isin(list(dirty)))).collect()}
    assert Counter(r.doc_id for r in out.collect()) == Counter({k: v for k, v in taken.items() if v})


def test_pipeline_on_the_odd_and_the_empty_table(spark, odd, empty, tmp_path):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    for name, df in (("odd", odd), ("empty", empty)):
        folder = tmp_path / name
        df.write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(1, ROWS[3][1]), (2, None), (None, "")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        current = spark.read.parquet(str(folder / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES:
            after = stage(spark, current, str(folder))
            assert set(df.columns) <= set(after.columns)
            assert after.count() <= 2 * max(1, current.count())
            current = after
        assert (current.count() > 0) == (name == "odd")
