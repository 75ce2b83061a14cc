"""Near-duplicates, repeated passages, leaks and classifiers against brute force and held-out labels."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtside.llm import decontaminate, near_dedup, quality_fm, substring_dedup, toxicity
from courtside.llm.common import WORD, components, hashed_words, words_of
from courtside.llm.queries import QUERIES
from llm.llm_fixtures import EDGES, SF, documents, edited, fold, prose


def classes_of(links, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(250)] + [(1000, 1000 + k) for k in range(1, 300)] + [(2000 + k, 2001 + k) for k in range(60)]
    found = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert found == classes_of(edges, nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b):
            row[k + 1], last = (last + 1 if x == y else max(row[k + 1], row[k])), row[k + 1]
    return row[-1]


def test_alignment_is_exact_above_the_threshold():
    r = np.random.default_rng(4)
    for _ in range(300):
        a = r.integers(0, r.integers(3, 60), r.integers(1, 60)).astype(np.uint64)
        b = list(a)
        for _ in range(r.integers(0, 8)):
            k = int(r.integers(0, len(b) + 1))
            b[k : k + int(r.integers(0, 3))] = list(r.integers(0, 60, r.integers(0, 3)).astype(np.uint64))
        b = np.array(b, np.uint64)
        if not len(b):
            continue
        m = subsequence(a.tolist(), b.tolist())
        true = m / (len(a) + len(b) - m)
        found = near_dedup.similarity(a, b)
        assert found == true if true >= 0.8 else found < 0.8


def true_classes(texts):
    """Brute force over all pairs of different word sequences."""
    sequences = {}
    for doc_id, text in texts:
        if words_of(text):
            sequences.setdefault(tuple(words_of(text)), []).append(doc_id)
    values = {w: near_dedup.shingles(near_dedup.word_hashes(" ".join(w))) for w in sequences}
    by = defaultdict(set)
    for w, v in values.items():
        for x in set(v.tolist()):
            by[x].add(w)
    pairs = Counter((a, b) for group in by.values() if len(group) < 60 for a in group for b in group if a < b)
    links = [(a, b) for (a, b), n in pairs.items() if n > 0.6 * min(len(values[a]), len(values[b])) and near_dedup.similarity(values[a], values[b]) >= 0.8]
    roots = classes_of(links, list(sequences))
    out = defaultdict(set)
    for w, ids in sequences.items():
        out[roots[w]].update(ids)
    return {i: min(x for x in group if x is not None) for group in out.values() for i in group if i is not None}


def test_near_duplicates_query(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = {r["doc_id"]: r["class_id"] for r in QUERIES["op1_near_dedup"](spark, SF).collect()}
    expected = true_classes(texts)
    assert {i: expected.get(i, i) for i, _ in texts} == found


def near_texts():
    base = prose(1, 150)
    r = random.Random(2)
    texts = [(k, prose(50 + k, 120)) for k in range(30)] + [(100, base)]
    texts += [(101 + k, edited(base, r.sample(range(150), 2))) for k in range(40)]  # each near the base, far from each other
    texts += [(200, base.upper() + "!"), (201, base), (201, base), (300, "a b c"), (301, "A, b. c"), (302, "a c b"), (400, prose(9, 6000)), (401, edited(prose(9, 6000), [5, 500, 5000]))]
    return texts + EDGES


def test_near_duplicates_edges(spark):
    texts = near_texts()
    rows = near_dedup.near_duplicates(documents(spark, texts)).collect()
    found = {r["doc_id"]: r["class_id"] for r in rows if r["doc_id"] is not None}
    assert all(found[k] == 100 for k in [*range(100, 141), 200, 201]) and found[301] == 300 and found[302] == 302 and found[401] == 400
    assert all(found[k] == k for k in [*range(30), 900, 901, 902, 903, 904])
    kept = near_dedup.deduplicate(documents(spark, texts))
    assert kept.columns == documents(spark, []).columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[100] == 1 and not set(range(101, 141)) & set(ids) and ids[201] == ids[301] == ids[401] == 0
    assert all(ids[k] == 1 for k in [*range(30), 900, 901, 902, 903, 904, 905, 300, 302, 400]) and ids[None] == 2
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0 and near_dedup.deduplicate(documents(spark, [])).count() == 0


def family(members: int, twins: int):
    """Texts that share three fifths of their words, and twins of some: of similarity far under 0.8 but for the twins."""
    shared = prose(800, 90)
    texts = [(k, f"{shared} {prose(900 + k, 60)}") for k in range(members)]
    return texts + [(1000 + k, edited(texts[k][1], [149])) for k in range(twins)]


def test_large_buckets_lose_no_link(spark, monkeypatch):
    texts = family(80, 40) + [(2000 + i, t) for i, t in dict(near_texts()).items() if i in range(100, 250)]
    docs = documents(spark, texts)
    values = {i: near_dedup.shingles(near_dedup.word_hashes(t)) for i, t in texts}
    expected = classes_of([(a, b) for a in values for b in values if a < b and near_dedup.similarity(values[a], values[b]) >= 0.8], values)
    for bound in (1, 8, 1000):
        monkeypatch.setattr(near_dedup, "SMALL_BUCKET", bound)
        found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
        assert found == expected and all(found[1000 + k] == k for k in range(40)) and found[50] == 50


def test_prefixes_of_similar_texts_meet(spark):
    """Brute force: two texts of similarity 0.8 or more share a key, whatever the counters hold."""
    r = random.Random(8)
    texts = [prose(40, 60)] + [edited(prose(40, 60), r.sample(range(60), 1)) for _ in range(30)] + [prose(k, 3) for k in range(5)]
    words = [near_dedup.word_hashes(t) for t in texts]
    rows = spark.createDataFrame([(k, k, w.tobytes()) for k, w in enumerate(words)], "text_id long, root long, words binary")
    found = near_dedup.prefixes(rows, 0.8)
    other = found.select("key", F.col("text_id").alias("other"), F.col("n").alias("m"), F.col("at").alias("other_at"))
    met = {(x["text_id"], x["other"]) for x in found.join(other, "key").where(near_dedup.close(0.8) & near_dedup.enough_left(0.8)).collect()}
    alike = [(a, b) for a in range(len(texts)) for b in range(a) if near_dedup.similarity(near_dedup.shingles(words[a]), near_dedup.shingles(words[b])) >= 0.8]
    assert len(alike) > 20 and set(alike) <= met


def test_substrings(spark):
    passage, short, twice = prose(70, 68), prose(71, 30), prose(72, 51)
    texts = [(k, prose(200 + k, 130)) for k in range(20)]
    texts += [(50 + k, f"{prose(300 + k, 40)} {passage} {prose(400 + k, 55)}") for k in range(15)]
    texts += [(70 + k, f"{prose(500 + k, 60)} {short} {prose(600 + k, 45)}") for k in range(6)]
    texts += [(80, f"{prose(700, 33)}\n{twice}"), (81, f"{twice}\n{prose(701, 80)}"), (90, prose(703, 90)), (91, prose(703, 90)), (91, prose(703, 90)), (92, prose(705, 20) + " again" * 400)]
    texts += EDGES
    docs = documents(spark, texts)
    rows = {r["doc_id"]: r for r in substring_dedup.passages_removed(docs).collect()}
    assert set(rows) == {*range(51, 65), 81, 91}
    out = {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(docs).collect()}
    for k in range(1, 15):
        assert rows[50 + k]["removed_words"] == 68 and rows[50 + k]["first_doc_ids"] == [50]
        assert out[50 + k] == f"{prose(300 + k, 40)} {prose(400 + k, 55)}".strip()
    assert rows[81]["removed_words"] == 51 and out[81] == prose(701, 80) and rows[91]["removed_words"] == 90
    before = dict(texts)
    assert all(out[k] == before[k] for k in before if k not in rows and k is not None) and 91 not in out
    assert substring_dedup.without_repeats(docs).columns == docs.columns
    assert substring_dedup.passages_removed(documents(spark, [])).count() == 0


def test_no_run_of_fifty_words_is_left(spark):
    """Brute force over the whole table: each 50-word run is left in one document, and only shared words have gone."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    places = {r["doc_id"]: [m.span() for m in WORD.finditer(r["text"] or "")] for r in docs.collect()}
    words = {r["doc_id"]: [r["text"][a:b].lower() for a, b in places[r["doc_id"]]] for r in docs.collect()}
    runs, small = {}, {}
    needed = {i: set() for i in words}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            if runs.setdefault(tuple(words[i][k : k + 50]), i) != i:
                needed[i].update(range(k, k + 50))
    for i in sorted(words):
        for k in range(len(words[i]) - 4):
            small.setdefault(tuple(words[i][k : k + 5]), i)
    gone = {i: set() for i in words}
    for row in QUERIES["op2_substring_dedup"](spark, SF).collect():
        i = row["doc_id"]
        for x in row["removed"]:
            gone[i].update(k for k, (a, b) in enumerate(places[i]) if x["start"] <= a and b <= x["end"])
        assert len(gone[i]) == row["removed_words"] >= 50
        shared = set().union(*[range(k, k + 5) for k in range(len(words[i]) - 4) if small[tuple(words[i][k : k + 5])] < i])
        assert len(gone[i] & shared) >= 0.8 * len(gone[i])
    assert sum(map(len, needed.values())) > 1000 and all(needed[i] <= gone[i] for i in words)


@pytest.mark.parametrize("edits", [0, 1, 2, 4])
def test_edited_passages_are_found_whole(spark, edits):
    places = [(j + 1) * 120 // (edits + 1) - 1 for j in range(edits)]
    texts = []
    for k in range(10):
        passage = prose(1000 + k, 120)
        texts.append((k, f"{prose(2000 + k, 60)} {passage} {prose(3000 + k, 50)}"))
        texts.append((100 + k, f"{prose(4000 + k, 40)} {edited(passage, places)} {prose(5000 + k, 70)}"))
    found = {r["doc_id"]: r for r in substring_dedup.passages_removed(documents(spark, texts)).collect()}
    assert set(found) == set(range(100, 110)) and all(r["removed_words"] == 120 for r in found.values())
    assert all(found[100 + k]["first_doc_ids"] == [k] for k in range(10))


def test_neighbours_from_two_documents_are_no_passage(spark):
    """Forty words of one document next to forty of another: no fifty words repeat."""
    texts = [(k, f"{prose(k, 40)} {prose(10_000 + k, 40)}") for k in range(60)]
    texts += [(1000 + k, f"{prose(k, 40)} {prose(10_000 + (k + 1) % 60, 40)}") for k in range(60)]
    assert substring_dedup.passages_removed(documents(spark, texts)).count() == 0


def test_a_chain_of_copies_is_kept_once(spark):
    """Two passages meet in a third document; a long text, one word repeated, and columns named as the operator's own."""
    one, two = prose(31, 70), prose(32, 90)
    long = " ".join([prose(33, 9_000), two, prose(34, 3_000)])
    texts = [(5, one), (6, f"{prose(35, 20)} {one} {two}"), (7, f"{two} {prose(36, 30)} {one}"), (8, long), (9, "word " * 5_000), (10, f"{prose(37, 60)} {'word ' * 300}")]
    rows = [(i, t, 0, "x", 1, "r", "k") for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc long, removed string, first_doc_ids int, row string, kept_by string")
    found = {r["doc_id"]: (r["removed_words"], r["first_doc_ids"]) for r in substring_dedup.passages_removed(docs).collect()}
    assert found == {6: (70, [5]), 7: (160, [5, 6]), 8: (90, [6]), 10: (300, [9])}
    kept = substring_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and {r["doc_id"]: len(words_of(r["text"])) for r in kept.collect()}[7] == 30
    assert {r["removed"] for r in kept.collect()} == {"x"}


def test_seeds_are_the_minima_of_all_paragraphs():
    words = np.random.default_rng(4).integers(0, 2**63, 500).astype(np.uint64)
    for n in (5, 12, 24, 60, 500):
        hashes = substring_dedup.rolling(words[:n], 5)
        width = min(20, len(hashes))
        plain = sorted({k + int(np.argmin(hashes[k : k + width])) for k in range(len(hashes) - width + 1)})
        assert substring_dedup.seeds(words[:n])[1].tolist() == plain


def test_hashed_words_are_the_words(spark):
    texts = ["", "a", "Éa_b 12,é\u0301 İx ſ ß日本 \U0001f600 x\u00a0y", prose(1, 300)]
    known = {}
    for text in texts:
        hashes, starts, ends = hashed_words(text)
        assert [m.span() for m in WORD.finditer(text)] == list(zip(starts.tolist(), ends.tolist(), strict=True))
        for h, a, b in zip(hashes.tolist(), starts, ends, strict=True):
            plain = "".join(c.lower() if len(c.lower()) == 1 else c for c in text[a:b])
            assert known.setdefault(h, plain) == plain
    assert len(set(known.values())) == len(known)


def plain_statistics(text, n_chars):
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, chars = max(1, len(words)), max(1, len(text))
    letters = len(re.findall(r"[^\W\d_]", text))
    pairs, counted = Counter(zip(words, words[1:], strict=False)), Counter(words)
    size = lambda x: min(1.0, np.log2(1 + x) / 20)
    return [
        letters / chars, len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text)) / max(1, letters), len(re.findall(r"\d", text)) / chars,
        min(1.0, 5 * len(re.findall(r"[#*$%&|<>{}\[\]\\/=~^_@+]", text)) / chars), min(1.0, len(re.findall(r"[.!?;:]", text)) / n), text.count(" ") / chars,
        min(1.0, sum(map(len, words)) / n / 20), sum(x[0].isupper() for x in words) / n, sum(not x[-1].isalnum() and x[-1] not in ".,;:!?" for x in words) / n,
        len(counted) / n, sum(v for v in pairs.values() if v > 1) / n, max(counted.values(), default=0) / n, 1 - len(set(lines)) / max(1, len(lines)),
        size(n / max(1, len(lines))), sum(not any(c.isalnum() for c in x) for x in words) / n, size(len(words)), size(len(text)), size(n_chars or 0),
    ]


def test_statistics_are_the_plain_ones(spark):
    texts = ["", " ", "\n\n a\n\tb ", "É×Þ ß _x. a,b! \u00a0z\u2028q \x1cx", "a a a a\na a a a\n\n", "İ ǅ ²½ 日本\U0001f600 # # -", prose(5, 9_000) + " tail" * 20_000]
    texts += [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for text in texts:
        assert np.abs(np.array(quality_fm.statistics(text, 7)) - np.array(plain_statistics(text, 7))).max() < 1e-12
        slots, values = quality_fm.features(text, 7)
        counts = Counter(quality_fm.HASHES[w] % quality_fm.WORD_SLOTS for w in words_of(text))
        assert slots[: len(counts)].tolist() == sorted(counts) or "İ" in text
        weights = np.log1p([counts[s] for s in sorted(counts)])
        assert "İ" in text or np.allclose(values[: len(counts)], weights / max(1e-9, np.sqrt((weights**2).sum())))


ITEMS = [(1, "If Anna has 12 apples and gives 5 apples to Peter, how many kg of apples are left for Anna after 3 days?"), (2, "Two short words"), (3, prose(90, 30)), (None, prose(91, 30)), (4, None), (4, "")]


def test_leaks(spark):
    benchmark = spark.createDataFrame([(*x, 1) for x in ITEMS], "item_id long, text string, at int")
    same = f"{prose(1, 40)} {ITEMS[0][1]} {prose(2, 40)}"
    other = f"{prose(3, 40)}. {ITEMS[0][1].replace('Anna', 'Mary').replace('Peter', 'John').replace('12', '31').replace('5', '7').replace('3 days', '9 days')} {prose(4, 40)}"
    mixed = f"{prose(3, 40)}. {ITEMS[0][1].replace('left for Anna', 'left for Bertha').replace('12', '31')} {prose(4, 40)}"
    texts = [(k, prose(20 + k, 100)) for k in range(10)] + [(50, same), (51, other), (52, mixed), (53, f"x {prose(90, 30)} y"), (54, prose(91, 30)), (55, "Two short words"), (50, same)] + EDGES
    docs = documents(spark, texts)
    found = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, benchmark).collect())
    assert found == Counter([(50, 1), (51, 1), (53, 3), (55, 2)])
    kept = decontaminate.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, _ in texts if i not in (50, 51, 53, 55))
    assert decontaminate.contaminated(docs, benchmark.where("false")).count() == 0
    assert decontaminate.contaminated(documents(spark, []), benchmark).count() == 0


def test_short_items_are_found_word_for_word(spark):
    """Items without a template window: anywhere from four tokens on, shorter ones as whole texts; columns named as the operator's own."""
    items = ["What is 12 + 7 * 31 - 4 / 2 ?", "Solve 3 x + 4 = 19", "Compute 15 % of 80 kg", "the quick brown fox jumps", "Yes", "1 2 3 4 5 6 7 8 9 10 11"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [(k, f"{prose(k, 30)} {x} {prose(50 + k, 9_000 if k == 1 else 20)}") for k, x in enumerate(items)]
    texts += [(10, "yes!"), (11, "Solve 4 x + 4 = 19"), (12, prose(70, 50)), (13, "COMPUTE 15% of 80 KG"), (14, "9 10 11 1 2 3 4 5 6 7 8")]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in texts], "doc_id long, text string, key long, row string, leaked_key int")
    found = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, benchmark).collect())
    assert found == [(0, 0), (1, 1), (2, 2), (3, 3), (5, 5), (10, 4), (13, 2)]
    kept = decontaminate.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [4, 11, 12, 14]


CAPITALS = "A-ZÀ-ÖØ-ÞΑ-ΩА-Я"


def plain_template(text):
    """Template tokens and the values of the placeholders, by regular expressions over the text."""
    special = re.compile(rf"\d+(?:[.,]\d+)*|(?:(?<=[^\W_] )|(?<=[^\W_], ))[{CAPITALS}](?![{CAPITALS}])[^\W\d_]*")
    tokens, values, at = [], {}, 0
    for found in special.finditer(text + " "):
        tokens += [(x.lower(), None) for x in re.findall(r"[^\W\d_]+|[%€$£°]", text[at : found.start()])]
        tokens.append((decontaminate.NUMBER if found.group()[0].isdecimal() else decontaminate.NAME, found.group().lower()))
        at = found.end()
    tokens += [(x.lower(), None) for x in re.findall(r"[^\W\d_]+|[%€$£°]", text[at:])]
    for k, (token, value) in enumerate(tokens):
        if value is None and k and tokens[k - 1][0] == decontaminate.NUMBER and token in decontaminate.UNITS:
            tokens[k] = (decontaminate.UNIT, token)
    return [t for t, _ in tokens], {k: v for k, (_, v) in enumerate(tokens) if v is not None}


def test_templates_are_the_plain_ones(spark):
    shown = {decontaminate.IS_NUMBER: decontaminate.NUMBER, decontaminate.IS_NAME: decontaminate.NAME, decontaminate.IS_UNIT: decontaminate.UNIT}
    texts = ["", "a", "12", "Mr Bell 3.5,7. 4,, kg", "x Anna, Bob ANNA aNna A b Z", "abc12def 15 % of 80 kg", "5 km 3 € 1.000,5", "É Ñandu é Ñ_ñ ² ½ 3²", " Anna", "a  Bob, Carl", "1.", ".1 2 , 3"]
    texts += [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for text in texts:
        found = decontaminate.Template(text)
        words = [text[a:b].lower() for a, b in zip(found.starts, found.ends, strict=True)]
        tokens = [shown.get(k, w) for k, w in zip(found.kinds.tolist(), words, strict=True)]
        assert (tokens, {k: w for k, (w, kind) in enumerate(zip(words, found.kinds, strict=True)) if kind}) == plain_template(text)



def test_leaks_query(spark):
    import re

    strip = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    items = {r["item_id"]: strip(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    found = {(r["doc_id"], r["item_id"]) for r in QUERIES["op7_decontamination"](spark, SF).collect()}
    for row in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = strip(row["text"])
        windows = {tuple(words[k : k + 8]) for k in range(len(words) - 7)}
        for item, w in items.items():
            mine = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
            held = sum(x in windows for x in mine) / max(1, len(mine))
            if held > 0.7:
                assert (row["doc_id"], item) in found
            elif held < 0.3:
                assert (row["doc_id"], item) not in found


def area(scores, labels):
    order = np.argsort(scores)
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    labels = np.array(labels, bool)
    return (rank[labels].mean() - (labels.sum() - 1) / 2) / (~labels).sum()


@pytest.mark.parametrize(("query", "label", "cut", "least"), [("op5_toxicity", "toxic", 0.5, 0.95), ("op6_quality_fm", "quality", 0.3, 0.95)])
def test_classifiers_on_held_out_rows(spark, query, label, cut, least):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES[query](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (fold(r["doc_id"]) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= cut) for r in rows)
    judged = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert area(np.array([s for s, _ in judged]), [y for _, y in judged]) > least


def test_classifiers_on_edges(spark):
    texts = [(k, prose(k, 80) + (" vile scum" * 3 if k % 4 == 0 else "")) for k in range(60)] + EDGES + [(1, prose(1, 80)), (61, "w " * 30_000)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 3 > 0), int(k % 4 == 0)) for k in range(60)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    none = labels.where("false")
    for rows in (toxicity.toxicity(docs, labels), toxicity.toxicity(docs, none), quality_fm.quality(docs, labels), quality_fm.quality(docs, none)):
        got = rows.collect()
        assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in texts)
        assert all(r["score"] is not None and 0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
    kept = quality_fm.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert toxicity.toxicity(documents(spark, []), labels).count() == 0 and quality_fm.quality(documents(spark, []), labels).count() == 0


def test_toxicity_tail_join_equals_broadcast(spark, monkeypatch):
    texts = [(k, prose(k % 7, 60) + (" vile scum idiot" * 4 if k % 4 == 0 else "")) for k in range(80)] + [(2, prose(2, 60))]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(80)], "doc_id long, toxic int")
    score = lambda: sorted((r["doc_id"], round(r["score"], 9)) for r in toxicity.toxicity(docs, labels).collect())
    whole = score()
    monkeypatch.setattr(toxicity, "MOST_HEAD", 3)
    assert score() == whole


def test_machine_pairs_in_linear_time():
    r = np.random.default_rng(1)
    machine = quality_fm.FactorisationMachine(0.3, r.normal(size=20), r.normal(size=(20, 4)))
    slots, x = np.array([2, 5, 7, 11]), r.normal(size=4)
    direct = 0.3 + machine.linear[slots] @ x + sum(machine.factors[slots[i]] @ machine.factors[slots[j]] * x[i] * x[j] for i in range(4) for j in range(i + 1, 4))
    assert abs(machine.margin(slots, x) - direct) < 1e-9


def test_class_models_equal_brute_force(spark):
    """Continuation counts, both distributions and gains of a whole table, counted word by word."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["doc_id"] in texts]
    follows = {1: {}, 0: {}}
    for doc_id, label in labels:
        words = re.findall(r"[^\W_]+", (texts[doc_id] or "").lower())
        for before, word in zip([None, *words], words, strict=False):
            follows[label].setdefault(word, set()).add(before)
    docs = spark.createDataFrame([(texts[i], label) for i, label in labels], "text string, label int")
    counts = toxicity.continuation_counts(docs).cache()
    of = lambda word, c: len(follows[c].get(word, ()))
    either = lambda word: len(follows[1].get(word, set()) | follows[0].get(word, set()))
    name = {w: int(toxicity.signed(toxicity.HASHES.of([w]))[0]) for w in {*follows[1], *follows[0]}}
    assert {r["word"]: (r["toxic"], r["ordinary"], r["both"]) for r in counts.collect()} == {name[w]: (of(w, 1), of(w, 0), either(w)) for w in name}

    shared, parts = sum(map(either, name)), {}
    for c in (1, 0):
        every = Counter(of(w, c) for w in name)
        total = sum(k * n for k, n in every.items())
        least = 3 - 4 * every[1] / (every[1] + 2 * every[2]) * every[4] / every[3]
        assert 0.1 < least < 2.9
        took = sum(n * (k if k < 3 else least) for k, n in every.items()) / total
        parts[c] = ({w: (of(w, c) - least if of(w, c) >= 3 else 0) / total + took * either(w) / shared for w in name}, took)
        assert abs(sum(parts[c][0].values()) - 1) < 1e-9
    totals = toxicity.class_totals(counts)
    sums = counts.agg(F.sum(toxicity.probability("toxic", totals)).alias("t"), F.sum(toxicity.probability("ordinary", totals)).alias("o")).first()
    assert abs(sums["t"] - 1) < 1e-9 and abs(sums["o"] - 1) < 1e-9
    none = np.log(0.98 + 0.02 * parts[1][1] / parts[0][1])
    gains = {name[w]: np.log(0.98 + 0.02 * parts[1][0][w] / parts[0][0][w]) - none for w in name}
    found = {r["word"]: r["gain"] for r in toxicity.word_gains(counts).collect()}
    assert set(found) == {w for w, g in gains.items() if g > 1e-9} and all(abs(found[w] - gains[w]) < 1e-9 for w in found)
    counts.unpersist()


@pytest.mark.parametrize(("factor", "divergence"), [(1.3, 0.0), (4.0, 4e-4)])
def test_toxicity_compares_log_likelihoods_per_word(spark, monkeypatch, factor, divergence):
    """The evidence is the plain difference of the log-likelihoods of two distributions, over all words, by their number."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["doc_id"] in texts]
    monkeypatch.setattr(toxicity, "LEAST_FACTOR", factor)
    monkeypatch.setattr(toxicity, "LEAST_DIVERGENCE", divergence)
    told = [(texts[i], label) for i, label in labels]
    counts = toxicity.continuation_counts(spark.createDataFrame(told, "text string, label int")).cache()
    totals = toxicity.class_totals(counts)
    shared = F.col("both") / totals["both"].total
    rows = counts.select("word", toxicity.probability("toxic", totals).alias("t"), toxicity.probability("ordinary", totals).alias("o"), shared.alias("s")).collect()
    own = {r["word"]: (r["t"], r["o"]) for r in rows if max(r["t"] / r["o"], r["o"] / r["t"]) >= factor and (r["t"] - r["o"]) * np.log(r["t"] / r["o"]) >= divergence}
    left = [sum(r[c] for r in rows if r["word"] not in own) for c in ("t", "o", "s")]
    models = {r["word"]: own.get(r["word"], (left[0] / left[2] * r["s"], left[1] / left[2] * r["s"])) for r in rows}
    assert all(abs(sum(p[c] for p in models.values()) - 1) < 1e-9 for c in (0, 1))
    found, base = toxicity.log_ratios(counts)
    gains = {r["word"]: r["gain"] for r in found.collect()}
    # kept words speak for and against toxicity, as far as the models part them
    assert set(gains) == set(own) and base != 0 and (factor > 2 or min(gains.values()) + base < 0 < max(gains.values()) + base)
    words = np.array(sorted(gains), np.int64).view(np.uint64)
    order = np.argsort(words)
    model = toxicity.ToxicModel(words[order], np.array([gains[int(w)] for w in words.view(np.int64)])[order], None, base)
    docs = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(told)] + [(-1, ""), (-2, None)], "doc_id long, text string")
    evidence = {r["doc_id"]: r["e"] for r in model.sums(docs).select("doc_id", model.evidence().alias("e")).collect()}
    for k, (text, _) in enumerate(told):
        of = [models[int(w)] for w in toxicity.signed(toxicity.HASHES.of(words_of(text)))]
        assert abs(evidence[k] - (sum(np.log(t) - np.log(o) for t, o in of) / len(of) if of else 0)) < 1e-9
    assert evidence[-1] == evidence[-2] == 0
    counts.unpersist()
