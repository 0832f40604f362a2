"""Spelling variants, packing and clustering against brute force, and on edge cases."""

import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pandas as pd
import pytest

from tests.conftest import DATA
from tidemark.llm import lloyd, packing, queries, variants

# ---- spelling variants


def brute_words(docs):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 97 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            found[low] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def brute_variants(docs):
    n = brute_words(docs)
    by = defaultdict(set)
    for w in n:  # words of one pattern with a character out of sight, and those that a deletion gives
        for i in range(len(w)):
            by[w[:i], w[i + 1 :]].add(w)
    near = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            near[w] |= by[w[:i], w[i + 1 :]] - {w}
            short = w[:i] + w[i + 1 :]
            if short in n:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_variants_of_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    found = rows(queries.op11_spelling_variants(spark, DATA).select("word", "form", "root", "n", "n_near", "form_n"))
    assert found == sorted(brute_variants(docs), key=repr) and len(found) > 100


@pytest.mark.parametrize("largest", [0, 2, 4096])
def test_variants_of_few_letters(spark, monkeypatch, largest):
    monkeypatch.setattr(variants, "LARGEST", largest)
    rng = random.Random(largest)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 8))) for _ in range(300)]
    docs = [(i, " ".join(w for w in words for _ in range(rng.randint(0, 3)))) for i in range(6)]
    docs += [(None, "aaaaa aaaaa aaaaa aaaaaa aaaaaa aaaaaa aaaaaaa aaaaaaa aaaaaaa"), (7, None), (8, ""), (8, "a" * 5000 + " " + "a" * 5001), (8, ("a" * 5000 + "\n") * 3), (9, "a" * 5001 + " " + "a" * 5001 + " " + "a" * 5001)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n long, word string")
    assert rows(variants.group(df)) == sorted(brute_variants(docs), key=repr)


def test_variants_of_nothing(spark):
    assert variants.group(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_variants_reads_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(variants, "PART", 7)
    text = "one twotwo, threethreethree éééééééé 4 five" * 5
    assert list(variants.runs(text)) == re.findall("[A-Za-zÀ-ÿ]+", text)


def test_variants_forms_lead_to_the_last(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(11)] + [("x", "w5")], "word string, form string")
    assert {r["root"] for r in variants.roots(chain).collect()} == {"w11"}


# ---- packing


def checked(got, texts):
    """The pieces cut and the sequences filled as they must be."""
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(queries.byte_vocabulary()[0])
    for doc, mine in got.groupby("doc_id"):
        ids = [*known.encode(texts[doc] or "", add_special_tokens=False).ids, 0]
        mine = mine.sort_values("piece")
        assert list(mine["piece"]) == list(range(len(mine))) and list(mine["start"]) == [0, *np.cumsum(mine["length"])[:-1]]
        assert mine["length"].sum() == len(ids) and (mine["length"][1:] == 2048).all() and len(mine) == -(-len(ids) // 2048)
        for r in mine.itertuples():
            assert r.ids_crc32 == crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    fits(got)


def fits(got, capacity=2048):
    for _, mine in got.groupby("sequence_id"):
        mine = mine.sort_values("offset")
        assert list(mine["offset"]) == [0, *np.cumsum(mine["length"])[:-1]] and mine["length"].sum() <= capacity


def best_fit(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= x]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - x)
        else:
            rooms.append(capacity - x)
    return len(rooms)


def test_packing_of_documents(spark):
    got = queries.op12_best_fit_packing(spark, DATA).toPandas()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert set(got["doc_id"]) == set(docs)
    checked(got, docs)
    assert got["sequence_id"].nunique() <= best_fit(got["length"], 2048) and got["sequence_id"].nunique() <= 1.02 * got["length"].sum() / 2048 + 1


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_as_good_as_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([3, 10, 61, 100])
    lengths = [rng.choice([rng.randint(1, capacity), rng.randint(1, max(1, capacity // 3)), capacity // 2 or 1]) for _ in range(rng.randint(0, 300))]
    counts = Counter(lengths)
    made = defaultdict(list)
    seen = Counter()
    for length, rank, until, sequence, each, offset in packing.plan(dict(counts), capacity):
        assert rank == seen[length]
        seen[length] = until
        for r in range(until - rank):
            made[sequence + r // each].append((offset + r % each * length, length))
    assert seen == counts and sorted(made) == list(range(len(made)))
    for held in made.values():
        held.sort()
        assert [a for a, _ in held] == [0, *np.cumsum([n for _, n in held])[:-1]] and sum(n for _, n in held) <= capacity
    assert len(made) <= best_fit(lengths, capacity)


def test_packing_edges(spark):
    texts = {1: None, 2: "", 3: "a b " * 5000, 4: "<|endoftext|> x", 5: " " * 1_000_000, 6: "é\U0001f600" * 3000}
    rows = [(i, t, 9, "k", "n") for i, t in texts.items()] + [(1, None, 9, "k", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long, offset string, note string").repartition(3)
    packed = packing.pack(docs, queries.byte_vocabulary(), keep=["length", "offset", "note"])
    assert packed.columns == ["doc_id", "note", "piece", "start", "length", "ids", "sequence_id", "offset"] and packed.where("note = 'n'").count() == packed.count()
    held = packing.place(packing.pieces(docs, queries.byte_vocabulary()))
    got = held.selectExpr("*", "crc32(ids) AS ids_crc32").toPandas()
    assert len(got[got["doc_id"] == 1]) == 2
    fits(got)
    checked(got[(got["doc_id"] != 1)].assign(sequence_id=range(len(got) - 2), offset=0), texts)
    whole = packing.sequences(held).toPandas()
    assert (whole["ids"].str.len() == 4 * whole["n_tokens"]).all() and whole["n_tokens"].sum() == got["length"].sum()


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), queries.byte_vocabulary()).count() == 0


# ---- clustering


def brute_lloyd(vectors, start, rounds=10):
    centers = [list(c) for c in start]

    def gap(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b))

    def nearest():
        return [min(range(len(centers)), key=lambda k: (gap(v, centers[k]), k)) for v in vectors]

    for _ in range(rounds):
        mine = nearest()
        for k in range(len(centers)):
            held = [v for v, m in zip(vectors, mine) if m == k]
            if held:
                centers[k] = [sum(c) // len(held) for c in zip(*held)]
    mine = nearest()
    return mine, [gap(v, centers[m]) for v, m in zip(vectors, mine)], centers


@pytest.mark.parametrize("seed,span,k", [(0, 3, 5), (1, 500, 8), (2, 1, 8), (3, 10**8, 4)])
def test_clusters_against_brute_force(spark, monkeypatch, seed, span, k):
    monkeypatch.setattr(lloyd, "BLOCK", 97)
    rng = random.Random(seed)
    middles = [[rng.randint(-span, span) for _ in range(4)] for _ in range(4)]
    vectors = [[m + rng.randint(-span // 4 - 1, span // 4 + 1) for m in rng.choice(middles)] for _ in range(400)]
    vectors += [vectors[0]] * 100
    table = [(i if i else None, [x / 1024 for x in v], 5, "c") for i, v in enumerate(vectors)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, distance long, cluster string").repartition(3)
    got = lloyd.cluster(df, k=k, components=4)
    start = lloyd.first(df.select("vec_id", lloyd.integers(df["embedding"], 4).alias("v")), k, "3")
    mine, gaps, centers = brute_lloyd(vectors, start)
    found = {r["vec_id"] or 0: r for r in got.collect()}
    assert len(found) == len(vectors)
    for i, (m, d) in enumerate(zip(mine, gaps)):
        r = found[i]
        assert (r["cluster"], r["distance"], r["centroid"], r["inertia"]) == (m, d, centers[m], sum(gaps))
        assert r["cluster_inertia"] == sum(g for g, x in zip(gaps, mine) if x == m)


def test_clusters_leave_out_and_few(spark):
    whole = [0.5] * 64
    rows = [(1, whole), (1, whole), (2, whole[:-1]), (3, [None, *whole[1:]]), (4, [float("nan"), *whole[1:]]), (5, [float("inf"), *whole[1:]]), (6, None), (7, [-0.0001] * 64)]
    got = lloyd.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(r["vec_id"] for r in got) == [1, 1, 7] and {tuple(r["centroid"]) for r in got} == {(512,) * 64, (-1,) * 64}
    assert {r["inertia"] for r in got} == {0}
    assert lloyd.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_tree_covers():
    rng = np.random.default_rng(5)
    points = rng.integers(-50, 50, (700, 3))
    order, nodes = lloyd.tree(points, 4)
    assert sorted(order) == list(range(700))
    for node in nodes:
        held = points[order[node["start"] : node["end"]]]
        assert np.sqrt(lloyd.squares(held, points[node["center"]]).max()) <= node["radius"] + 1e-9
        kids = nodes[node["first"] : node["last"]]
        if len(kids):
            assert kids["start"][0] == node["start"] and kids["end"][-1] == node["end"] and kids["center"][0] == node["center"]
            assert (kids["radius"] <= node["radius"] / lloyd.BASE + 1e-9).all()


def test_three_columns(spark):
    for name, columns in (
        ("op11_spelling_variants", "word form root n n_near form_n"),
        ("op12_best_fit_packing", "doc_id piece start length ids_crc32 sequence_id offset"),
        ("op13_centroid_clustering", "vec_id cluster distance cluster_inertia inertia centroid_sha256"),
    ):
        assert queries.queries()[name](spark, DATA).columns == columns.split()


def test_pii_leaves_out_only_windows_without_a_span(monkeypatch):
    from tidemark.llm import pii

    tagger = pii.train()
    held = pii.labelled(200, 9)[2]
    plain = "some plain words of prose, and nothing that is of any use to others. " * 30
    texts = held[:100] + ["\n".join(held[a : a + 20]) for a in range(0, 200, 20)] + [plain[: 900 + 7 * k] + x + plain for k, x in enumerate(held[:40])]
    seen = []
    decode = pii.Tagger.decode
    monkeypatch.setattr(pii.Tagger, "decode", lambda self, x: seen.append(len(x)) or decode(self, x))
    some, few = pii.find(texts, tagger.w), sum(seen)
    monkeypatch.setattr(pii, "hopeful", lambda text: range(len(pii.windows(len(text)))))
    seen.clear()
    assert some == pii.find(texts, tagger.w) and any(not s["base"] for found in some for s in found)
    assert few < sum(seen)
