"""Near-duplicates, decontamination and the pipeline against brute force and planted cases."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftnet.llm import decontaminate, near_dup, queries
from tests.compare import connection, same


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def brute_components(texts, width):
    sets = {k: shingles(t, width) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (len(sets[k]), find(k)) for k in texts}


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    texts = {k: " ".join(rng.choice(words) for _ in range(60)) for k in range(20)}
    for k in range(20, 90):
        own = list(base)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts[k] = " ".join(own)
    return texts | {90: None, 91: "", 92: "one two", 93: "One  two\n", 94: "two one", 95: texts[3].upper(), 96: texts[3], 97: "W1 " * 500}


def test_near_duplicates(spark, planted):
    docs = spark.createDataFrame(list(planted.items()), "doc_id long, text string").withColumns({"mark": F.lit("x"), "sig": F.lit(1), "n": F.lit(2)})
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs, width=4).collect()}
    assert out == brute_components(planted, 4)
    kept = {r["doc_id"] for r in near_dup.keep_one(docs, width=4).collect()}
    assert kept == {k for k, (_, c) in out.items() if k == c}
    assert near_dup.near_duplicates(docs.limit(0), width=4).count() == 0


def test_blocks_lose_no_link(spark, planted, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 700)
    docs = spark.createDataFrame(list(planted.items()), "doc_id long, text string")
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs, width=4).collect()}
    assert out == brute_components(planted, 4)


def test_large_groups_compare_strays_alone(spark, monkeypatch):
    rng = random.Random(17)
    words = [f"w{k}" for k in range(5000)]
    base = rng.choices(words, k=200)
    texts = {}
    for k in range(150):  # near copies, every tenth two steps away from the others
        own = list(base)
        for _ in range(14 if k % 10 == 0 else 2):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts[k] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sizes = []

    def counted(*of):  # members that meet other blocks
        sizes.append(of[0].filter("root != largest").select("mark").distinct().count())
        return of[0]

    whole = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, width=4).collect()}
    monkeypatch.setattr(near_dup, "BLOCK", 4000)
    plain = near_dup.spool
    monkeypatch.setattr(near_dup, "spool", lambda df, name: counted(plain(df, name)) if name == "told" else plain(df, name))
    cut = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, width=4).collect()}
    assert cut == whole == {k: c for k, (_, c) in brute_components(texts, 4).items()}
    assert sizes and 0 < sizes[0] < 30


def test_repeated_and_null_ids(spark):
    text = "a b c d e f g h"
    docs = spark.createDataFrame([(5, text), (5, text), (None, text), (2, "x y z q r s")], "doc_id long, text string")
    out = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs, width=4).collect())
    assert out == [(-1, 5, False), (2, 2, True), (5, 5, True), (5, 5, True)]
    assert near_dup.keep_one(docs.filter("doc_id IS NOT NULL"), width=4).count() == 2


def test_null_and_repeated_ids_lose_no_text(spark):
    texts = ["one two three four five", "six seven eight nine ten", "red green blue black white"]
    rows = [(None, t) for t in [*texts, texts[0], "", None]] + [(5, "a b c d e f g h"), (5, "a b c d e f g h"), (5, "north south east west up"), (7, texts[2])]
    left = [tuple(r) for r in near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()]
    want = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (None, ""), (None, None), (5, rows[6][1]), (5, rows[8][1])]
    assert sorted(map(repr, left)) == sorted(map(repr, want))


def test_keep_one_loses_no_text_and_keeps_no_copy(spark):
    text, other = "a b c d e f g h", "one two three four five six"
    docs = spark.createDataFrame([(2, text, 1), (5, text, 2), (5, other, 3), (None, text, 4), (2, text, 1), (None, "", 5), (None, None, 6), (8, "  ", 7)], "doc_id long, text string, own_row long")
    docs = docs.withColumns({"own_id": F.lit(1), "own_key": F.lit("x"), "n_rows": F.lit(2)})
    left = near_dup.keep_one(docs, width=4)
    assert left.columns == docs.columns
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in left.collect()))) == sorted(map(repr, [(2, text), (5, other), (None, ""), (None, None), (8, "  ")]))


def test_large_classes(spark, planted, monkeypatch):
    """Whether a class's rows meet it by a broadcast or a shuffle changes nothing."""
    docs = spark.createDataFrame([(1000 * c + k, t) for k, t in planted.items() for c in range(3 if k % 2 else 1)], "doc_id long, text string")
    every = sorted(map(repr, near_dup.near_duplicates(docs, width=4).collect()))
    monkeypatch.setattr(near_dup, "LARGE", 60)
    assert sorted(map(repr, near_dup.near_duplicates(docs, width=4).collect())) == every


def test_linking_counts_as_all_pairs_do():
    rng = random.Random(3)
    base = list(range(60))
    sets = [near_dup.np.unique(near_dup.np.array(rng.sample(base, 45) + rng.sample(range(100, 200), rng.randint(0, 8)), dtype="uint64")) for _ in range(120)]
    sets = list({s.tobytes(): s for s in sets}.values())
    by = near_dup.multipliers(near_dup.COORDINATES)
    mixed = [near_dup.np.sort(near_dup.mix(s + near_dup.ONE)) for s in sets]
    signs = near_dup.np.array([near_dup.signature(s, by) for s in mixed])
    marks = [near_dup.fingerprint(s) for s in mixed]

    def groups(links):
        root = {m: m for m in marks}
        find = lambda m: m if root[m] == m else find(root[m])
        for a, b in links:
            root[find(a)] = find(b)
        return {frozenset(m for m in marks if find(m) == r) for r in {find(m) for m in marks}}

    pairs = []
    for x, y in itertools.combinations(range(len(marks)), 2):
        both = len(set(mixed[x].tolist()) & set(mixed[y].tolist()))
        if (signs[x] == signs[y]).sum() >= 50 and 100 * both >= 60 * (len(mixed[x]) + len(mixed[y]) - both):
            pairs.append((marks[x], marks[y]))
    found = near_dup.linking(marks, signs, mixed, near_dup.np.zeros(len(marks), dtype=int), 50, 60)
    assert pairs and groups(found) == groups(pairs) and len(found) == len(marks) - len(groups(pairs))


def test_components(spark):
    links = spark.createDataFrame([(f"{k:03}", f"{k + 1:03}") for k in range(60)] + [("x", "y")], "a string, b string")
    out = {r["node"]: r["root"] for r in near_dup.components(links).collect()}
    assert out == {f"{k:03}": "000" for k in range(61)} | {"x": "x", "y": "x"}


ITEM = "A farmer sells 12 apples for 30 dollars each and then buys 12 pears, how much money does Alice have after 5 days in total?"


def test_reparameterised_questions(spark):
    docs = [
        (1, "Before. " + ITEM + " After."), (2, "Intro text here. " + ITEM.replace("12", "77").replace("30 dollars", "9 euros").replace("Alice", "Bob")), (3, ITEM.upper()), (4, "A farmer sells apples."), (5, None), (6, ""),
        (7, ITEM.replace("sells 12", "sells 40").replace("buys 12", "buys 41")), (8, "So a farmer sells 12 apples for 30 dollars each and then buys 12 pears, how nice it all is."), (9, "For " * 400),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit(3), "h": F.lit(1), "width": F.lit(2)})
    items = spark.createDataFrame([(0, ITEM), (1, "too short"), (2, None), (0, ITEM)], "item_id long, text string")
    out = {r["doc_id"]: r for r in decontaminate.leaks(frame, items).collect()}
    assert set(out) == {1, 2, 3, 8}  # in 7 one value of the item stands for two of the document
    assert out[1]["n_changed"] == 0 and out[2]["n_changed"] >= 3
    assert {r["doc_id"] for r in decontaminate.drop_leaks(frame, items).collect()} == {4, 5, 6, 7, 9}
    assert decontaminate.leaks(frame, items.limit(0)).count() == 0


def found(spark, docs, items):
    frames = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(*frames).collect()}


def test_items_without_template_windows(spark):
    items = ["What is 12 + 7 * 3 - 4 / 2?", "小明有12个苹果，吃了3个，还剩几个？", "Capital of Peru?", "3 1 4 1 5 9 2 6 5 3 5 8 9 7 9", "日本の首都はどこですか", "?!"]
    docs = [f"He wrote: {i} And so on." for i in items] + ["What is 12 + 7 * 3 - 5 / 2?", "capital in peru", "日本の首都はとても大きいです", None, ""]
    assert found(spark, docs, items) == {(k, k) for k in range(5)}


def test_verbatim_copies_whatever_stands_before(spark):
    items = ["What is the boiling point of water at sea level", "In which city did Marie Curie study physics"]
    docs = ["He asked me What is the boiling point of water at sea level today", "In which city did\nMarie Curie study physics", items[1].lower(), items[1].upper(), "What is the boiling point of oil at sea level"]
    assert found(spark, docs, items) == {(0, 0), (1, 1), (2, 1), (3, 1)}


def test_one_slot_does_not_undo_a_leak(spark):
    item = "On a bright morning in the village Alice " + " ".join(f"walks{chr(97 + k)}" for k in range(20)) + " and then Alice " + " ".join(f"sings{chr(97 + k)}" for k in range(20)) + "."
    same_number = ITEM.replace("12", "9").replace("30", "9").replace("Alice", "Bob")
    assert found(spark, [item.replace("then Alice", "then Bob"), same_number], [item, ITEM]) == {(0, 0), (1, 1)}


def test_names_at_the_start_and_of_more_words(spark):
    items = ["Alice has 12 apples and gives away 5. How many are left?", "Alice has 12 apples left today", "Then Alice Smith has 12 red apples and sells 5 of them"]
    docs = ["Bob has 44 apples and gives away 9. How many are left?", "Quiz!\n\"Bob has 7 apples left today\"", "Then Bob has 7 red apples and sells 3 of them", "Then Alice has 12 green pears and sells 5 of them"]
    assert found(spark, docs, items) == {(0, 0), (1, 1), (2, 2)}


SPEED = "A train travels 120 km in 2 hours. What is its average speed in km per hour?"


def test_units_anywhere_glued_and_in_words(spark):
    docs = [
        SPEED.replace("120 km", "300 miles").replace("2 hours", "5 hours").replace("km per", "miles per"), SPEED.replace("120 km", "90km").replace("2 hours", "3h"), SPEED.replace("120 km", "one hundred km").replace("2 hours", "two hours"),
        "Quiz. " + SPEED.replace("120", "two hundred and fifty-five").replace("2 hours", "3 days").replace("per hour", "per day"), SPEED, SPEED.replace("train travels", "ship sails").replace("average", "mean"), "How many miles per hour is that in km per second, and why is it so?",
    ]
    assert found(spark, docs, [SPEED]) == {(k, 0) for k in range(5)}


def test_soft_slots_may_be_plain_words(spark):
    """Where a unit or number word is not replaced alike, the windows that keep it still count."""
    item = "Only one of the old clocks in the long hall of the castle shows the right hour, and not one of them ever shows the day of the month or the year"
    changed = item.replace("not one of them", "not two of them")
    assert found(spark, [item, changed, item.upper()], [item]) == {(0, 0), (1, 0), (2, 0)}


def test_variants_of_a_template_are_a_class(spark):
    text = "Alice buys {} red apples for {} dollars each at the market on Monday, how much money has Alice paid in total after {} days?"
    items = spark.createDataFrame([(k, text.format(k + 2, 2 * k + 300, k + 900)) for k in range(200)] + [(500, "1 2 3"), (501, "1 2 3"), (502, "4 5 6"), (None, "7 8 9")], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"Number {k}: " + text.format(k + 7001, 3 * k + 8000, k + 9000).replace("Alice", "Bob")) for k in range(50)] + [(90, text.format(5, 306, 903)), (91, "So 1 2 3"), (92, "7 8 9"), (93, None)], "doc_id long, text string")
    rows = decontaminate.leak_classes(docs, items).collect()
    out = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(out) == 53
    assert all((out[k]["class_id"], out[k]["n_items"]) == (0, 200) and out[k]["n_changed"] > 0 for k in range(50))
    assert tuple(out[90])[2:5] == (0, 3, 200) and out[90]["n_changed"] == 0
    assert tuple(out[91])[2:5] == (500, 500, 2) and tuple(out[92])[2:5] == (None, None, 0)
    classes = {(r["item_id"], r["class_id"]) for r in decontaminate.item_classes(items).collect()}
    assert classes == {(k, 0) for k in range(200)} | {(500, 500), (501, 500), (502, 502), (None, None)}
    assert decontaminate.leak_classes(docs, items.limit(0)).count() == 0


def test_shuffled_benchmark_and_clashing_columns(spark, small, monkeypatch):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    near = sorted(map(tuple, decontaminate.leaks(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, decontaminate.leaks(docs, items).collect())) == near and near
    left = decontaminate.drop_leaks(docs.withColumns({"gone_doc": F.lit(1), "gone_key": F.lit(2)}), items)
    assert left.count() == docs.count() - len({k[0] for k in near})
    few = spark.createDataFrame([(1, "What is 12 + 7 * 3 - 4 / 2?"), (2, ITEM), (None, "1 2 3")], "item_id long, text string")
    assert {r["item_id"] for r in decontaminate.verbatim_only(few).collect()} == {1, None}


def brute_plain(text):
    """Lower-case words and numbers, one by one."""
    text = re.sub(r"[.,](?!\d)|(?<!\d)[.,]", " ", text.lower())
    return re.findall(r"[^\W_]+(?:[.,]+[^\W_]+)*", text)


def test_copies_against_plain_python(spark, small):
    """Every document that holds six windows of eight plain words of an item in a row, or all words of a shorter one, is found."""
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    want = set()
    for d in docs.collect():
        own = brute_plain(d["text"] or "")
        runs = {n: {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} for n in range(8, 14)}
        for i in items.collect():
            item = brute_plain(i["text"])
            n = min(len(item), 13)
            if n >= 8 and any(tuple(item[k : k + n]) in runs[n] for k in range(len(item) - n + 1)):
                want.add((d["doc_id"], i["item_id"]))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()}
    assert want and want <= got


def test_planted_items_are_found(spark, small):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    want = {(d["doc_id"], i["item_id"]) for d in docs.collect() for i in items.collect() if i["text"] in d["text"]}
    assert want <= {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()} and want


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_twins(spark, small, name):
    same(spark, connection(small), queries.queries()[name], queries.oracle_sql()[name], small)


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns, docs = docs.columns, corpus_pipeline.spool(stage(spark, docs, small), "test")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] < len(before)
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(c == k for k, (_, c) in brute_components(left, 5).items())
    items = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert not any(i in t for t in left.values() for i in items)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, small).collect()} == set(left)


def test_workers_give_memory_back(monkeypatch):
    """Once its batches are through, a task gives freed memory back, and groups drop the word hashes that nothing reads any more."""
    import pyarrow as pa

    from driftnet.llm import common, near_dup

    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(len(calls)))
    texts = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b c d e f", None])], names=["doc_id", "text"])
    signed = [b.to_pydict() for b in near_dup.signing(5)(iter([texts, texts]))]
    assert len(signed) == 2 and signed[0] == signed[1] and signed[0]["n_shingles"] == [2, 0] and calls == [0]
    sets = [b.to_pydict() for b in near_dup.full_sets(5)(iter([texts.select(["text"])]))]
    assert sets[0]["mark"] == signed[0]["mark"][:1] and calls == [0, 1] and common.LIVING
    held = pa.table({"mark": pa.array([b"a", b"b"]), "shingles": pa.array([sets[0]["shingles"][0]] * 2), "sig": [signed[0]["sig"][0]] * 2, "side": [0, 0], "root": pa.array([b"a", b"b"])})
    assert near_dup.link_groups(near_dup.AGREE, 80)(None, held).num_rows == 1 and not common.LIVING
