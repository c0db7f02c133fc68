"""Every stage of the pipeline against brute force, over odd rows, and benchmark leaks against plain Python."""

import functools
import hashlib
import itertools
import math

import public_tokenizers
import pytest
import regex
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from driftnet.llm import bpe, decontaminate, quality, toxicity
from driftnet.llm.common import table
from tests.llm.test_groups import brute_components
from tests.llm.test_simple import brute_base

UNITS, DIGITS, SCALES = (set(x.split("|")) for x in (decontaminate.UNITS, decontaminate.DIGITS, decontaminate.SCALES))
GLUED = regex.compile(rf"(\p{{N}}+(?:[.,]\p{{N}}+)*)({decontaminate.UNITS})")


def brute_tokens(text):
    """(kind, value) of each token of a text without unspaced scripts: a name is a run of capitalised words with one space between, a spelled number
    a run of number words, with "and" behind hundred and the like; units are bound to a number before them or free."""
    out, end, joins = [], None, False
    for m in regex.finditer(r"(?:[\p{L}\p{M}\p{N}]|(?<=\p{N})[.,](?=\p{N}))+", text or ""):
        w = m[0]
        low = w.lower()
        name = regex.match(r"\p{Lu}\p{Ll}", w) is not None
        if name and joins and m.start() == end + 1 and text[end] == " ":
            out[-1] = ("name", out[-1][1] + " " + low)
        elif name:
            out.append(("name", low))
        elif regex.fullmatch(r"\p{N}+(?:[.,]\p{N}+)*", low):
            out.append(("number", low))
        elif glued := GLUED.fullmatch(low):
            out += [("number", glued[1]), ("word", glued[2])]
        else:
            out.append(("word", low))
        end, joins = m.end(), name and regex.fullmatch(r"[\p{L}\p{M}]+", w) is not None
    return with_units(with_spelled(out))


def with_spelled(tokens):
    out, k = [], 0
    digit = lambda j: j < len(tokens) and tokens[j][0] in ("word", "name") and tokens[j][1] in DIGITS
    while k < len(tokens):
        if not digit(k):
            out.append(tokens[k])
            k += 1
            continue
        run = [tokens[k][1]]
        k += 1
        while True:
            if digit(k):
                run, k = [*run, tokens[k][1]], k + 1
            elif k < len(tokens) and tokens[k] == ("word", "and") and run[-1] in SCALES and digit(k + 1):
                run, k = [*run, "and", tokens[k + 1][1]], k + 2
            else:
                break
        out.append(("spelled", " ".join(run)))
    return out


def with_units(tokens):
    out = []
    for k, v in tokens:
        if k == "word" and v in UNITS:
            k = "unit" if out and out[-1][0] in ("number", "spelled") else "free"
        out.append((k, v))
    return out


def literal(token):
    return token[0] in ("word", *SOFT)


SOFT = ("spelled", "free")


def by_word(tokens):
    """The tokens with names and numbers word by word; only these kinds count as slots of plain windows."""
    return [("word" if k == "spelled" and w == "and" else k, w) for k, v in tokens for w in v.split(" ")]


def longest_run(spots, width):
    best, run = [], []
    for s in sorted(spots):
        run = [*run, s] if run and s - run[-1] <= width else [s]
        best = run if len(run) > len(best) else best
    return best


def brute_windows(tokens, width, plain):
    """Places of each window; a token that is no slot is told apart from a placeholder of the same letters."""
    kinds = [(v, True) if plain or k == "word" else ("number" if k == "spelled" else k, False) for k, v in tokens]
    out = {}
    for k in range(len(kinds) - width + 1):
        out.setdefault(tuple(kinds[k : k + width]), []).append(k)
    return out


def brute_leak(doc, item, windows_of_doc):
    """(n_windows, n_slots, n_changed) of the best alignment of two token lists, or None."""
    width, found = min(8, len(item)), []
    for plain in (False, True) if width else ():
        a, b = (by_word(item), by_word(doc)) if plain else (item, doc)
        rich = lambda p, a=a: sum(map(literal, a[p : p + width])) >= 4
        places = {w: [p for p in at if plain or (width >= 5 and rich(p))] for w, at in brute_windows(a, width, plain).items()}
        first = {w: at[0] for w, at in places.items() if at}
        if not first:
            continue
        need = min(6, len(longest_run(first.values(), width)) if plain else len(first))
        aligned = {}
        for w, spot in first.items():
            for k in windows_of_doc(width, plain).get(w, ()):
                aligned.setdefault(k - spot, set()).add(spot)
        for (offset, spots), strict in itertools.product(aligned.items(), (False, True)):
            kept = {s for s in spots if not strict or all(a[k][0] not in SOFT or a[k][1] == b[k + offset][1] for k in range(s, s + width))}
            run = longest_run(kept, width) if plain else sorted(kept)
            if len(run) < need:
                continue
            slots = [(a[k], b[k + offset][1]) for k in range(run[0], run[-1] + width) if a[k][0] != "word" and not (strict and a[k][0] in SOFT)]
            changed = sum(x[1] != y for x, y in slots)
            if changed == 0 or len(set(slots)) == len({x for x, _ in slots}):
                found.append((len(run), -changed, -offset, len(slots)))
    return None if not found else (max(found)[0], max(found)[3], -max(found)[1])


def brute_leaks(docs, items):
    told = {}
    split = [(k, brute_tokens(t)) for k, t in items]
    for d, text in docs:
        own = brute_tokens(text)
        held = functools.cache(lambda width, plain, own=own: brute_windows(by_word(own) if plain else own, width, plain))
        for i, item in split:
            if (hit := brute_leak(own, item, held)) is not None:
                told[d, i] = hit
    return told


SPEED = "A train travels 120 km in 2 hours. What is its average speed in km per hour?"
COUNT = "Nobody knows which one of the three old keys opens the door of the hut, so one by one all of the keys are tried in a day or one hour."
STEM = "Read the passage below with care and then answer the question that follows it in one short sentence. "
TAILS = [
    "How many apples does Alice Smith have after 5 days if she buys 12 of them each morning?", "Which river flows through the old town of Verona before it meets the sea?", "What does the writer think of the new bridge over the harbour and why?",
    "A train leaves at 9 and travels 300 km in 4 hours, how fast does it go?", "Why did the council close 3 of the 7 schools after the long winter storm?",
]


@pytest.mark.parametrize("common, near", [(64, 64 << 20), (0, 64 << 20), (2, 0)])
def test_leaks_against_plain_python(spark, small, monkeypatch, common, near):
    """All items share a long stem: its windows are late where few items may share a window, and results are the same."""
    monkeypatch.setattr(decontaminate, "COMMON_ITEMS", common)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", near)
    items = [(k, STEM + t) for k, t in enumerate(TAILS)] + [(10, STEM.strip()), (11, "Answer in one short sentence."), (12, "3 + 4 = 7"), (13, STEM + TAILS[0]), (14, SPEED), (15, COUNT)]
    items += [(100 + r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    texts = [STEM + TAILS[3].replace("300", "80").replace("9", "10"), "Bob says: " + TAILS[0].replace("Alice Smith", "Bob").replace("12", "44"), STEM + "Nothing else.", (STEM + TAILS[1]).upper(), " ".join(reversed(TAILS)), STEM[:60] + TAILS[4], None, "", "x 3 4 7 y"]
    texts += [SPEED.replace("120 km", "300 miles").replace("2 hours", "5 hours").replace("km per", "miles per"), SPEED.replace("120 km", "90km").replace("2 hours", "3h"), SPEED.replace("120 km", "One hundred and twenty-five km").replace("2", "two"), COUNT, COUNT.replace("three", "5"), COUNT.replace("one of the", "two of the")]
    docs = list(enumerate(texts)) + [(50 + k, f"Intro words here. {t} And more.") for k, (_, t) in enumerate(items)]
    docs += [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").filter("doc_id % 4 = 0").collect()]
    want = brute_leaks(docs, items)
    out = decontaminate.leaks(spark.createDataFrame([*docs, docs[0]], "doc_id long, text string"), spark.createDataFrame([*items, items[0]], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): (r["n_windows"], r["n_slots"], r["n_changed"]) for r in out} == want
    assert len(out) == len(want) and {(0, 3), (1, 0), (3, 1), (4, 4), (2, 10), (9, 14), (10, 14), (11, 14), (12, 15), (13, 15)} <= set(want) and (5, 0) not in want and any(k[0] >= 1000 for k in want)


@pytest.mark.parametrize("common", [64, 0])
def test_items_of_all_lengths_in_small_plans(spark, monkeypatch, common):
    """Items of 1 to 12 tokens have windows of all widths; no plan has a copy of the tokens for each, as the driver compiles every copy."""
    monkeypatch.setattr(decontaminate, "COMMON_ITEMS", common)
    generates, spooled = [], decontaminate.spool

    def seen(df):
        generates.append(df._jdf.queryExecution().optimizedPlan().toString().count("Generate "))
        return df

    monkeypatch.setattr(decontaminate, "spool", lambda df, name: spooled(seen(df), name))
    line = "how many red apples does Alice Smith carry over 12 km each two days when it rains".split()
    items = [(n, " ".join(line[:n])) for n in range(len(line) + 1)] + [(100 + n, " ".join(f"w{k}" for k in range(n))) for n in range(1, 13)] + [(200, None), (201, "Bob Jones")]
    docs = [(k, f"see here {text} and so on") for k, (_, text) in enumerate(items) if text] + [(300, None), (301, ""), (302, "how many red w0 w1 w2 days"), (303, items[15][1].replace("12", "40").replace("Alice", "Bob"))]
    out = seen(decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))).collect()
    want = brute_leaks(docs, items)
    assert {(r["doc_id"], r["item_id"]): (r["n_windows"], r["n_slots"], r["n_changed"]) for r in out} == want and len(out) == len(want)
    assert {i for _, i in want} == {i for i, t in items if t} and max(generates) <= 16


@pytest.mark.parametrize("words", [decontaminate.UNITS, decontaminate.DIGITS])
def test_patterns_hold_just_their_words(words):
    every = set(words.split("|"))
    near = {w[:k] for w in every for k in range(len(w) + 1)} | {w + c for w in every for c in "aesnty"}
    assert {w for w in near if regex.fullmatch(decontaminate.any_of(words), w)} == every


#: Columns of an operator's own that documents may have as well.
CLASHES = "mark sig n n_shingles text_key kept toxic severity grade gone_doc gone_key own_id own_key n_rows own_row h width item_id n_tokens word_chars band key chunk ids".split()


def odd_documents(spark, small):
    docs = table(spark, small, "documents")
    clean = docs.orderBy("doc_id").limit(3)
    empty = clean.withColumns({"doc_id": F.col("doc_id") + 5000, "text": F.when(F.col("doc_id") % 2 == 0, "").cast("string")})
    nulls = clean.select(*[F.lit(None).cast(t).alias(c) if c != "text" else F.col(c) for c, t in docs.dtypes])
    long = clean.withColumns({"doc_id": F.col("doc_id") + 6000, "text": F.repeat(F.concat("text", F.lit("\n")), 200)})
    every = docs.unionByName(empty).unionByName(nulls).unionByName(nulls).unionByName(long).unionByName(clean)
    return every.withColumns({c: F.lit("clash") for c in CLASHES if c not in docs.columns})


def rows(df):
    return sorted(repr((r["doc_id"], r["text"])) for r in df.select("doc_id", "text").collect())


def test_stages_against_brute_force(spark, small):
    """Nulls, empty, very long and repeated texts, clashing columns: each stage on what the one before it kept."""
    stages = dict(corpus_pipeline.STAGES)
    docs = corpus_pipeline.spool(odd_documents(spark, small), "test")
    columns = docs.columns

    def after(name):
        left = corpus_pipeline.spool(stages[name](spark, docs, small), "test")
        assert left.columns == columns
        return left

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(quality.VOCABULARY))
    want = []
    for r in docs.select("doc_id", "text", "lang").collect():
        text = r["text"] or ""
        n_words, chars, _, _, repeated = brute_base(text)
        pieces = lib.encode(text)
        n = max(1, len(pieces))
        entropy = -sum(c / n * math.log2(c / n) for c in (pieces.count(p) for p in set(pieces)))
        band = quality.LANGUAGE_BANDS.get(r["lang"]) or quality.SCRIPT_BANDS[quality.script_of(text)]
        strange = sum(lib.is_byte(p) or lib.is_unknown(p) for p in pieces) / n
        good = pieces and band.min_chars <= chars / n <= band.max_chars and strange <= band.max_bytes and (n < band.entropy_tokens or entropy >= band.min_entropy)
        if good and n_words >= 50 and 100 * repeated <= 50 * n_words:
            want.append(repr((r["doc_id"], r["text"])))
    left = after("quality_rules")
    assert rows(left) == sorted(want) and 0 < len(want) < docs.count()
    docs = left

    model = toxicity.train(docs, table(spark, small, "labels"))
    want = []
    for r in docs.select("doc_id", "text").collect():
        words = [w.encode() for w in regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in r["text"]))]
        count = lambda f: sum(w.startswith(f[:-1]) and len(w) >= len(f) for w in words) if f.endswith(b"*") else words.count(f)  # noqa: E731, B023
        score = sum(weight * math.log1p(count(f)) for f, weight in model.weights.items())
        if not model.thresholds or 1 / (1 + math.exp(model.thresholds[0] - score)) < toxicity.TOXIC_FROM:
            want.append(repr((r["doc_id"], r["text"])))
    left = after("toxicity")
    assert rows(left) == sorted(want) and want
    docs = left

    held = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    group = brute_components({k: t for k, (_, t) in enumerate(held)}, 5)
    members = {}
    for k, (d, t) in enumerate(held):
        members.setdefault(group[k][1], []).append((d is None, d or 0, repr((d, t))))
    left = after("near_dedup")
    assert len(rows(left)) == len(members) < len(held)
    least = {min(m)[:2] for m in members.values()}
    assert {(r["doc_id"] is None, r["doc_id"] or 0) for r in left.select("doc_id").collect()} == least and set(rows(left)) <= {r for m in members.values() for *_, r in m}
    docs = left

    held = [(k, r["doc_id"], r["text"]) for k, r in enumerate(docs.select("doc_id", "text").collect())]
    items = [(r["item_id"], r["text"]) for r in table(spark, small, "benchmark").collect()]
    gone = {k for k, _ in brute_leaks([(k, t) for k, _, t in held], items)}
    left = after("decontamination")
    assert gone and rows(left) == sorted(repr((d, t)) for k, d, t in held if k not in gone)
    docs = left

    words = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = words.encode(r["text"], add_special_tokens=False).ids
        back = words.decode(ids, skip_special_tokens=False)
        want.append((r["doc_id"], len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    out = stages["bpe"](spark, docs, small).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))


def test_empty_tables(spark, small, tmp_path):
    """Without documents every stage gives none; without labels and benchmark items none is toxic and none leaks."""
    docs = odd_documents(spark, small)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), small).count() == 0, name
    for name in ("labels", "benchmark"):
        table(spark, small, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("toxicity", "decontamination"):
        assert rows(stages[name](spark, docs, str(tmp_path))) == rows(docs)
