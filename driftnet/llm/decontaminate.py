"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers (digits or words), units and names (runs of capitalised words) become typed placeholders, so that a re-parameterised question keeps its
template. Windows of template tokens are joined by hash to those of the benchmark; hits are put together by benchmark item and relative offset, and an
alignment counts only if its slots are consistent: each value of the item stands for one value of the document.

A unit that stands without a number ("km per hour") and a number in words may be plain words as well. Such soft slots count as literal tokens of an
item's window, and an alignment is also read with its windows that keep them, where they are words and no slots.

Windows of the plain lower-case tokens are posted too, with their values and without marks. They find verbatim text whatever its case, line
breaks or left neighbour, items without enough literal tokens, and long verbatim stretches of an alignment that is not consistent as a whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftnet.llm.common import free_names, spool

#: Template tokens of a window, literal tokens that it must have, and windows that make a leak (all of a shorter item).
WINDOW, LITERALS, HITS = 8, 4, 6
#: Items with fewer tokens are no questions; they have no template and match by their plain tokens only.
LEAST_TOKENS = 5
#: Items that may share a window before it is looked up only for documents that hold a rarer window of the item.
COMMON_ITEMS = 64
#: Benchmark windows and bytes of its texts that are broadcast at most; a larger benchmark is joined by a shuffle.
BROADCAST_WINDOWS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: Units that may follow a number.
UNITS = "km|m|cm|mm|mi|miles|mile|ft|feet|inch|inches|kg|g|mg|lb|lbs|oz|tons|l|ml|litres|liters|gallons|s|sec|seconds|min|minutes|h|hours|hour|days|day|weeks|months|years|year|mph|kmh|hz|khz|mhz|ghz|w|kw|v|j|kj|cal|usd|eur|gbp|dollars|euros|pounds|cents|percent|degrees"
#: The words that numbers are made of, and those that "and" may follow in a number.
DIGITS = "zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion"
SCALES = "hundred|thousand|million|billion"
NAME, NUMBER, UNIT = "\u0001", "\u0002", "\u0003"
#: Between the words of a name or of a number.
JOIN = "\u0004"
#: A unit without a number, and a number in words where it is told apart from one in digits.
FREE, SPELLED = "\u0005", "\u0006"
#: Characters of scripts that part no words by spaces; each is a token.
UNSPACED = r"[^\x{0}-\x{DFF}](?<=[฀-໿က-႟ក-៿々-〇぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ\x{20000}-\x{3FFFF}])"


def any_of(words: str) -> str:
    """The pattern of words parted by bars, told apart letter by letter: a token meets few letters instead of all words."""
    by = {}
    for w in words.split("|"):
        by.setdefault(w[:1], []).append(w[1:])
    tails = {c: any_of("|".join(rest)) for c, rest in by.items() if c}
    every = "|".join(re.escape(c) + tail for c, tail in tails.items())
    return every if len(by) == 1 else f"(?:{every}){'?' * ('' in by)}"


ANY_UNIT, ANY_DIGIT = any_of(UNITS), any_of(DIGITS)


def plain_tokens(text: Column) -> Column:
    """Lower-case tokens parted by one space. A capitalised word has the name mark before it, wherever it stands, so that marks do not depend on what
    is around a passage; capitalised words in a row, with nothing but a space between, make one token. So do the words of a number, and a number with
    its unit ("90km") makes two.

    Every pattern begins with the character that it is about and looks behind afterwards, so that a text is passed at the cost of one test a character.
    """
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{Lu}(?=\p{Ll})(?<![\p{L}\p{M}\p{N}]\p{Lu})", f"{NAME}$0")
    named = F.regexp_replace(marked, rf"({NAME}[\p{{L}}\p{{M}}]+) (?={NAME})", f"$1{JOIN}")
    loose = F.regexp_replace(F.lower(named), r"[.,](?:(?!\p{N})|(?<!\p{N}[.,]))", " ")  # points and commas that stand in no number
    parted = F.regexp_replace(loose, rf"{UNSPACED}", " $0 ")
    clean = F.trim(F.regexp_replace(parted, rf"[^\p{{L}}\p{{M}}\p{{N}}.,{NAME}{JOIN}]+", " "))
    unglued = F.regexp_replace(clean, rf"(\p{{N}}(?<=(?:^| )\p{{N}})\p{{N}}*(?:[.,]\p{{N}}+)*)({ANY_UNIT})(?![^ ])", "$1 $2")
    unnamed = F.regexp_replace(unglued, rf"{NAME}(?<!{JOIN}{NAME})({ANY_DIGIT})(?![^ ])", "$1")  # a number at the start of a sentence
    joined = F.regexp_replace(unnamed, rf" (?={ANY_DIGIT}(?![^ ]))(?<=(?<![^ ])(?:{ANY_DIGIT}|(?:{SCALES}) and) )", JOIN)
    return F.regexp_replace(joined, rf" (?=and{JOIN}{ANY_DIGIT})", JOIN)


def template(plain: Column, spelled: str = NUMBER) -> Column:
    """The same tokens with placeholders for numbers, units after numbers, other units, and names; spelled is that of numbers in words."""
    spaced = F.concat(F.lit(" "), plain)  # so that each pattern of words begins with a space
    numbers = F.regexp_replace(spaced, r"\p{N}(?<= \p{N})\p{N}*(?:[.,]\p{N}+)*(?![^ ])", NUMBER)
    in_words = F.regexp_replace(numbers, rf" {ANY_DIGIT}(?:{JOIN}(?:and{JOIN})?{ANY_DIGIT})*(?![^ ])", f" {spelled}")
    units = F.regexp_replace(in_words, rf"([{NUMBER}{SPELLED}]) {ANY_UNIT}(?![^ ])", f"$1 {UNIT}")
    free = F.regexp_replace(units, rf" {ANY_UNIT}(?![^ ])", f" {FREE}")
    return F.ltrim(F.regexp_replace(free, rf"{NAME}[^ ]*", NAME))


def spelled_template(plain: Column) -> Column:
    """The template with a placeholder for each word of a name or of a number."""
    return template(F.replace(plain, F.lit(JOIN), F.lit(" ")), SPELLED)


def values(plain: Column) -> Column:
    """The same tokens without marks, for the slots of a template."""
    return F.replace(plain, F.lit(NAME), F.lit(""))


def words(plain: Column) -> Column:
    """The tokens of names and numbers one by one, without marks."""
    return F.replace(values(plain), F.lit(JOIN), F.lit(" "))


def tokens(line: Column) -> Column:
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " ", -1))


def windows(of: Column, width: Column) -> Column:
    """For posexplode: structs of the width tokens from each place on, with nulls up to WINDOW. Zipped slices and the hash of their fields stay in generated code."""
    n = F.greatest(F.size(of) - (width - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(of, F.lit(k + 1), F.when(width > k, n).otherwise(0)).alias(f"t{k}") for k in range(WINDOW)])


def window_tokens(of: str) -> list[Column]:
    """The fields of a window. xxhash64 passes over nulls, so that their hash is that of the tokens alone, and tells the widths apart."""
    return [F.col(f"{of}.t{k}") for k in range(WINDOW)]


def is_soft(token: Column) -> Column:
    return token.isin(FREE, SPELLED)


def is_slot(token: Column) -> Column:
    return token.isin(NAME, NUMBER, UNIT) | is_soft(token)


def best_run(spots: Column, width: Column) -> Column:
    """n, first, last of the longest run of spots (the first of equals) between which no token is left out, as each window reaches up to the next."""
    kind = "struct<n: long, first: long, last: long, best_n: long, best_first: long, best_last: long>"
    start = F.from_json(F.lit('{"n": 0, "first": 0, "last": 0, "best_n": 0, "best_first": 0, "best_last": 0}'), kind)

    def step(a, s):
        goes_on = (a["n"] > 0) & (s - a["last"] <= width)
        n, first = F.when(goes_on, a["n"] + 1).otherwise(F.lit(1).cast("long")), F.when(goes_on, a["first"]).otherwise(s)
        more = n > a["best_n"]
        pick = lambda new, old: F.when(more, new).otherwise(a[old])
        return F.struct(n.alias("n"), first.alias("first"), s.alias("last"), pick(n, "best_n").alias("best_n"), pick(first, "best_first").alias("best_first"), pick(s, "best_last").alias("best_last"))

    return F.aggregate(F.array_sort(spots), start, step, lambda a: F.struct(a["best_n"].alias("n"), a["best_first"].alias("first"), a["best_last"].alias("last")))


def once(value: Column) -> Column:
    """A generator of just this value: what stands above uses the result and does not repeat the expression."""
    return F.explode(F.array(value))


def both_kinds(rows: DataFrame, *keep: str, spelled: str = NUMBER) -> DataFrame:
    """The columns to keep, t (tokens of the template) and v (plain tokens) of a column text."""
    plain = rows.select(*keep, once(plain_tokens(F.col("text"))).alias("plain"))
    lines = plain.select(*keep, "plain", once(template(F.col("plain"), spelled)).alias("t")).select(*keep, "t", once(words(F.col("plain"))).alias("v"))
    return lines.select(*keep, tokens(F.col("t")).alias("t"), tokens(F.col("v")).alias("v"))


def sides(split: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep, plain, of: a row for the tokens of the template and one for the plain tokens."""
    kinds = F.array(F.struct(F.lit(False).alias("plain"), F.col("t").alias("of")), F.struct(F.lit(True).alias("plain"), F.col("v").alias("of")))
    return split.select(*keep, F.explode(kinds).alias("k")).select(*keep, "k.plain", "k.of")


def benchmark_windows(items: DataFrame) -> DataFrame:
    """item_id, plain, width, need, n, spot, h: the n windows of an item, with the first place of each distinct one, of its template (with enough literal tokens) and of its plain tokens.

    All widths go through one plan, and it is read from the shared folder afterwards: what stands above would repeat it, and the driver compiles each copy.
    """
    split = both_kinds(items, "item_id", spelled=SPELLED).withColumn("width", F.least(F.size("t"), F.lit(WINDOW))).filter("width > 0")
    own = sides(split, "item_id", "width").filter(F.col("plain") | (F.col("width") >= LEAST_TOKENS))
    at = own.select("item_id", "plain", "width", F.posexplode(windows(F.col("of"), F.col("width"))).alias("p", "w"))
    literal = sum((F.when(c.isNull() | (is_slot(c) & ~is_soft(c)), 0).otherwise(1) for c in window_tokens("w")), F.lit(0))
    hashed = F.xxhash64("plain", *[F.when(c == SPELLED, NUMBER).otherwise(c) for c in window_tokens("w")])  # as in documents
    kept = at.filter(F.col("plain") | (literal >= LITERALS)).select("item_id", "plain", "width", hashed.alias("h"), (F.col("p") + 1).cast("long").alias("spot"))
    first = spool(kept.groupBy("item_id", "plain", "width", "h").agg(F.min("spot").alias("spot")), "benchmark-places")
    told = first.groupBy("item_id", "plain", "width").agg(F.count("*").alias("n"), F.collect_set("spot").alias("spots"))
    most = F.when(F.col("plain"), best_run(F.col("spots"), F.col("width"))["n"]).otherwise(F.col("n"))
    need = told.select(F.col("item_id").alias("own_item"), F.col("plain").alias("own_kind"), F.least(F.lit(HITS), most).cast("long").alias("need"), "n")
    return first.join(need, F.col("item_id").eqNullSafe(F.col("own_item")) & (F.col("plain") == F.col("own_kind"))).drop("own_item", "own_kind")


def with_late(bench: DataFrame) -> DataFrame:
    """Marks windows that more than COMMON_ITEMS items share as late, but for the n - need + 1 rarest of each item: whatever holds `need` windows
    of an item holds one of those."""
    counted = bench.join(bench.groupBy("h").agg(F.count("*").alias("items")), "h")
    rank = F.row_number().over(Window.partitionBy("item_id", "plain").orderBy("items", "h"))
    return counted.withColumn("late", (F.col("items") > COMMON_ITEMS) & (rank > F.col("n") - F.col("need") + 1)).drop("items", "n")


def document_windows(split: DataFrame, widths: list[int]) -> DataFrame:
    """doc_id, text_key, p, h of every window of both kinds and of these widths. The hash tells kinds and widths apart: a join on one long is the quickest."""
    own = sides(split, "doc_id", "text_key")
    width = F.lit(widths[0])
    if len(widths) > 1:
        own, width = own.withColumn("width", F.explode(F.array(*map(F.lit, widths)))), F.col("width")
    placed = own.select("doc_id", "text_key", "plain", F.posexplode(windows(F.col("of"), width)).alias("p", "w"))
    return placed.select("doc_id", "text_key", "p", F.xxhash64("plain", *window_tokens("w")).alias("h"))


def hits_of(keyed: DataFrame, bench: DataFrame, widths: list[int], small: bool) -> DataFrame:
    """doc_id, text_key, item_id, plain, need, offset, spot, width: windows that documents and items share.

    Late windows would pair documents with many items that they share one phrase with. They are looked up afterwards, for pairs that share another.
    """
    near = lambda df: F.broadcast(df) if small else df

    def placed(docs: DataFrame) -> DataFrame:
        return document_windows(both_kinds(docs, "doc_id", "text_key"), sorted(widths) or [WINDOW])

    def put(met: DataFrame) -> DataFrame:
        return met.select("doc_id", "text_key", "item_id", "plain", "need", (F.col("p") + 1 - F.col("spot")).alias("offset"), "spot", "width")

    early, late = bench.filter("NOT late").drop("late"), bench.filter("late").drop("late")
    hits = put(placed(keyed).join(near(early), "h"))
    if late.limit(1).count() == 0:
        return hits
    hits = spool(hits, "hits")
    pairs = hits.select("doc_id", "text_key", "item_id", "plain").distinct()
    wanted = pairs.join(near(late), ["item_id", "plain"]).withColumnRenamed("doc_id", "own_doc")  # item_id is a key of a text, never null
    holders = pairs.select(F.col("doc_id").alias("own_doc"), F.col("text_key").alias("own_key")).distinct()
    held = keyed.join(holders, F.col("doc_id").eqNullSafe(F.col("own_doc")) & (F.col("text_key") == F.col("own_key")), "left_semi")
    same = F.col("doc_id").eqNullSafe(F.col("own_doc"))
    again = ["text_key", "h"]
    by_pair = placed(held).alias("o").join(wanted.alias("w"), same & F.expr(" AND ".join(f"o.{c} = w.{c}" for c in again))).select("o.*", "w.item_id", "w.plain", "w.need", "w.spot", "w.width")
    return hits.unionByName(put(by_pair))


def by_kind(text: Column) -> Column:
    """The tokens that the places of an alignment count."""
    plain = plain_tokens(text)
    return tokens(F.when(F.col("plain"), words(plain)).otherwise(values(plain)))


def readings() -> Column:
    """strict, n_windows, first, behind: an alignment with all its windows, and with those that keep the item's soft slots, where one changed.

    Plain windows have no changed slot.
    """
    everything = F.struct(F.lit(False).alias("strict"), "n_windows", "first", "behind")
    places = F.sequence(F.col("first"), F.col("behind") - 1)
    at = lambda of, p: F.get(F.col(of), (p - 1).cast("int"))
    changed = F.filter(places, lambda p: is_soft(at("item_template", p)) & (at("item_values", p) != at("doc_values", p + F.col("offset"))))
    kept = F.filter("spots", lambda s: ~F.exists(changed, lambda p: (p >= s) & (p < s + F.col("width"))))
    strict = F.struct(F.lit(True).alias("strict"), F.size(kept).cast("long").alias("n_windows"), F.array_min(kept).alias("first"), (F.array_max(kept) + F.col("width")).alias("behind"))
    return F.when(~F.col("plain") & (F.size(changed) > 0), F.array(everything, strict)).otherwise(F.array(everything))


def best_matches(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, bool, DataFrame]:
    """doc_id, text_key, item_key, best (n_windows, same, place, n_slots) for each document and text of an item that it holds; if the benchmark
    is small enough to be broadcast; and its windows. ids: item_id, item_key, text."""
    items = ids.select(F.col("item_key").alias("item_id"), "text").dropDuplicates(["item_id"])  # items of the same text are compared once
    bench = spool(with_late(benchmark_windows(items)), "benchmark-windows")
    widths = [r["width"] for r in bench.select("width").distinct().collect()]  # WINDOW values at most
    size = ids.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("bytes")).first()["bytes"]
    small = size <= BROADCAST_BYTES and bench.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    hits = hits_of(keyed, bench, widths, small)
    aligned = hits.groupBy("doc_id", "text_key", "item_id", "plain", "offset", "width").agg(F.collect_set("spot").alias("spots"), F.max("need").alias("need"))
    aligned = aligned.filter(F.size("spots") >= F.col("need"))
    whole = F.struct(F.size("spots").cast("long").alias("n"), F.array_min("spots").alias("first"), F.array_max("spots").alias("last"))
    told = aligned.withColumn("run", F.when(F.col("plain"), best_run(F.col("spots"), F.col("width"))).otherwise(whole)).filter("run.n >= need")
    keep = ["doc_id", "text_key", "item_id", "plain", "offset", "spots", "width", "need"]
    enough = told.select(*keep, F.col("run.n").alias("n_windows"), F.col("run.first").alias("first"), (F.col("run.last") + F.col("width")).alias("behind"))

    item_side = items.select(F.col("item_id").alias("own_item"), F.col("text").alias("item_text"))
    doc_side = keyed.withColumnRenamed("doc_id", "own_doc").withColumnRenamed("text_key", "own_key")
    both = doc_side.join(enough, F.col("own_doc").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("text_key")))
    both = both.select(*keep, "n_windows", "first", "behind", by_kind(F.col("text")).alias("doc_values"))
    both = both.join(F.broadcast(item_side) if small else item_side, F.col("own_item").eqNullSafe(F.col("item_id")))
    own = plain_tokens(F.col("item_text"))
    both = both.withColumns({"item_values": by_kind(F.col("item_text")), "item_template": tokens(F.when(F.col("plain"), spelled_template(own)).otherwise(template(own, SPELLED)))})
    each = both.withColumn("reading", F.explode(readings())).filter("reading.n_windows >= need")
    each = each.withColumns({c: F.col(f"reading.{c}") for c in ("strict", "n_windows", "first", "behind")})
    length = (F.col("behind") - F.col("first")).cast("int")
    start = F.col("first").cast("int")
    zipped = F.arrays_zip(F.slice("item_template", start, length).alias("kind"), F.slice("item_values", start, length).alias("item"), F.slice("doc_values", (F.col("first") + F.col("offset")).cast("int"), length).alias("doc"))
    slots = each.withColumn("slots", F.filter(zipped, lambda s: is_slot(s["kind"]) & ~(F.col("strict") & is_soft(s["kind"]))))
    pairs = F.array_distinct("slots")
    one_way = F.size(pairs) == F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s["item"]))))
    changed = F.size(F.filter("slots", lambda s: s["item"] != s["doc"]))
    consistent = slots.filter(one_way | (changed == 0))
    best = consistent.select("doc_id", "text_key", F.col("item_id").alias("item_key"), F.struct("n_windows", (-changed).alias("same"), (-F.col("offset")).alias("place"), F.size("slots").alias("n_slots")).alias("best"))
    return best.groupBy("doc_id", "text_key", "item_key").agg(F.max("best").alias("best")), small, bench


def keyed_items(items: DataFrame) -> DataFrame:
    return items.select("item_id", F.xxhash64("text").alias("item_key"), "text").dropDuplicates()


def figures() -> list[Column]:
    return [F.col("best.n_windows").alias("n_windows"), F.col("best.n_slots").cast("long").alias("n_slots"), (-F.col("best.same")).cast("long").alias("n_changed")]


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_key, item_id, n_windows, n_slots, n_changed for each document that holds a benchmark item or a good part of it.

    A good part is an alignment of enough template windows with consistent slots, or a run of enough plain windows without a gap.

    n_windows: windows in the best alignment; n_slots: placeholders there; n_changed: those whose value differs from the item's.
    docs needs doc_id and text, items item_id and text; other columns are ignored, whatever their names. Null and empty texts match
    nothing. Repeated rows give one row; an item of several texts is found
    by any of them, items of equal texts by the same, and each id has one row for a document. A null doc_id or item_id is
    carried along as null. Whole texts of any length are compared; among equally good alignments the one with fewer changed slots, then the first, is shown.
    """
    ids = keyed_items(items)
    best, small, _ = best_matches(docs, ids)
    named = ids.select("item_id", "item_key")
    told = best.join(F.broadcast(named) if small else named, "item_key").groupBy("doc_id", "text_key", "item_id").agg(F.max("best").alias("best"))
    return told.select("doc_id", "text_key", "item_id", *figures())


def item_classes(items: DataFrame, bench: DataFrame | None = None) -> DataFrame:
    """item_id, item_key, class_key, class_id: items of one template are one class, by its least item_id. Items without template windows are a class
    with those of the same text. An item of several texts is in the class of each; class_id is null where no item of the class has an id. bench: the windows of the items, by item_key, if they are at hand."""
    ids = keyed_items(items)
    texts = ids.select(F.col("item_key").alias("item_id"), "text").dropDuplicates(["item_id"])
    having = (benchmark_windows(texts) if bench is None else bench).filter("NOT plain").select(F.col("item_id").alias("item_key"), F.lit(True).alias("has")).distinct()
    lines = both_kinds(texts.withColumnRenamed("item_id", "item_key"), "item_key").select("item_key", F.xxhash64("t").alias("line"))
    keys = lines.join(having, "item_key", "left").select("item_key", F.when(F.col("has"), F.col("line")).otherwise(F.col("item_key")).alias("class_key"), F.coalesce("has", F.lit(False)).alias("by_line"))
    placed = ids.select("item_id", "item_key").join(keys, "item_key")
    least = placed.groupBy("class_key", "by_line").agg(F.min("item_id").alias("class_id"))
    return placed.join(least, ["class_key", "by_line"]).select("item_id", "item_key", F.xxhash64("class_key", "by_line").alias("class_key"), "class_id")


def leak_classes(docs: DataFrame, items: DataFrame) -> DataFrame:
    """As `leaks`, with one row for a document and a class of items (`item_classes`), so that the variants of a template give one row and not a row each.

    doc_id, text_key, class_id, item_id (of the best alignment, the least of equals), n_items (distinct ids of the class), n_windows, n_slots, n_changed.
    """
    ids = keyed_items(items)
    best, small, bench = best_matches(docs, ids)
    placed = spool(item_classes(items, bench), "item-classes")
    of_text = placed.groupBy("item_key").agg(F.min("class_key").alias("class_key"), F.min("item_id").alias("item_id"))
    of_class = placed.groupBy("class_key").agg(F.min("class_id").alias("class_id"), F.countDistinct("item_id").alias("n_items"))
    named = of_text.join(of_class, "class_key")
    met = best.join(F.broadcast(named) if small else named, "item_key")
    order = F.struct("best", F.col("item_id").isNull().alias("last"), (-F.coalesce("item_id", F.lit(0))).alias("least"))
    told = met.groupBy("doc_id", "text_key", "class_key").agg(F.max("best").alias("best"), F.max_by("item_id", order).alias("item_id"), F.first("class_id").alias("class_id"), F.first("n_items").alias("n_items"))
    return told.select("doc_id", "text_key", "class_id", "item_id", "n_items", *figures())


def verbatim_only(items: DataFrame) -> DataFrame:
    """item_id of the items that have no template window, as too few of their tokens are literal: they are found by their values only."""
    told = benchmark_windows(items.select("item_id", "text").dropDuplicates()).filter("NOT plain").select(F.col("item_id").alias("own_item")).distinct()
    return items.select("item_id").distinct().join(told, F.col("item_id").eqNullSafe(F.col("own_item")), "left_anti")


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns."""
    doc, key = free_names(docs, "gone_doc", "gone_key")
    best, _, _ = best_matches(docs, keyed_items(items))
    gone = best.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(key)), "left_anti")
