"""Personal data: base patterns, and terms that reveal what they stand beside. DataFrame functions only.

Base spans are the leftmost matches, without overlap, of one pattern per kind. The patterns here match what the plain
ones do, written so that the engine neither recurses nor scans a run of characters again from each of its places.
Places come from the pieces between matches, so they count code points.

Information-theoretic part: an entity is a base span's kind and value; a term is a word, anywhere in a text. Copies are no
evidence: a rare word of a text that is there twice stands beside the text's entities each time. So all documents are put
into classes of equal and nearly equal texts (those that share neighbours in a bottom sketch of hashed 5-word runs, and
what these connect), and one text stands for each class in all counts. Over these N, df(t) counts those that hold the
term, n(t, e) those that hold the entity too (so also those that hold the term beside it). A term discloses an entity if P(e | t) = n(t, e) / df(t) reaches MIN_DISCLOSURE and the pointwise mutual
information log2(n(t, e) * N / (df(t) * df(e))) reaches MIN_BITS, with n(t, e) of MIN_SUPPORT at least. All its
occurrences in all documents become spans of the kind "term". sanitise() puts placeholders in the place of base spans,
generalises terms that disclose several entities and removes those that disclose one.

Pairs are counted in documents with entities alone. P(e | t) >= p bounds df(t) by n(t, e) / p <= df(e) / p, so more frequent
words meet no entity. Entities, and terms, that stand in the same documents are one class there: a page of thousands of
addresses is one pair of classes, not the product of its words and addresses. df(t) is then counted over all texts for the
terms of such pairs, which a Bloom filter sized by their number picks out.

Defined results: a null or empty text has no spans (base_sha256 is that of the empty string); repeated rows give
repeated results and count as one document; an empty table gives an empty table; other columns are not
looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chimerant.llm.common import components, cut, join_hot

MIN_SUPPORT, MIN_DISCLOSURE, MIN_BITS = 3, 0.5, 4.0
#: Bits used of a word of the filter of terms, its least and most words (16 MB), the bits that a term has of its own, and those it sets.
BITS, LEAST_MARKS, MOST_MARKS, OWN_BITS, HASHES = 63, 1 << 12, 1 << 21, 32, 3
#: Words of a hashed run, and hashes of a text's sketch.
RUN, SKETCH = 5, 8
#: Words of a text whose places are summed up together.
CHUNK = 500

# ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# The kinds in their order, and their patterns.
KINDS = ["email", "ip", "card", "phone", "term"]
PATTERNS = {
    # A local part starts where a run of its characters starts, or where the last match ended inside one.
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?=\.\.|\.?(?![A-Za-z0-9.-]))",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?=[ -]?[0-9])[0-9 -]*?(?<=[0-9])(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
SPACE = r"[\x20\x09-\x0D]"
SPAN = "array<struct<start:int,end:int,value:string>>"


def find(text: Column, pattern: str) -> Column:
    """All matches as (start, end, value), by the lengths of matches and of the pieces between them."""
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    steps = F.zip_with(pieces, matches, lambda a, b: F.struct(F.length(a).alias("gap"), b.alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(F.length(x["value"]), F.lit(0))
        return F.struct(end.alias("at"), F.when(x["value"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"))))).alias("found"))

    return F.aggregate(steps, start, step, lambda acc: acc["found"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, i, F.lit(1))) - 48
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    value = s["value"]
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(F.concat(F.lit("000"), p), F.lit(3)).try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        return F.when(F.length(_digits(value)).between(12, 19), luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """The spans of one kind that pass its test. Texts without a character that the kind needs are not searched."""
    needed = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike("[0-9]"))
    return F.when(needed, F.filter(find(text, PATTERNS[kind]), lambda s: _valid(kind, s))).otherwise(F.array().cast(SPAN))


def entity_of(s: Column) -> Column:
    """A base span's kind and value."""
    value = F.when(s["kind"] == 0, F.lower(s["value"])).when(s["kind"] == 1, s["value"]).otherwise(_digits(s["value"]))
    return F.concat(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), F.lit(":"), value)


def term_of(word: Column) -> Column:
    """A word without the punctuation around it, in lower case."""
    return F.lower(F.btrim(word, F.lit(PUNCTUATION)))


def _keyed(docs: DataFrame) -> DataFrame:
    """uid, doc_id, text; doc_id may repeat."""
    return docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _located(docs: DataFrame) -> DataFrame:
    """uid, doc_id, text, base array<start, kind number, end, value> of each row."""
    rows = docs.withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.select("*", *(base_spans(F.col("text"), k).alias(k) for k in KINDS[:4]))
    numbered = lambda i: lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"), s["value"].alias("value"))
    spans = F.concat(*(F.transform(k, numbered(i)) for i, k in enumerate(KINDS[:4])))
    return rows.select("uid", "doc_id", "text", F.array_sort(spans).alias("base"))


def _usable(term: Column) -> Column:
    return (F.length(term) > 1) & ~term.rlike("[0-9@]")


def _terms(located: DataFrame) -> DataFrame:
    """(uid, term) of the words of whole texts that may be terms, each once for a row."""
    words = F.array_distinct(F.transform(F.split("text", SPACE), term_of))
    return located.select("uid", F.explode(words).alias("term")).filter(_usable(F.col("term")))


def _marked_terms(located: DataFrame, marks: DataFrame) -> DataFrame:
    """(uid, terms): the marked words of each text, each once, found where the text is."""
    words = F.filter(F.transform(F.split("text", SPACE), term_of), _is_marked)
    return located.join(F.broadcast(marks)).select("uid", F.filter(F.array_distinct(words), _usable).alias("terms"))


def _bit(term: Column, k: int) -> tuple[Column, Column]:
    """The word of the marks, and the place in it, of a term's bit number k."""
    at = F.pmod(F.xxhash64(term, F.lit(k)), F.col("n_marks") * BITS)
    return F.floor(at / BITS).cast("int"), (at % BITS).cast("int")


def _marked(terms: DataFrame) -> DataFrame:
    """One row with `marks` and their number, `n_marks`: a Bloom filter of OWN_BITS bits for each term, HASHES of which it sets. All
    terms pass, others seldom: it saves work, and decides nothing. MOST_MARKS bounds what is broadcast."""
    words = LEAST_MARKS
    while words < MOST_MARKS and words * BITS < OWN_BITS * terms.count():
        words *= 2
    sized = terms.withColumn("n_marks", F.lit(words))
    each = F.array(*(F.struct(word.alias("id"), place.alias("place")) for word, place in (_bit(F.col("term"), k) for k in range(HASHES))))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x.place"))
    set_bits = sized.select(F.explode(each).alias("x")).select("x.id", bit.alias("b")).groupBy("id").agg(F.bit_or("b").alias("b"))
    every = terms.sparkSession.range(words).join(set_bits, "id", "left").agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("b", F.lit(0).cast("long")).alias("b")))).alias("all"))
    return cut(every.select(F.transform("all", lambda x: x["b"]).alias("marks"), F.lit(words).alias("n_marks")), "pii-marks")


def _is_marked(term: Column) -> Column:
    bits = [F.getbit(F.element_at("marks", word + 1), place) == 1 for word, place in (_bit(term, k) for k in range(HASHES))]
    return reduce(lambda a, b: a & b, bits)


def sketch(text: Column, run: int = RUN, size: int = SKETCH) -> Column:
    """The smallest hashes of a text's runs of words, ascending; shorter texts have fewer, or none."""
    hashes = F.transform(F.filter(F.split(F.lower(text), SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))
    runs = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - run), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(run))))
    # An array of one, so that the words are hashed once and not in each run again.
    return F.flatten(F.transform(F.array(hashes), lambda h: F.when(F.size(h) >= run, F.slice(F.array_sort(F.array_distinct(runs(h))), 1, size)).otherwise(F.array().cast("array<bigint>"))))


def representatives(located: DataFrame) -> DataFrame:
    """(uid): one row of each class of equal and nearly equal texts, the one of the smallest hash, whatever copies there are.

    Nearly equal texts share two hashes that are neighbours in their sketches, most of which an edit leaves alone; classes are
    the components of that. Texts of fewer than two runs are equal or different."""
    sketched = cut(located.select("uid", F.xxhash64("text").alias("th"), sketch(F.col("text")).alias("s")), "pii-sketches")  # texts themselves don't move
    texts = cut(sketched.groupBy("th").agg(F.min("uid").alias("uid"), F.first("s").alias("s")), "pii-texts")
    pairs = F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.xxhash64(F.element_at("s", i), F.element_at("s", i + 1)))
    bands = cut(texts.filter(F.size("s") > 1).select("th", F.explode(pairs).alias("band")), "pii-bands")
    first = cut(bands.groupBy("band").agg(F.min("th").alias("a"), F.count(F.lit(1)).alias("k")).filter("k > 1"), "pii-first")
    near = components(join_hot(bands, first, "band", "k").select("a", F.col("th").alias("b")).filter("a <> b").distinct(), "pii-classes")
    return cut(texts.join(near.filter("node <> comp").select(F.col("node").alias("th")), "th", "left_anti").select("uid"), "pii-representatives")


def _same_rows(rows: DataFrame, of: str, *more: Column) -> DataFrame:
    """Of rows (uid, `of`): (`of`, n, a, b); those with equal n, a and b stand in the same rows."""
    return rows.groupBy(of).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("uid")).alias("a"), F.bit_xor(F.xxhash64("uid", F.lit(1))).alias("b"), *more)


def disclosing(located: DataFrame, once: DataFrame, support: int = MIN_SUPPORT, disclosure: float = MIN_DISCLOSURE, bits: float = MIN_BITS) -> DataFrame:
    """(term, n_t, entities): the terms that exceed the thresholds, the texts that hold them, and how many entities they disclose.

    located: rows of _located(), stored; once: (uid) of those that are counted."""
    with_entities = located.filter(F.size("base") > 0)
    held = with_entities.select("uid", F.explode("base").alias("s")).select("uid", entity_of(F.col("s")).alias("entity")).distinct()
    held = cut(held.join(once, "uid", "left_semi"), "pii-held")
    entities = cut(_same_rows(held, "entity").filter(F.col("n") >= support), "pii-entities")
    groups = entities.groupBy("n", "a", "b").agg(F.min("entity").alias("entity"), F.count(F.lit(1)).alias("entities"))
    groups = cut(groups.select("entity", F.col("n").alias("n_e"), "entities"), "pii-entity-classes")
    held = cut(join_hot(held, groups, "entity", "n_e").select("uid", "entity", "n_e", "entities"), "pii-held-classes")
    n = once.count()
    pmi = lambda n_t: F.log2(F.col("n_te") * F.lit(n) / (n_t * F.col("n_e")))
    most = (groups.agg(F.max("n_e")).first()[0] or 0) / disclosure
    near = cut(_terms(with_entities.join(held.select("uid").distinct(), "uid", "left_semi")), "pii-near")
    terms = cut(_same_rows(near, "term").filter(F.col("n").between(support, most)), "pii-near-terms")
    classes = cut(terms.groupBy("n", "a", "b").agg(F.min("term").alias("of")), "pii-term-classes")
    named = cut(terms.join(classes, ["n", "a", "b"]).select("term", "of"), "pii-term-names")
    rows = near.join(classes.select(F.col("of").alias("term"), F.col("n").alias("n_h")), "term")
    counted = rows.join(held, "uid").groupBy("entity", F.col("term").alias("of")).agg(F.count(F.lit(1)).alias("n_te"), F.first("n_h").alias("n_h"), F.first("n_e").alias("n_e"), F.first("entities").alias("entities"))
    # A term has n_h texts at least, those with entities; so what fails with these fails with all.
    counted = cut(counted.filter((F.col("n_te") >= support) & (F.col("n_te") / F.col("n_h") >= disclosure) & (pmi(F.col("n_h")) >= bits)), "pii-counted")
    wanted = cut(named.join(counted.select("of").distinct(), "of", "left_semi"), "pii-wanted")
    # A row for each text meets the texts that count, not one for each of its words.
    everywhere = _marked_terms(located, _marked(wanted.select("term"))).join(once, "uid", "left_semi").select(F.explode("terms").alias("term"))
    df = cut(everywhere.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")), "pii-df")
    scored = counted.join(wanted, "of").join(df, "term").filter((F.col("n_te") / F.col("n_t") >= disclosure) & (pmi(F.col("n_t")) >= bits))
    return scored.groupBy("term").agg(F.first("n_t").alias("n_t"), F.sum("entities").alias("entities"))


def _places(words: Column) -> Column:
    """(start, end, term) of the marked words of a text, in order; words are one space apart.

    Words are taken in chunks, so that the work is linear in the text, however many are marked."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / CHUNK).cast("int")), lambda c: F.slice(words, c * CHUNK + 1, CHUNK))
    sizes = F.transform(chunks, lambda c: F.length(F.array_join(c, " ")) + 1)
    starts = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    none = F.array().cast("array<struct<start:int,end:int,term:string>>")

    def step(acc: Column, word: Column) -> Column:
        end, term = acc["at"] + F.length(word), term_of(word)
        more = F.concat(acc["found"], F.array(F.struct(acc["at"].alias("start"), end.alias("end"), term.alias("term"))))
        return F.struct((end + 1).alias("at"), F.when(_is_marked(term), more).otherwise(acc["found"]).alias("found"))

    inside = lambda chunk, start: F.aggregate(chunk, F.struct(start.alias("at"), none.alias("found")), step, lambda acc: acc["found"])
    every = F.flatten(F.zip_with(chunks, F.slice(starts, F.lit(1), F.size(chunks)), inside))
    return F.when(F.exists(words, lambda w: _is_marked(term_of(w))), every).otherwise(none)


def _occurrences(located: DataFrame, found: DataFrame) -> DataFrame:
    """(uid, terms array<start, kind number, end, entities>): all places of the terms (term, n_t, entities) in whole texts.

    Places are found where the text is; only those of marked words move."""
    rows = located.select("uid", F.split("text", SPACE).alias("words")).join(F.broadcast(_marked(found.select("term"))))
    places = rows.select("uid", F.explode(_places(F.col("words"))).alias("x")).select("uid", "x.start", "x.end", "x.term")
    places = cut(places, "pii-places")
    span = F.struct("start", F.lit(4).alias("kind"), "end", "entities")
    counts = cut(places.groupBy("term").agg(F.count(F.lit(1)).alias("k")).join(found, "term"), "pii-term-places")  # places are of all rows, copies too
    return join_hot(places, counts, "term", "k").groupBy("uid").agg(F.array_sort(F.collect_list(span)).alias("terms"))


def find_personal_data(docs: DataFrame, support: int = MIN_SUPPORT, disclosure: float = MIN_DISCLOSURE, bits: float = MIN_BITS, keyed: bool = False) -> DataFrame:
    """uid, doc_id, base (start, kind number, end, value) and terms (start, kind number, end, entities) of each row.

    keyed: docs already has uid, a key."""
    located = cut(_located(docs if keyed else _keyed(docs)), "pii")
    found = cut(disclosing(located, representatives(located), support, disclosure, bits), "pii-terms")
    terms = _occurrences(located, found)
    return located.select("uid", "doc_id", "base").join(terms, "uid", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<start:int,kind:int,end:int,entities:bigint>>")))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """doc_id, counts of each kind, base_sha256 and spans."""
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    of_kind = lambda i: lambda s: s["kind"] == i
    counts = [F.size(F.filter("base", of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(listed(bare("base")), 256).alias("base_sha256"), listed(F.concat(bare("base"), bare("terms"))).alias("spans"), F.size("terms").cast("long").alias("n_term"))


def sanitise(docs: DataFrame, **thresholds: float) -> DataFrame:
    """doc_id and text: base spans become [KIND], terms that disclose one entity go, others become [TERM].

    Overlapping spans are replaced as the first of them."""
    rows = cut(_keyed(docs), "pii-docs")
    found = find_personal_data(rows, keyed=True, **thresholds)
    labels = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    put = F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(labels, s["kind"] + 1).alias("label"))),
        F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["entities"] > 1, "[TERM]").otherwise("").alias("label"))),
    )
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        return F.struct(F.when(fresh, s["end"]).otherwise(acc["at"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["label"])).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("put", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    spans = found.select("uid", F.array_sort(put).alias("put")).filter(F.size("put") > 0)
    return rows.join(spans, "uid", "left").select("doc_id", F.when(F.col("put").isNull(), text).otherwise(done).alias("text"))
