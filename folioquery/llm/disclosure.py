"""Personal data: fixed kinds by pattern, and words that reveal them by corpus co-occurrence.

Base spans are e-mail addresses, network addresses, card and phone numbers. What one of them says (the entity)
is protected. A word (any run of letters outside base spans) discloses an entity as far as seeing the word tells which
entity is meant: with document counts over the whole corpus, the normalised pointwise mutual information of word and
entity, wherever the two stand in a document. Words that share at least `min_docs` documents with one entity and reach
`generalise` are given as spans of kind "term" at every place in every document; `sanitise` replaces them by a class,
and deletes those that reach `remove`.

Counts are of hashed words and entities, added up in part before they are sent. Pairs are only made of words and
entities whose own counts can still reach `min_docs` and `generalise`.

Positions come from built-in functions alone: the pieces between the matches of a pattern and the matches
themselves alternate, so a running sum of their lengths is where each match starts. The sum is taken in blocks,
which keeps texts with very many matches cheap.

Defined results: a null text is an empty one; a null doc_id stays null; rows with the same doc_id and text are
one document and get the same spans; an empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The kinds in order, as Java patterns. Each equals the plain form in the comment; possessive
#: quantifiers and the look-behind only spare steps back on long runs (a match that begins inside a run would
#: also begin at the run's start, or where the last match ended).
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has none of the kind.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
KINDS = list(PATTERNS)
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}$"
WORD = r"\p{L}+"
MIN_DOCS, GENERALISE, REMOVE = 3, 0.7, 0.9
BLOCK = 128


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, v: a + v)


def with_starts(df: DataFrame, kind: str, wanted: Callable[[Column], Column] = lambda _: F.lit(True)) -> DataFrame:
    """Adds __{kind}: an array of (start, value) of all wanted matches of the kind in __text, in order."""
    text, name, pattern = F.col("__text"), f"__{kind}", PATTERNS.get(kind, WORD)
    seen = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(HINTS.get(kind, WORD))
    none = F.array().cast("array<string>")
    df = df.withColumn(f"{name}_m", F.when(seen, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    n = F.size(f"{name}_m")
    df = df.withColumn(f"{name}_p", F.when(n > 0, F.transform(F.split(text, pattern, -1), lambda x: F.length(x))).otherwise(F.array().cast("array<int>")))
    # Lengths of each piece with the match after it, their sums by block, and the sums before each block.
    df = df.withColumn(f"{name}_l", F.zip_with(F.slice(f"{name}_p", 1, n), f"{name}_m", lambda p, m: p + F.length(m)))
    blocks = F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))
    df = df.withColumn(f"{name}_b", F.when(n > 0, F.transform(blocks, lambda b: total(F.slice(f"{name}_l", b * BLOCK + 1, F.lit(BLOCK))))).otherwise(F.array().cast("array<int>")))
    df = df.withColumn(f"{name}_s", F.transform(F.col(f"{name}_b"), lambda _, i: total(F.slice(f"{name}_b", F.lit(1), i))))

    def at(value: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        # Named twice, so that the sums are not moved in here and made anew for each match.
        before = F.when(F.size(f"{name}_s") > block, F.get(F.col(f"{name}_s"), block)) + total(F.slice(f"{name}_l", block * BLOCK + 1, i % BLOCK))
        return F.struct((before + F.get(F.col(f"{name}_p"), i)).alias("start"), value.alias("value"))

    numbered = F.transform(f"{name}_m", lambda m, i: F.struct(m.alias("value"), i.alias("i")))
    df = df.withColumn(name, F.transform(F.filter(numbered, lambda x: wanted(x["value"])), lambda x: at(x["value"], x["i"])))
    return df.drop(*[f"{name}_{x}" for x in "mplbs"])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(number, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when((F.length(number) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    number = digits(value)
    return {
        "email": F.lit(True),
        "ip": value.rlike(OCTETS),
        "card": F.when(F.length(number).between(12, 19), luhn(number)).otherwise(F.lit(False)),
        "phone": F.length(number).between(9, 15),
    }[kind]


def masked(text: Column, spans: Column) -> Column:
    """The text with blanks in place of base spans."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(acc: Column, s: Column) -> Column:
        begin = F.greatest(acc["at"], s["start"])
        new = F.concat(acc["out"], F.substring(text, acc["at"] + 1, begin - acc["at"]), F.repeat(F.lit(" "), s["end"] - begin))
        return F.when(s["end"] > acc["at"], F.struct(s["end"].alias("at"), new.alias("out"))).otherwise(acc)

    cut = F.aggregate(spans, start, put, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, cut).otherwise(text)


def word_hash(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def base_spans(docs: DataFrame) -> DataFrame:
    """id, h, spans: (start, kind_no, end, kind, entity) by start, then kind; and words: the hashed words, each once.

    A row for each document, however often the table repeats it.
    """
    df = docs.select(common.id_key().alias("id"), F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("__text"))
    for kind in KINDS:
        df = with_starts(df, kind)

    def spans(kind: str) -> Column:
        def span(m: Column) -> Column:
            end = m["start"] + F.length(m["value"])
            entity = F.concat(F.lit(f"{kind}:"), F.lower(m["value"]) if kind in ("email", "ip") else digits(m["value"]))
            return F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind"), entity.alias("entity"))

        return F.transform(F.filter(f"__{kind}", lambda m: valid(kind, m["value"])), span)

    df = df.select("id", "h", "__text", F.array_sort(F.concat(*[spans(k) for k in KINDS])).alias("spans"))
    df = df.withColumn("__text", masked(F.col("__text"), F.col("spans")))
    words = F.array_distinct(F.transform(F.regexp_extract_all("__text", F.lit(WORD), F.lit(0)), word_hash))
    return df.select("id", "h", "spans", words.alias("words")).dropDuplicates(["id", "h"])


def disclosing(base: DataFrame, min_docs: int, generalise: float) -> DataFrame:
    """A row (word_h, disclosure) for each word that discloses an entity, with the most that it discloses of any."""
    entity = F.explode(F.array_distinct(F.transform("spans", lambda s: F.xxhash64(s["entity"])))).alias("entity_h")
    n_all = float(base.count() or 1)
    entities = base.select(entity).groupBy("entity_h").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= min_docs)
    entities = common.cut(entities, "pii-entities")
    most = float(entities.agg(F.max("n_entity")).first()[0] or 1)
    words = base.select(F.explode("words").alias("word_h")).groupBy("word_h").agg(F.count("*").alias("n_word")).where(F.col("n_word") >= min_docs)
    # A word in more documents than any entity reaches at most ln(n_all / n_word) / ln(n_all / most).
    reach = F.ln(n_all / F.col("n_word")) + 1e-9 >= F.lit(generalise) * F.ln(F.lit(n_all / most))
    words = common.cut(words.where((F.col("n_word") <= most) | reach), "pii-words")
    pairs = common.possible(base.where("size(spans) > 0").select("words", entity), entities, "entity_h")
    pairs = common.possible(pairs.select("entity_h", F.explode("words").alias("word_h")), words, "word_h")
    pairs = common.cut(pairs.groupBy("entity_h", "word_h").agg(F.count("*").alias("n_pair")).where(F.col("n_pair") >= min_docs), "pii-pairs")
    joined = pairs.join(words, "word_h").join(entities, "entity_h")
    p_pair = F.col("n_pair") / n_all
    pmi = F.log2(F.col("n_pair") * n_all / (F.col("n_word") * F.col("n_entity")))
    share = F.when(p_pair >= 1, F.lit(0.0)).otherwise(pmi / -F.log2(p_pair))
    return joined.groupBy("word_h").agg(F.max(share).alias("disclosure")).where(F.col("disclosure") >= generalise)


def marked_terms(docs: DataFrame, base: DataFrame, told: DataFrame) -> DataFrame:
    """A row (id, h, terms) for each document with disclosing words: all their places."""
    hits = common.possible(base.select("id", "h", F.explode("words").alias("word_h")), told, "word_h").join(told, "word_h")
    hits = common.cut(hits.groupBy("id", "h").agg(F.map_from_entries(F.collect_list(F.struct("word_h", "disclosure"))).alias("told")), "pii-hits")
    texts = docs.where("text IS NOT NULL").select(common.id_key().alias("id"), F.xxhash64("text").alias("h"), F.col("text").alias("__text"))
    texts = common.possible(texts, hits, "id", "h").dropDuplicates(["id", "h"]).join(hits, ["id", "h"]).join(base.select("id", "h", "spans"), ["id", "h"])
    placed = with_starts(texts.withColumn("__text", masked(F.col("__text"), F.col("spans"))), "word", lambda w: F.map_contains_key("told", word_hash(w)))

    def term(m: Column) -> Column:
        disclosure = F.element_at(F.col("told"), word_hash(m["value"]))
        return F.struct(m["start"].alias("start"), F.lit(len(KINDS)).alias("kind_no"), (m["start"] + F.length(m["value"])).alias("end"), F.lit("term").alias("kind"), disclosure.alias("disclosure"))

    return placed.select("id", "h", F.transform("__word", term).alias("terms"))


def find(docs: DataFrame, min_docs: int = MIN_DOCS, generalise: float = GENERALISE) -> DataFrame:
    """doc_id, id, h, spans (base) and terms: (start, kind_no, end, kind, disclosure) of disclosing words."""
    base = common.cut(base_spans(docs), "pii-base")
    told = common.cut(disclosing(base, min_docs, generalise), "pii-disclosing")
    terms = marked_terms(docs, base, told)
    rows = docs.select("doc_id", common.id_key().alias("id"), F.xxhash64("text").alias("h"))
    return rows.join(base.select("id", "h", "spans"), ["id", "h"]).join(terms, ["id", "h"], "left").select("doc_id", "id", "h", "spans", "terms")


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end"), s["kind"].alias("kind")))


def sanitise(docs: DataFrame, min_docs: int = MIN_DOCS, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """docs with base spans replaced by their kind in brackets, disclosing words by [term], or by nothing."""
    docs = common.plain(docs)
    found = find(docs, min_docs, generalise)
    none = F.array().cast("array<struct<start:int,end:int,by:string>>")
    marks = F.concat(
        F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), s["kind"], F.lit("]")).alias("by"))),
        F.coalesce(F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["disclosure"] >= remove, "").otherwise("[term]").alias("by"))), none),
    )
    found = found.groupBy("id", "h").agg(F.first(F.array_sort(marks)).alias("__marks")).toDF("__id", "__h", "__marks")
    held = docs.withColumns({"__key": common.id_key(), "__text_h": F.xxhash64("text")})
    held = held.join(found, (F.col("__key") == F.col("__id")) & (F.col("__text_h") == F.col("__h")), "left")
    # From left to right; a span inside an earlier one is replaced with it.
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(acc: Column, m: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, m["start"] - acc["at"])
        new = F.struct(m["end"].alias("at"), F.concat(acc["out"], gap, m["by"]).alias("out"))
        longer = F.struct(F.greatest(acc["at"], m["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(m["start"] >= acc["at"], new).otherwise(longer)

    text = F.aggregate("__marks", start, put, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return held.withColumn("__out", text).select(*[F.col("__out").alias("text") if c == "text" else F.col(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [count_of(k) for k in KINDS]
    terms = F.coalesce(bare(F.col("terms")), F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string>>"))
    return found.select("doc_id", *counts, F.sha2(written(F.col("spans")), 256).alias("base_sha256"), written(F.array_sort(F.concat(bare(F.col("spans")), terms))).alias("spans"))


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
