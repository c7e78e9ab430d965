"""I-Match document fingerprints, with DataFrame operations only.

Terms are the lower-cased runs between white space and ASCII punctuation, known by
their 64-bit hashes.  Document frequencies are counted over all documents; the lexicon
is the terms whose share of the documents lies in a band (their inverse document
frequency is neither low nor high).  A term inside stands in ``LEAST_SHARE`` of the
documents or more, so the lexicon has at most 1 / LEAST_SHARE times the mean number of
a document's distinct terms, however large the corpus; it is one literal, a list of
hashes for each of ``BUCKETS`` values of their low bits.  A text's terms inside the lexicon (all its terms, if none is inside)
are made distinct and sorted; several randomised subsets of the lexicon then give
one hash each.  The subsets come in ``LEVELS`` of ``SUBSETS``: on each level they
are disjoint random samples of the lexicon, sixteenths of it on the first, of an
eighth and a sixty-fourth of it on the others, so that short and long texts alike
have subsets with a few of their terms.

The likeness of two fingerprints is 1 if they are equal, else the largest share,
over the levels, of equal hashes among the subsets in which either text has a term
(``LEAST`` at least are counted).

``next_documents`` attaches to every document the next one by descending doc_id:
documents are dealt into ranges of doc_id, each range also gets a copy of the first
document of the range that follows, and a window reads the next row in its range;
one shuffle of the texts does it all.

Defined results: null text is empty; an empty text has no terms, and two texts
without terms are alike; equal texts have equal fingerprints; a null doc_id comes
last in the order; rows with the same doc_id follow each other by a hash of the
text; the only document is its own next; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_partitions, whole_text

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
LEAST_SHARE, MOST_SHARE, LEAST_DOCS = 5e-4, 0.1, 2
SUBSETS = 16
LEVELS = ((0, 15), (4, 127), (11, 1023))  # bits of a term's hash that name its subset: shift, mask
LEAST = 4
COARSE = 256


def terms(text: Column) -> Column:
    """Distinct hashes of the terms."""
    words = F.filter(F.split(F.lower(text), r"[\s\p{Punct}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, least_share: float = LEAST_SHARE, most_share: float = MOST_SHARE) -> str:
    """The hashes of the terms inside the band as JSON: at place b the list of those
    whose low bits are b, without these bits."""
    n = docs.count()
    counts = docs.select(F.explode(terms(whole_text())).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    inside = counts.filter(F.col("df").between(max(LEAST_DOCS, least_share * n), most_share * n))
    high = F.sort_array(F.collect_list(F.shiftright("h", BUCKET_BITS)))
    lists = inside.groupBy(F.col("h").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).agg(F.to_json(high).alias("hs"))
    places = ["[]"] * BUCKETS
    for r in lists.collect():  # at most BUCKETS rows of a bounded number of hashes, see above
        places[r["b"]] = r["hs"]
    return f"[{','.join(places)}]"


def _let(value: Column, then) -> Column:
    """``then`` of the value, which is worked out once for the row."""
    return F.transform(F.array(value), then)[0]


def signatures(own: Column) -> Column:
    """Hash of each subset's terms, level by level; ``own`` is the sorted array of term
    hashes.  A level's subsets are parted by two bits, then by the next two."""
    def level(shift: int, mask: int) -> Column:
        bits = lambda h, n, m: F.shiftrightunsigned(h, n).bitwiseAND(F.lit(m).cast("long"))
        four = F.array(*[F.lit(i).cast("long") for i in range(4)])
        quarter = lambda some, q: F.filter(some, lambda h: bits(h, shift, 3) == q)
        hashes = lambda part: F.transform(four, lambda s: F.xxhash64(F.filter(part, lambda h: bits(h, shift + 2, 3) == s)))
        whole = lambda some: F.flatten(F.transform(four, lambda q: _let(quarter(some, q), hashes)))
        return whole(own) if mask < SUBSETS else _let(F.filter(own, lambda h: bits(h, shift, mask) < SUBSETS), whole)

    return F.concat(*[level(*x) for x in LEVELS])


def with_fingerprint(docs: DataFrame, known_terms: str, text: str, out: str) -> DataFrame:
    """Adds the hashes of column ``text`` as array ``out``; ``known_terms`` is a :func:`lexicon`."""
    # one literal, folded when the query is planned
    known = F.from_json(F.lit(known_terms), "array<array<bigint>>")
    held = docs.withColumn("_terms", terms(F.col(text)))
    own = lambda h: F.get(known, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
    held = held.withColumn("_in", F.filter("_terms", lambda h: F.array_contains(own(h), F.shiftright(h, BUCKET_BITS))))
    used = F.when(F.size("_in") == 0, F.col("_terms")).otherwise(F.col("_in"))
    held = held.withColumn("_own", F.sort_array(used))
    return held.withColumn(out, signatures(F.col("_own"))).drop("_terms", "_in", "_own")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two arrays of hashes."""
    none = F.xxhash64(F.array().cast("array<bigint>"))
    said = F.zip_with(a, b, lambda x, y: F.when(x != y, 1).when(x == none, 0).otherwise(1001))

    def level(i: int) -> Column:
        total = F.aggregate(F.slice(said, 1 + i * SUBSETS, SUBSETS), F.lit(0), lambda t, x: t + x)
        return F.floor(total / 1000) / F.greatest(total % 1000, F.lit(LEAST))

    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(*[level(i) for i in range(len(LEVELS))]).cast("double"))


def next_documents(docs: DataFrame) -> tuple[DataFrame, object]:
    """(rows with ``_range``, ``_copy``; the window over them): within the window
    ``lead`` gives the next document; rows with ``_copy`` set are dropped after it."""
    n = n_partitions(docs.sparkSession)
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long"))
    own = docs.select("doc_id", whole_text().alias("text"), key.alias("_key"))
    coarse = min(n, COARSE)
    # at most COARSE edges come to the driver; ranges between them are cut evenly once more
    edges = own.agg(F.percentile_approx("_key", [i / coarse for i in range(1, coarse)] or [0.5], 10_000), F.max("_key")).first()
    cuts = sorted({int(e) for e in edges[0] or []})
    fine = -(-n // coarse)
    at = count_le_long(cuts, F.col("_key")) if cuts else F.lit(0)
    rows = own.withColumn("_range", at.cast("long"))
    if fine > 1 and len(cuts) > 1:
        width = [max(1, -(-(b - a) // fine)) for a, b in zip(cuts, [*cuts[1:], int(edges[1]) + 1], strict=True)]
        low = F.element_at(F.array(*[F.lit(c) for c in cuts]), F.greatest(F.col("_range"), F.lit(1)).cast("int"))
        wide = F.element_at(F.array(*[F.lit(c) for c in width]), F.greatest(F.col("_range"), F.lit(1)).cast("int"))
        inner = F.when(F.col("_range") == 0, 0).otherwise(F.least(F.floor((F.col("_key") - low) / wide), F.lit(fine - 1)))
        rows = rows.withColumn("_range", F.col("_range") * fine + inner)
    # one row per range: the range above it gets a copy of its first document; the lowest gets the very first
    tops = rows.groupBy("_range").agg(F.max("_key").alias("_key"))
    up = Window.orderBy("_range")
    tops = tops.select("_key", F.lead("_range").over(up).alias("_to"), F.min("_range").over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_lowest"))
    tops = F.broadcast(tops.select("_key", F.coalesce("_to", "_lowest").alias("_to")))
    copies = rows.join(tops, "_key").select("doc_id", "text", "_key", F.col("_to").alias("_range"), F.lit(True).alias("_copy"))
    both = rows.withColumn("_copy", F.lit(False)).unionByName(copies)
    return both, Window.partitionBy("_range").orderBy("_copy", F.desc("_key"), F.xxhash64("text"))


def count_le_long(cuts: list[int], v: Column) -> Column:
    """How many of the sorted ``cuts`` are <= v, for 64-bit numbers."""
    def node(lo: int, hi: int) -> Column:
        if lo >= hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(v >= F.lit(cuts[mid]).cast("long"), node(mid + 1, hi)).otherwise(node(lo, mid))

    return node(0, len(cuts))


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness: the
    edited text has its last third replaced by the beginning of the next document."""
    known = lexicon(docs)
    both, order = next_documents(docs)
    rows = both.withColumn("_next", F.lead("text").over(order))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 3) as int))"), F.substring("_next", F.lit(1), cut)))
    rows = with_fingerprint(rows.drop("_next"), known, "text", "signatures")
    rows = rows.withColumn("_next", F.lead("signatures").over(order)).filter(~F.col("_copy"))
    rows = with_fingerprint(rows, known, "edited", "edited_signatures")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "signatures", "edited_signatures",
                       likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
                       likeness(F.col("signatures"), F.col("_next")).alias("near_next"))


def digests(found: DataFrame) -> DataFrame:
    short = lambda c: F.array_join(F.transform(c, lambda h: F.lpad(F.lower(F.hex(h.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")
    return found.select("doc_id", "n_chars", "edited_sha256", short(F.col("signatures")).alias("fingerprint"),
                        short(F.col("edited_signatures")).alias("edited_fingerprint"), "near_edited", "near_next")
