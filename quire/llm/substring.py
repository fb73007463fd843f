"""Substring dedup by paragraph MinHash banding.

Two kinds of paragraphs are compared. Blocks are the text's own: each line and each run of several lines between blank ones, of
``least_words`` words or more; near-copies among them are found by MinHash banding. But a repeated passage need not begin or end where
a line does. So pieces are cut by content as well: one of ``LENGTH`` words begins at each anchor, the word whose three-word hash is
the least among ``SPREAD`` neighbouring ones. Two copies of a passage have the same anchors inside it, wherever they stand, and one of
LENGTH + SPREAD + 2 = 51 words or more always holds a whole piece. Pieces are compared for equality.

1. Each paragraph gets an exact hash, a block keys of MinHash values over its five-word shingles as well: ``BANDS`` of ``ROWS``. At a
   Jaccard of 0.8 one of its 8 bands of 3 meets with a probability of 0.995.
2. Keys that occur once fall away. Equal paragraphs are one class; pairs are made between distinct classes of a key.
   A key with more than ``CROWD`` classes makes no pairs. Its classes go to an exact join instead, which finds every link among all of
   them: two sets of a Jaccard of t have a common shingle among the rarest of each (``prefixes``); sizes, the first
   common place and a sketch of all shingles bound what they can share (``can_link``).
3. The exact Jaccard of the shingle sets verifies each pair of classes. Where more than CROWD classes share one of those rarest shingles,
   each is compared with ``PIVOTS`` of them first; then all that are not of one component yet are compared with each other (``left_open``).
   So no link is lost, or it is implied by others.
4. Components over the links gather the paragraphs of one passage; the first one (by document, then place) is kept.
   Overlapping paragraphs of a document are merged into spans.

Words are split at white space and compared with ASCII letters lower-cased. Only passages in at least two documents are reported.

Edge cases: null and empty texts have no paragraphs, texts of fewer than LENGTH + SPREAD words no pieces, lines of fewer than
``least_words`` words are in their block alone; null ids are left out;
rows that repeat a document id count as one document; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_stage, cut, drop_cut, table
from .components import components

LENGTH, SPREAD, SHINGLE = 40, 9, 5
BANDS, ROWS, CROWD, PIVOTS = 8, 3, 32, 32
#: Longs of a sketch.
SKETCH = 16
#: Words of the passages that the query removes.
PASSAGE = 50
#: Paragraphs that a task remembers; beyond, it begins anew, which costs rows but loses none.
REMEMBERED = 500_000
ODD = np.random.default_rng(8).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x5851F42D4C957F2D
HOT = 1000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def sliding(a: np.ndarray, width: int, least: bool = True) -> np.ndarray:
    """Minimum (or maximum) of each run of ``width``, by doubling."""
    best, span = (np.minimum if least else np.maximum), 1
    n = len(a) - width + 1
    if n <= 0:
        return a[:0]
    while span * 2 <= width:
        a = best(a[:-span], a[span:])
        span *= 2
    return best(a[:n], a[width - span : width - span + n]) if span < width else a[:n]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and how many each text has."""
    digest = xxhash.xxh64_digest
    split = [(t or "").encode().lower().split() for t in texts]
    return np.frombuffer(b"".join([digest(w) for words in split for w in words]), dtype=">u8").astype(np.uint64), np.array([len(w) for w in split], np.int64)


def joined_hash(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words."""
    n = len(h) - width + 1
    if n <= 0:
        return h[:0]
    out = h[:n].copy()
    for k in range(1, width):
        out *= np.uint64(BASE)
        out += h[k : k + n]
    return mixed(out)


def run_hash(h: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A hash of the run of ``width`` numbers at each place."""
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(width):
        out *= np.uint64(BASE)
        out += h[at + k]
        out = mixed(out)
    return out


def banded(low: list[np.ndarray], rows: int, seed: int) -> np.ndarray:
    """Keys of ``rows`` MinHash values each; ``seed`` keeps kinds of keys apart."""
    keys = []
    for b in range(len(low) // rows):
        key = np.full(len(low[0]), seed + b + 1, dtype=np.uint64)
        for k in range(rows):
            key = mixed(key * np.uint64(BASE) + low[b * rows + k])
        keys.append(key.view(np.int64))
    return np.array(keys)


def exact_hash(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes())


def line_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, how many each line has, and each line's text."""
    split = [(t or "").split("\n") for t in texts]
    h, sizes = word_hashes([line for lines in split for line in lines])
    return h, sizes, np.repeat(np.arange(len(texts)), [len(x) for x in split])


def blocks_of(h: np.ndarray, sizes: np.ndarray, owner: np.ndarray, least_words: int = SHINGLE) -> tuple[np.ndarray, ...]:
    """For each line, and each run of several lines between blank ones, of ``least_words`` words or more: the text's number, its first
    word, number of words, exact hash and band keys."""
    with np.errstate(over="ignore"):
        end = np.cumsum(sizes)
        start = end - sizes
        of_text = np.searchsorted(owner, owner)  # the first line of each line's text
        full = sizes > 0
        new = full.copy()
        new[1:] &= ~full[:-1] | (owner[1:] != owner[:-1])
        run = np.cumsum(new)[full] - 1
        last = np.flatnonzero(np.diff(run, append=-1))
        several = np.bincount(run, minlength=new.sum()) > 1
        lines = np.flatnonzero(full)
        line = np.concatenate((lines, np.flatnonzero(new)[several]))
        s, e = start[line], np.concatenate((end[lines], end[lines][last][several]))
        ok = e - s >= least_words
        line, s, e = line[ok], s[ok], e[ok]
        exact = np.array([exact_hash(h[a:b]) for a, b in zip(s.tolist(), e.tolist())], dtype=np.uint64).view(np.int64)
        if not len(s):
            return owner[line], s, e - s, exact, np.zeros((BANDS, 0), np.int64)
        shingles = np.append(joined_hash(h, SHINGLE), np.uint64(0))
        reach = np.stack((s, e - SHINGLE + 1), axis=1).ravel()
        low = [np.minimum.reduceat(shingles * odd, reach)[::2] for odd in ODD]
        return owner[line], s - start[of_text[line]], e - s, exact, banded(low, ROWS, 100)


def paragraphs_of(texts: list[str | None], known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """For each piece: the text's number, its first word, exact hash and keys (one, the hash itself). ``known``: the texts' word hashes."""
    with np.errstate(over="ignore"):
        h, sizes = known or word_hashes(texts)
        nothing = np.zeros(0, np.int64)
        if len(h) < LENGTH + SPREAD:
            return nothing, nothing, nothing, np.zeros((1, 0), np.int64)
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        owner = np.repeat(np.arange(len(texts)), sizes)
        end = (first + sizes)[owner]  # where each word's text ends
        grams = joined_hash(h, 3)
        least = sliding(grams, SPREAD)
        inside = np.arange(len(least)) + SPREAD + 2 <= end[: len(least)]
        least = np.where(inside, least, 0)
        reach = np.concatenate((np.zeros(SPREAD - 1, np.uint64), least, np.zeros(SPREAD - 1, np.uint64)))
        anchor = sliding(reach, SPREAD, least=False)[: len(grams)] == grams
        at = np.flatnonzero(anchor)
        at = at[at + LENGTH <= end[at]]
        exact = run_hash(h, at, LENGTH).view(np.int64)
        return owner[at], at - first[owner[at]], exact, exact[None, :]


def paragraphs(docs: DataFrame, least_words: int = SHINGLE) -> DataFrame:
    """key, exact (null: it is the key), doc_id, at, words (null: LENGTH), extra: one row for each key of each paragraph. A task that
    meets a paragraph again, after two documents with it (or in the document it knows), adds one ``extra`` row that has a key of its
    own: the two tell that it is repeated, so a passage that very many documents share does not bring all of them to one key."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int | bool] = {}
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for k in range(0, len(texts), 64):
                h, sizes, line_owner = line_hashes(texts[k : k + 64])
                owner, at, exact, keys = paragraphs_of(texts[k : k + 64], (h, np.bincount(line_owner, sizes, len(texts[k : k + 64])).astype(np.int64)))
                if len(seen) > REMEMBERED:
                    seen.clear()
                for owner, at, words, exact, keys in ((owner, at, None, exact, keys), blocks_of(h, sizes, line_owner, least_words)):
                    doc = ids[k : k + 64][owner]
                    new = np.ones(len(exact), dtype=bool)
                    for i, (e, d) in enumerate(zip(exact.tolist(), doc.tolist())):
                        known = seen.get(e)
                        if known is None:
                            seen[e] = d
                        elif known is not True and known != d:
                            seen[e] = True
                        else:
                            new[i] = False
                    with np.errstate(over="ignore"):
                        own = mixed((exact[~new] ^ doc[~new]).view(np.uint64) * np.uint64(BASE) + at[~new].astype(np.uint64)).view(np.int64)
                    key = np.concatenate((keys[:, new].ravel(), own))
                    spread = lambda x: np.concatenate((np.tile(x[new], len(keys)), x[~new]))  # noqa: B023, E731
                    extra = np.arange(len(key)) >= len(key) - len(own)
                    named = pa.array(spread(exact), mask=~extra if words is None else None)
                    size = pa.nulls(len(key), pa.int32()) if words is None else pa.array(spread(words).astype(np.int32))
                    yield pa.record_batch([pa.array(key), named, pa.array(spread(doc)), pa.array(spread(at).astype(np.int32)), size, pa.array(extra)], ["key", "exact", "doc_id", "at", "words", "extra"])

    return arrow_stage(docs, each, "key long, exact long, doc_id long, at int, words int, extra boolean")


def sketch_of(part: np.ndarray) -> list[int]:
    """The parity of the distinct shingles of each of 64 * SKETCH kinds: two sets differ in as many shingles as their sketches in bits, or more."""
    kind = mixed(np.unique(part.view(np.uint64))) % np.uint64(64 * SKETCH)
    return np.packbits(np.bincount(kind.astype(np.int64), minlength=64 * SKETCH) % 2 == 1).view(np.int64).tolist()


def shingles_at(docs: DataFrame) -> DataFrame:
    """exact, shingles, sketch (of the crowded ones) of the paragraphs at ``places`` (array of struct<at, words, exact, crowded>) of each text. Of several texts with one id only that is
    read which has the paragraph."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact, found, sketch = [], [], []
            for text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with np.errstate(over="ignore"):
                    h = word_hashes([text])[0]
                    s = joined_hash(h, SHINGLE).view(np.int64)
                    for p in places:
                        if exact_hash(h[p["at"] : p["at"] + p["words"]]) != p["exact"] % 2**64:
                            continue
                        exact.append(p["exact"])
                        part = s[p["at"] : p["at"] + p["words"] - SHINGLE + 1]
                        found.append(part.tolist())
                        sketch.append(sketch_of(part) if p["crowded"] else None)
            yield pa.record_batch([pa.array(exact, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))], ["exact", "shingles", "sketch"])

    return arrow_stage(docs.select("text", "places"), each, "exact long, shingles array<long>, sketch array<long>", rows=128)


def pairs_of(classes: DataFrame) -> DataFrame:
    """a, b: all pairs of the classes (key, exact) of a key."""
    p, q = classes.alias("p"), classes.alias("q")
    return p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.exact") < F.col("q.exact"))).select(F.col("p.exact").alias("a"), F.col("q.exact").alias("b"))


def prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """key, exact, size, at, sketch, n: the shingles that a set has to share one of with any set of that Jaccard, the rarest of its own, those
    alone in theirs left out; ``at``: the place among its shingles, rarest first; ``n``: how many sets have the key here."""
    rows = sets.select("exact", F.size(F.array_distinct("shingles")).alias("size"), F.explode(F.array_distinct("shingles")).alias("key"))
    shared = rows.join(rows.groupBy("key").agg(F.count("*").alias("sets")).where("sets > 1"), "key")
    own = shared.groupBy("exact", "size").agg(F.sort_array(F.collect_list(F.struct("sets", "key"))).alias("own"))
    rarest = own.withColumn("alone", F.expr("size - size(own)"))
    rarest = rarest.withColumn("own", F.expr(f"slice(own, 1, greatest(0, int(size - ceil({similarity} * size - 1e-6) + 1 - alone)))"))
    rarest = rarest.join(sets.select("exact", "sketch"), "exact")
    keys = rarest.select("exact", "size", "sketch", "alone", F.posexplode("own").alias("k", "own")).select(F.col("own.key").alias("key"), "exact", "size", F.expr("alone + k + 1").alias("at"), "sketch")
    return keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")


def can_link(similarity: float) -> F.Column:
    """Can p and q, whose first common shingle is at these places, share as many as the Jaccard asks for, and differ in as few? A pair
    that links passes at the first shingle that both have."""
    apart = " + ".join(f"bit_count(p.sketch[{k}] ^ q.sketch[{k}])" for k in range(SKETCH))
    shared = f"least(p.size - p.at, q.size - q.at) + 1 >= {similarity / (1 + similarity)} * (p.size + q.size) - 1e-6"
    return F.expr(f"{shared} AND {apart} <= {(1 - similarity) / (1 + similarity)} * (p.size + q.size) + 1e-6")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("p.exact", "q.exact").alias("a"), F.greatest("p.exact", "q.exact").alias("b"))


def first_pairs(keys: DataFrame, similarity: float) -> DataFrame:
    """a, b: the pairs of each key; of a key that many classes share, each with PIVOTS of them."""
    few, many = keys.where(F.col("n") <= CROWD).drop("n"), keys.where(F.col("n") > CROWD).drop("n")
    pairs = few.alias("p").join(few.alias("q"), F.expr("p.key = q.key AND p.exact < q.exact") & can_link(similarity))
    pivots = many.groupBy("key", F.pmod("exact", F.lit(PIVOTS)).alias("part")).agg(F.min(F.struct("exact", "size", "at", "sketch")).alias("pivot")).select("key", "pivot.*")
    stars = many.alias("p").join(pivots.alias("q"), F.expr("p.key = q.key AND p.exact <> q.exact") & can_link(similarity))
    return ordered(pairs).union(ordered(stars))


def left_open(keys: DataFrame, rooted: DataFrame) -> DataFrame:
    """key, exact, size, at, sketch, root, top: the rows of the keys that many classes share and that are not of one component; ``top``: a key's
    largest component. Written."""
    many = keys.where(F.col("n") > CROWD).join(rooted, F.col("exact") == F.col("node"), "left").select("key", "exact", "size", "at", "sketch", F.coalesce("root", "exact").alias("root"))
    parts = many.groupBy("key", "root").agg(F.count("*").alias("n"))
    tops = parts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("key", "top.root")
    return cut(many.join(tops.withColumnRenamed("root", "top"), "key"), "open")


def other_pairs(open_rows: DataFrame, similarity: float) -> DataFrame:
    """a, b: all pairs of classes of a key that are of two components; those of the largest are met by the others only."""
    p, q = open_rows.where("root <> top").alias("p"), open_rows.alias("q")
    return ordered(p.join(q, F.expr("p.key = q.key AND p.root <> q.root AND (q.root = q.top OR p.exact < q.exact)") & can_link(similarity)))


def repeated(docs: DataFrame, similarity: float = 0.8, least_words: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, at, words, passage_id, kept, kept_doc: paragraphs that occur in several documents. ``least_words``: of a block."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # keys that one paragraph alone has fall away in an aggregation that shares its shuffle with the join, as long as both read all columns
    dealt = paragraphs(rows, max(least_words, SHINGLE)).where("key IS NOT NULL").repartition("key")
    many = dealt.groupBy("key").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("exact").alias("e0"), F.max("exact").alias("e1"),
        F.min("at").alias("at"), F.coalesce(F.min("words"), F.lit(LENGTH)).alias("words"), F.bool_and("extra").alias("alone"),
    )
    many = many.where("n > 1 AND first <> last AND at >= 0 AND words >= 0 AND NOT alone").select("key", F.expr("e0 <=> e1").alias("same"))
    met = dealt.join(many.hint("shuffle_hash"), "key", "left").where("extra OR same IS NOT NULL")
    met = cut(met.select("key", F.coalesce("exact", "key").alias("exact"), "doc_id", "at", F.coalesce("words", F.lit(LENGTH)).alias("words"), (F.col("extra") | F.col("same")).alias("same")), "met")
    # classes of equal paragraphs; pairs only where a key has several
    classes = met.where("NOT same").groupBy("key", "exact").agg(F.min(F.struct("doc_id", "at", "words")).alias("place"))
    sized = classes.groupBy("key").agg(F.count("*").alias("n"))
    varied = cut(classes.join(sized, "key"), "classes")
    pairs = pairs_of(varied.where(F.col("n") <= CROWD))
    places = varied.groupBy("exact").agg(F.min("place").alias("place"), F.max("n").alias("n"))
    of_doc = places.groupBy(F.col("place.doc_id").alias("doc_id")).agg(F.collect_list(F.struct(F.col("place.at").alias("at"), F.col("place.words").alias("words"), "exact", (F.col("n") > CROWD).alias("crowded"))).alias("places"))
    shingled = cut(shingles_at(rows.join(of_doc, "doc_id")), "shingles")
    distinct = shingled.dropDuplicates(["exact"])
    left = distinct.select(F.col("exact").alias("a"), F.col("shingles").alias("sa"))
    right = distinct.select(F.col("exact").alias("b"), F.col("shingles").alias("sb"))

    def linked(pairs: DataFrame) -> DataFrame:
        return pairs.distinct().join(left, "a").join(right, "b").where(F.size(F.array_intersect("sa", "sb")) >= similarity * F.size(F.array_union("sa", "sb"))).select("a", "b")

    keys = cut(prefixes(distinct.where("sketch IS NOT NULL"), similarity), "prefixes")
    rooted = components(linked(pairs.union(first_pairs(keys, similarity))))
    if not keys.where(F.col("n") > CROWD).isEmpty():
        rest = left_open(keys, rooted)
        if not rest.isEmpty():
            before = rooted
            rooted = components(linked(other_pairs(rest, similarity)).union(before.select("node", "root")))
            drop_cut(before)
        drop_cut(rest)
    members = met.select("exact", "doc_id", "at", "words").distinct()
    named = members.join(rooted, F.col("exact") == F.col("node"), "left").select("doc_id", "at", "words", F.coalesce("root", "exact").alias("passage_id"))
    named = cut(named, "named")
    for done in (met, varied, shingled, keys, rooted):
        drop_cut(done)
    about = named.groupBy("passage_id").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first.doc_id <> last").drop("last")
    # passages with a thousandth of the rows or more, so a thousand at most, are broadcast; the others are joined by a shuffle
    hot = F.broadcast(about.where(F.col("n") * HOT >= named.count()).drop("n"))
    rest = named.join(hot.select("passage_id"), "passage_id", "left_anti").join(about.drop("n"), "passage_id")
    out = named.join(hot, "passage_id").unionByName(rest)
    return out.select("doc_id", "at", "words", "passage_id", (F.struct("doc_id", "at") == F.col("first")).alias("kept"), F.col("first.doc_id").alias("kept_doc"))


def spans(found: DataFrame) -> DataFrame:
    """doc_id, first_word, end_word, kept, kept_doc: overlapping paragraphs of a document as one span; those kept and
    those to be removed apart."""
    w = Window.partitionBy("doc_id", "kept").orderBy("at")
    new = F.coalesce((F.col("at") > F.max(F.col("at") + F.col("words")).over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    marked = found.withColumn("new", new).withColumn("span", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        marked.groupBy("doc_id", "kept", "span")
        .agg(F.min("at").cast("long").alias("first_word"), F.max(F.col("at") + F.col("words")).cast("long").alias("end_word"), F.count("*").alias("paragraphs"), F.min("kept_doc").alias("kept_doc"))
        .select("doc_id", "first_word", "end_word", "paragraphs", "kept", "kept_doc")
    )


def op8_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(repeated(table(spark, sf_dir, "documents"), least_words=PASSAGE))
