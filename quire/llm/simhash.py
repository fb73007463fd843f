"""SimHash near-duplicates with pigeonring filtering.

Fingerprints: 64 bits over hashed word shingles. Two fingerprints link at ``bits`` or fewer differing bits. The 64 bits
are cut into ``segments`` equal ones, set in a ring. By the pigeonring principle two linked fingerprints have a
start from which every chain of l consecutive segments differs in at most l * bits / segments bits altogether. The number of
segments grows with the number of fingerprints (``segments_for``), and with it the key. Chains so
short that this bound is below one must be equal: they are the key on which candidates meet. Longer chains are checked
next, and only what passes all of them gets the full Hamming check.

Equal fingerprints are one class. In a key shared by more than ``crowd`` classes no pairs are made: those classes go
to an exact linear form of the same test. Two fingerprints differ in at most 2k bits if and only if both are
within k bits of a common one, so each is put with every fingerprint within k bits of it and linked to the least
there; for an odd number of bits one of the two takes one more step.

Edge cases: a null text counts as empty; no words give fingerprint zero, which links like others; fewer words than
a shingle's give one shingle; null ids name no component but keep a row; repeated rows stay; an empty
table gives an empty result; further columns are ignored. ``one_of_each`` chooses by row: of a component the row with the least
id, nulls last, and of rows with that id one text; rows without an id stay where nothing is like them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_stage, cut, drop_cut, free_name, table
from .components import components

#: Bit counts of each byte's values, most significant bit first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_digests(text: str, words: int) -> bytes:
    """The XXH64 (seed 42) of each shingle, 8 big-endian bytes each."""
    parts = text.encode().lower().split()
    if not parts:
        return b""
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[s:e], 42) for s, e in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist())])


def fingerprints_of(texts: list[str], words: int) -> np.ndarray:
    """A bit is 1 if more than half of the shingles have it. Counts come from byte histograms."""
    digests = [shingle_digests(t, words) for t in texts]
    sizes = np.array([len(d) // 8 for d in digests], dtype=np.int64)
    data = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8)
    row = np.repeat(np.arange(len(texts)), sizes) * 256
    out = np.zeros((len(texts), 8), dtype=np.uint8)
    for byte in range(8):
        seen = np.bincount(row + data[:, byte], minlength=256 * len(texts)).reshape(-1, 256)
        out[:, byte] = np.packbits((seen @ BITS) * 2 > sizes[:, None], axis=1)[:, 0]
    return out.view(">u8")[:, 0].astype(np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and a hash of the text of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column(1).to_pylist(), []
            for k in range(0, len(texts), 128):
                found.append(fingerprints_of([t or "" for t in texts[k : k + 128]], words))
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)), batch.column(2)], ["doc_id", "fp", "hash"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_hash(text_col).alias("hash"))
    return arrow_stage(rows, each, "doc_id long, fp long, hash long")


def text_hash(text_col: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def chain_keys(fp: str, bits: int, segments: int) -> tuple[F.Column, int]:
    """An array of (start, key) of a fingerprint: the chain from each start that must be equal."""
    width = 64 // segments
    # chains of l segments have a budget below 1 as long as l * bits < segments
    exact = max(1, -(-segments // bits) - 1) if bits else segments
    keep = exact * width
    mask = (1 << keep) - 1
    at = lambda s: (f"{fp}" if s == 0 else f"(shiftleft({fp}, {s * width}) | shiftrightunsigned({fp}, {64 - s * width}))")
    rows = [f"struct({s} as start, (shiftrightunsigned({at(s)}, {64 - keep}) & {mask}L) as key)" if keep < 64 else f"struct({s} as start, {at(s)} as key)" for s in range(segments)]
    return F.expr(f"array({', '.join(rows)})"), exact


def ring_passes(start: str, x: str, bits: int, segments: int, exact: int) -> F.Column:
    """Do all longer chains from ``start`` keep within their budgets? x: the two fingerprints, XORed."""
    width = 64 // segments
    turned = f"(shiftleft({x}, {start} * {width}) | CASE WHEN {start} = 0 THEN 0L ELSE shiftrightunsigned({x}, 64 - {start} * {width}) END)"
    tests = [f"bit_count(shiftrightunsigned({turned}, {64 - n * width})) <= {n * bits // segments}" for n in range(exact + 1, segments)]
    return F.expr(" AND ".join([*tests, f"bit_count({x}) <= {bits}"]))


def meetings(classes: DataFrame, bits: int, segments: int) -> tuple[DataFrame, int]:
    """start, key, n, fp: the keys that n > 1 classes share, a row for each of them, written; and the length of an exact chain."""
    keys, exact = chain_keys("fp", bits, segments)
    rows = classes.select("fp", F.explode(keys).alias("k")).select("fp", F.col("k.start").alias("start"), F.col("k.key").alias("key"))
    sized = rows.groupBy("start", "key").agg(F.count("*").alias("n")).where("n > 1")
    return cut(rows.join(sized, ["start", "key"]), "met"), exact


def links(classes: DataFrame, bits: int = 2, segments: int = 8, crowd: int = 64) -> DataFrame:
    """a, b: fingerprints that link, from distinct ones in ``fp``, a written table. Every link is there, or implied by others."""
    if not bits:
        return cut(classes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0), "links")
    met, exact = meetings(classes, bits, segments)
    few, many = met.where(F.col("n") <= crowd), met.where(F.col("n") > crowd)
    pairs = few.alias("p").join(few.alias("q"), (F.col("p.start") == F.col("q.start")) & (F.col("p.key") == F.col("q.key")) & (F.col("p.fp") < F.col("q.fp")))
    pairs = pairs.select(F.col("p.start").alias("start"), F.col("p.fp").alias("a"), F.col("q.fp").alias("b"), F.col("p.fp").bitwiseXOR(F.col("q.fp")).alias("x"))
    found = cut(pairs.where(ring_passes("start", "x", bits, segments, exact)).select("a", "b"), "links")
    if not many.isEmpty():
        paired, found = found, cut(found.union(crowded_links(many.select("fp").distinct(), bits)), "links")
        drop_cut(paired)
    drop_cut(met)
    return found


def crowded_links(classes: DataFrame, bits: int) -> DataFrame:
    """All links among ``classes``, implied by stars: linear in their number."""
    flips = F.expr("transform(sequence(0, 64), i -> IF(i = 64, 0L, shiftleft(1L, i)))")
    near = classes.select("fp", F.col("fp").alias("hub"))
    for _ in range(bits // 2):
        near = near.select("fp", F.explode(F.transform(flips, lambda m: F.col("hub").bitwiseXOR(m))).alias("hub")).distinct()
    least = near.groupBy("hub").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where("a <> top")
    stars = near.join(least, "hub").select("a", F.col("fp").alias("b")).where("a <> b").distinct()
    if bits % 2:
        more = near.select("fp", F.explode(F.transform(flips, lambda m: F.col("hub").bitwiseXOR(m))).alias("hub"))
        stars = stars.union(more.join(least.select("hub", "a").union(near.select("hub", F.col("fp").alias("a"))), "hub").select("a", F.col("fp").alias("b")).where("a <> b").distinct())
    return stars


def segments_for(classes: int, bits: int, crowd: int) -> int:
    """So many that a key, whose length grows with them, is shared by an eighth of ``crowd`` chance classes at most, if 64 are enough for that."""
    for segments in (8, 16, 32):
        exact = -(-segments // max(1, bits)) - 1
        if classes * 8 <= crowd << exact * 64 // segments:
            return segments
    return 64


def grouped(docs: DataFrame, words: int = 3, bits: int = 2, segments: int | None = None, crowd: int = 64, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The fingerprints of every row; and fp, first (the smallest id), root (the smallest fingerprint reachable) of each class."""
    prints = cut(fingerprints(docs, words, id_col, text_col), "prints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    edges = links(classes.select("fp"), bits, segments or segments_for(classes.count(), bits, crowd), crowd)
    # components are found over fingerprints, then named by the smallest id in them
    rooted = components(edges)
    drop_cut(edges)
    named = cut(classes.join(rooted, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "classes")
    drop_cut(rooted)
    return prints, named


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, fp, component_id (the smallest id reachable over links) of every row of ``docs``; options as for ``grouped``."""
    prints, named = grouped(docs, **options)
    small = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = named.join(small, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose component has another row with a smaller id, or with the same id and another text first."""
    prints, named = grouped(docs, **options)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash")
    first = prints.join(named.select("fp", "root"), "fp").groupBy("root").agg(F.min(order).alias("first")).select("first.doc_id", "first.hash").distinct()
    ident, digest = free_name(docs, "ident"), free_name(docs, "digest")
    rows = docs.withColumns({ident: F.col(options.get("id_col", "doc_id")).cast("long"), digest: text_hash(options.get("text_col", "text"))})
    first = first.select(F.col("doc_id").alias("first_id"), F.col("hash").alias("first_hash"))
    kept = rows.join(first, F.col(ident).eqNullSafe(F.col("first_id")) & (F.col(digest) == F.col("first_hash")), "left_semi")
    return kept.dropDuplicates([ident, digest]).select(*docs.columns)


def op7_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
