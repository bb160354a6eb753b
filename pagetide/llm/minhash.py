"""Operator 1: near-duplicates by one-permutation MinHash.

* One pass hashes each text to its set of word shingles (numpy inside
  ``mapInArrow``), a digest of the set, and a one-permutation sketch of
  ``BANDS * ROWS`` bins with optimal densification (an empty bin copies the bin
  that a fixed random sequence of its own hits first), cut into band keys.
* Texts with equal sets form a class; only classes go on, and of these only the
  members of buckets (equal band keys) that hold two or more.
* Candidates are star-shaped: in each bucket, every member is paired with one
  centre (the one that meets most others in all its buckets), so pairs stay linear
  in the members. This round only saves work.
* Buckets that hold several components after that are compared exactly: up to
  ``SMALL`` members, all pairs across components; the classes of larger ones by
  a join on prefixes of their shingles, rarest first (``by_prefix``). Which
  shingles are common is estimated on ``SAMPLE`` of these classes and only
  decides what is skipped.
* Pairs of large sets first compare ``CHECKED`` bytes of their sketches; a pair
  at the threshold agrees on fewer than ``AGREE`` of them once in ten million
  (a test measures it). The others are confirmed on full sets, and components
  come from the links. Texts are only moved for classes in candidate pairs: a
  Bloom filter turns down the others where they are read.

The chance that a pair at similarity 0.8 shares no bucket is
(1 - 0.8**ROWS)**BANDS = 3e-6.

Defined cases: null and empty texts, and texts without words, have an empty set
and are linked with nothing; repeated rows share a class; a null doc_id takes
part, and counts as larger than any other; an empty table gives no rows; extra
columns are ignored (``dedup`` carries them along).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.llm import bloom
from pagetide.llm import hashing as H
from pagetide.llm.common import discard, documents, materialize, python_ready, releasing, text_or_empty
from pagetide.llm.components import components

SHINGLE = 5
THRESHOLD_NUM, THRESHOLD_DEN = 80, 100
BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
WORK_BYTES = 1 << 20
CHECKED, AGREE, LARGE = 96, 52, 200  # sketch bytes, of which to agree, for sets from LARGE on

SMALL = 16  # members of a bucket up to which all its pairs are compared
SAMPLE, COMMON = 4096, 200_000  # classes that shingles are counted on; shingles kept of these
BLOCK = 512  # short prefixes with one shingle (and sizes) that meet in one block
SIZE_STEP = 1.02  # ratio of the sizes of one size class

_tries = np.random.default_rng(7).integers(0, BINS, (BINS, 2048))


def shingle_sets(column, width: int):
    """Sorted distinct shingle hashes of each text of an Arrow column."""
    data, offsets = H.column_bytes(column)
    for row, end in H.slices(offsets, WORK_BYTES):
        off = offsets[row:end + 1]
        hashes, _, _, first = H.words(data[off[0]:off[-1]], off - off[0], lower=True)
        all_runs = H.runs(hashes, width)
        for i in range(end - row):
            a, b = first[i], first[i + 1]
            if b - a >= width:
                yield np.unique(all_runs[a:b - width + 1])
            elif b > a:
                short = (hashes[a:b] * H.MULTIPLIERS[32:32 + b - a]).sum(dtype=np.uint64)
                yield H.mix(np.array([short + np.uint64(b - a)], np.uint64))
            else:
                yield hashes[:0]


def sketch(s: np.ndarray) -> np.ndarray:
    """One-permutation sketch of a sorted, non-empty set, densified."""
    bins = ((s >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    at = np.searchsorted(bins, np.arange(BINS))  # s is sorted, so are its bins
    filled = np.zeros(BINS, bool)
    filled[bins] = True
    out = np.zeros(BINS, np.uint64)
    out[filled] = s[at[filled]]
    empty = np.flatnonzero(~filled)
    if len(empty):
        source = np.full(len(empty), -1)
        todo, width, lo = np.arange(len(empty)), 16, 0
        while len(todo) and lo < _tries.shape[1]:
            hit = filled[_tries[empty[todo], lo:lo + width]]
            found = hit.any(axis=1)
            k = hit.argmax(axis=1)
            source[todo[found]] = _tries[empty[todo[found]], lo + k[found]]
            todo, lo, width = todo[~found], lo + width, width * 2
        if len(todo):  # no try hit: the next filled bin, cyclically
            full = np.flatnonzero(filled)
            source[todo] = full[np.searchsorted(full, empty[todo]) % len(full)]
        out[empty] = out[source]
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(BANDS, ROWS)
    total = (rows * H.MULTIPLIERS[:ROWS]).sum(axis=1, dtype=np.uint64)
    return H.mix(total + np.arange(BANDS, dtype=np.uint64) * H.MULTIPLIERS[ROWS]).view(np.int64)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sketches(batches, width):
    for b in batches:
        sizes, sets, bands, brief = [], [], [], []
        for s in shingle_sets(b.column("text"), width):
            sizes.append(len(s))
            values = sketch(s) if len(s) else None
            sets.append(_digest(s) if len(s) else None)
            bands.append(band_keys(values) if len(s) else None)
            brief.append(values[:CHECKED].astype(np.uint8).tobytes() if len(s) else None)
        cols = [b.column(i) for i, n in enumerate(b.schema.names) if n != "text"]
        names = [n for n in b.schema.names if n != "text"]
        new = [pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(brief, pa.binary())]
        yield pa.RecordBatch.from_arrays([*cols, *new], names=[*names, "n_shingles", "cls", "bands", "brief"])


def _plausible(batches):
    """Pairs whose brief sketches agree well enough, or whose sets are small."""
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, CHECKED) for c in ("brief_a", "brief_b"))
        n = np.minimum(b.column("n_a").to_numpy(), b.column("n_b").to_numpy())
        mask = pa.array(((x == y).sum(axis=1) >= AGREE) | (n < LARGE))
        yield b.select(["a", "b", "comp_a", "comp_b"]).filter(mask)


def _shingles(batches, width):
    for b in batches:
        for s in shingle_sets(b.column("text"), width):
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], names=["token"])


def size_class(n):
    """Classes of sizes: single ones up to 50, then ratios of ``SIZE_STEP``."""
    n = np.asarray(n, float)
    return np.where(n <= 50, n, 50 + np.floor(np.log(np.maximum(n, 50) / 50) / np.log(SIZE_STEP))).astype(np.int64)


def _prefixes(batches, width, num, den, common, counts):
    """Shingles of each set, rarest first, with the sizes that a partner may have
    for which the shingle is the first that both share.

    Of a pair, the smaller set (``short``) needs the shingles up to where what is
    left no longer reaches the overlap with a set of its own size; the larger one
    up to where it no longer reaches it with the smallest set allowed. A shared
    shingle at place p bounds the overlap by the shingles from p on, hence the
    partner's size. ``common`` is sorted.
    """
    for b in batches:
        for cid, s in zip(b.column("cid").to_pylist(), shingle_sets(b.column("text"), width)):
            often = np.zeros(len(s), np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                often = np.where(common[at] == s, counts[at], 0)
            n = len(s)
            tokens = s[np.lexsort((s, often))].view(np.int64)
            left = n - np.arange(n)
            # (num + den) * overlap >= num * (n + partner), overlap <= left
            most = ((num + den) * left) // num - n
            for short in (True, False):
                low = np.full(n, n if short else -(-num * n // den))
                high = np.minimum(most, (den * n) // num if short else n)
                keep = np.flatnonzero(high >= low)
                if not len(keep):
                    continue
                lo, hi = size_class(low[keep]), size_class(high[keep])
                # a class may reach over the bound; the pair is checked again
                cols = [pa.array(tokens[keep]), pa.array(np.full(len(keep), cid, np.int64)), pa.array(keep), pa.array([short] * len(keep)), pa.array(lo), pa.array(hi)]
                yield pa.RecordBatch.from_arrays(cols, names=["token", "cid", "pos", "short", "lo", "hi"])


def _own_class(batches, width):
    """(cid, text) of texts whose set is their class's."""
    for b in batches:
        same = [len(s) > 0 and _digest(s) == c for s, c in zip(shingle_sets(b.column("text"), width), b.column("cls").to_pylist())]
        yield b.select(["cid", "text"]).filter(pa.array(same, pa.bool_()))


def _confirm(batches, width, num, den):
    last, kept = None, None  # centres come in runs
    for b in batches:
        keep = []
        others = shingle_sets(b.column("text_a"), width)
        for i, (cid, x) in enumerate(zip(b.column("b").to_pylist(), others)):
            if cid != last:
                last, kept = cid, next(shingle_sets(b.column("text_b").slice(i, 1), width))
            both = np.concatenate((x, kept))
            both.sort(kind="stable")
            same = int((both[1:] == both[:-1]).sum())
            keep.append(den * same >= num * (len(x) + len(kept) - same))
        yield b.select(["comp_a", "comp_b"]).filter(pa.array(keep, pa.bool_()))


class _Work:
    """The tables of one run."""

    def __init__(self, docs: DataFrame, width: int, num: int, den: int):
        self.docs, self.width, self.num, self.den = docs, width, num, den
        self.spent: list[DataFrame] = []  # tables to remove after the next links
        python_ready(docs.sparkSession)
        text = text_or_empty()
        src = docs.select("doc_id", F.xxhash64(text, F.octet_length(text)).alias("th"), text.alias("text"))
        schema = src.drop("text").schema.add("n_shingles", "long").add("cls", "binary")
        schema = schema.add("bands", T.ArrayType(T.LongType())).add("brief", "binary")
        self.rows = materialize(src.mapInArrow(lambda it: releasing(_sketches(it, width)), schema), "minhash-sketch")
        # equal sets have equal sizes and sketches; any text of the class will do
        grouped = self.rows.filter(F.col("cls").isNotNull()).groupBy("cls").agg(
            F.min("doc_id").alias("rep"), F.min("th").alias("th"),
            *[F.first(c).alias(c) for c in ("n_shingles", "bands", "brief")],
        )
        self.classes = materialize(grouped.withColumn("cid", F.monotonically_increasing_id()), "minhash-classes")
        every = self.classes.select(F.explode("bands").alias("bucket"), "cid")
        shared = every.groupBy("bucket").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.count(F.lit(1)).alias("held")).filter("lo <> hi")
        shared = materialize(shared.select("bucket", "held"), "minhash-buckets")
        found = materialize(every.join(shared, "bucket"), "minhash-found")
        # the centre is the member that meets most others in all its buckets: of a
        # text and its edited copies the text itself
        score = materialize(found.groupBy("cid").agg(F.sum("held").alias("score")), "minhash-score")
        most = F.max_by("cid", F.struct("score", -F.col("cid")))
        centres = materialize(found.join(score, "cid").groupBy("bucket").agg(most.alias("centre")), "minhash-centres")
        self.members = materialize(found.join(centres, "bucket").select("bucket", "cid", "centre"), "minhash-members")
        discard(shared, found, score, centres)
        # of the classes, what the rounds read; bands are used up
        self.known = materialize(self.classes.select("cid", F.col("n_shingles").alias("n"), "brief", "th", "cls"), "minhash-known")
        names = materialize(self.classes.select("cls", "rep", "cid"), "minhash-names")
        discard(self.classes)
        self.classes = names

    def components_of(self, label: DataFrame | None) -> DataFrame:
        """(cid, comp) of the members of shared buckets."""
        if label is None:
            return self.members.withColumn("comp", F.col("cid"))
        named = label.select(F.col("node").alias("cid"), "component")
        return self.members.join(named, "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")

    def stars(self) -> DataFrame:
        """Candidate pairs (a, b): members and their buckets' centres."""
        hit = self.members.select("cid", "centre").filter("cid <> centre")
        return self.checked(hit.select(F.least("cid", "centre").alias("a"), F.greatest("cid", "centre").alias("b")).distinct(), None)

    def checked(self, hit: DataFrame, label: DataFrame | None) -> DataFrame:
        """Those of the pairs (a, b) that sizes, components and brief sketches leave."""
        known = self.known.select("cid", "n", "brief")
        if label is None:
            known = known.withColumn("comp", F.col("cid"))
        else:
            named = label.select(F.col("node").alias("cid"), "component")
            known = known.join(named, "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")
        side = lambda x: known.select(F.col("cid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "brief", "comp")])
        # a similarity bounds the ratio of the sizes
        near = (self.den * F.col("n_a") >= self.num * F.col("n_b")) & (self.den * F.col("n_b") >= self.num * F.col("n_a"))
        found = hit.join(side("a"), "a").join(side("b"), "b").filter(near & (F.col("comp_a") != F.col("comp_b")))
        found = found.select("a", "b", "comp_a", "comp_b", "n_a", "n_b", "brief_a", "brief_b")
        return found.mapInArrow(_plausible, "a long, b long, comp_a long, comp_b long")

    def rest(self, label: DataFrame | None) -> DataFrame:
        """All pairs across components that the star rounds may have left: in
        small buckets directly, in the others by prefixes."""
        named = materialize(self.components_of(label), "minhash-rest")
        split = named.groupBy("bucket").agg(
            F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("held")
        ).filter("lo <> hi and held > 2").select("bucket", "held")
        left = materialize(named.join(split, "bucket"), "minhash-left")
        discard(named)
        # every member has met its bucket's centre
        small = left.filter((F.col("held") <= SMALL) & (F.col("cid") != F.col("centre")))
        one, two = (small.select("bucket", F.col("cid").alias(x), F.col("comp").alias(f"comp_{x}")) for x in "ab")
        hit = one.join(two, "bucket").filter("a < b and comp_a <> comp_b").select("a", "b")
        crowd = materialize(left.filter(F.col("held") > SMALL).select("cid", "comp").distinct(), "minhash-crowd")
        self.spent += [left, crowd]
        if not crowd.isEmpty():
            hit = hit.union(self.by_prefix(crowd))
        return self.checked(hit.distinct(), label)

    def by_prefix(self, crowd: DataFrame) -> DataFrame:
        """Pairs (a, b) of ``crowd`` (cid, comp) across components that share a
        shingle of their prefixes at places where enough can still be shared.

        The sizes that a shingle's place allows are part of the join's key, on
        both sides: what is common to a whole crowd stands late in its prefixes,
        where it allows hardly any partner, and makes no pairs.
        """
        num, den, width = self.num, self.den, self.width
        texts = self.texts_of(crowd.select("cid"))
        sample = texts.orderBy(F.xxhash64("cid")).limit(SAMPLE)
        often = sample.mapInArrow(lambda it: _shingles(it, width), "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        top = often.filter("n > 1").orderBy(F.desc("n"), "token").limit(COMMON).toPandas()
        common = top["token"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(common)
        common, counts = common[order], top["n"].to_numpy(np.int64)[order]
        schema = "token long, cid long, pos long, short boolean, lo long, hi long"
        found = texts.mapInArrow(lambda it: releasing(_prefixes(it, width, num, den, common, counts)), schema)
        sized = crowd.join(self.known.select("cid", "n"), "cid")
        step = F.floor(F.log(F.greatest("n", F.lit(50)) / F.lit(50.0)) / F.lit(float(np.log(SIZE_STEP)))) + 50
        sized = sized.withColumn("own", F.when(F.col("n") <= 50, F.col("n")).otherwise(step).cast("long"))
        found = materialize(found.join(sized, "cid"), "minhash-prefixes")
        held = found.groupBy("token").agg(F.min("comp").alias("l"), F.max("comp").alias("h"), F.count_if("short").alias("some")).filter("l <> h and some > 0")
        # a bound of a class may fall on either side of rounding: one class more each way
        partners = F.explode(F.sequence(F.col("lo") - 1, F.col("hi") + 1))
        kept = found.join(materialize(held.select("token"), "minhash-tokens"), "token").withColumn("partner", partners)
        short = kept.filter("short").select("token", F.col("own").alias("x"), F.col("partner").alias("y"), *[F.col(c).alias(f"{c}_a") for c in ("cid", "n", "comp", "pos")])
        full = kept.filter("not short").select("token", F.col("partner").alias("x"), F.col("own").alias("y"), *[F.col(c).alias(f"{c}_b") for c in ("cid", "n", "comp", "pos")])
        blocks = short.groupBy("token", "x", "y").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
        blocks = materialize(blocks, "minhash-blocks")
        # a block of short prefixes meets a copy of all larger sets' prefixes with the shingle
        one = short.join(blocks, ["token", "x", "y"]).withColumn("block", F.pmod(F.xxhash64("cid_a"), "blocks")).drop("blocks")
        two = full.join(blocks, ["token", "x", "y"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
        both = F.col("n_a") + F.col("n_b")
        bound = (num + den) * F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= num * both
        once = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("cid_a") < F.col("cid_b")))
        met = one.join(two, ["token", "x", "y", "block"]).filter(once & (F.col("comp_a") != F.col("comp_b")) & bound)
        met = materialize(met.select(F.least("cid_a", "cid_b").alias("a"), F.greatest("cid_a", "cid_b").alias("b")).distinct(), "minhash-met")
        self.spent += [found, blocks, met, texts]
        return met

    def texts_of(self, need: DataFrame) -> DataFrame:
        """(cid, text): one text of each class in ``need`` (cid)."""
        wanted = materialize(self.known.join(need, "cid").select("th", "cid", "cls"), "minhash-need")
        texts = self.docs.select(text_or_empty().alias("text")).withColumn("th", F.xxhash64("text", F.octet_length("text")))
        # texts that no pair needs are not moved
        few = texts.filter(bloom.maybe(wanted.select("th"), F.col("th")))
        width = self.width
        found = few.join(wanted, "th").groupBy("th", "cid", "cls").agg(F.first("text").alias("text"))
        out = materialize(found.select("cid", "cls", "text").mapInArrow(lambda it: releasing(_own_class(it, width)), "cid long, text string"), "minhash-texts")
        discard(wanted)
        return out

    def links(self, pairs: DataFrame) -> DataFrame:
        """(comp_a, comp_b) of the pairs that hold on full sets."""
        texts = self.texts_of(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct())
        left = texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a"))
        right = texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b"))
        joined = pairs.join(left, "a").join(right, "b").select("b", "comp_a", "comp_b", "text_a", "text_b")
        width, num, den = self.width, self.num, self.den
        found = materialize(joined.mapInArrow(lambda it: releasing(_confirm(it, width, num, den)), "comp_a long, comp_b long").distinct(), "minhash-links")
        discard(texts, *self.spent)
        self.spent = []
        return found


def near_duplicates(docs: DataFrame, width: int = SHINGLE, num: int = THRESHOLD_NUM, den: int = THRESHOLD_DEN) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, group (a digest; null without
    words), component_id and kept."""
    w = _Work(docs, width, num, den)
    label = None

    def joined(label, found):
        # the links join components of the rounds before
        merged = components(found.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")))
        if label is not None:
            onto = merged.select(F.col("node").alias("component"), F.col("component").alias("onto"))
            old = label.join(onto, "component", "left").select("node", F.coalesce("onto", "component").alias("component"))
            merged = materialize(old.union(merged.join(label.select("node"), "node", "left_anti")), "minhash-label")
        return merged

    pairs = materialize(w.stars(), "minhash-pairs")
    if not pairs.isEmpty():
        found = w.links(pairs)
        if not found.isEmpty():
            label = joined(label, found)
    discard(pairs)
    pairs = materialize(w.rest(label), "minhash-pairs")
    if not pairs.isEmpty():
        found = w.links(pairs)
        if not found.isEmpty():
            label = joined(label, found)
    discard(pairs, w.members, w.known)
    named = w.classes.select("cls", "rep", "cid")
    if label is not None:
        named = named.join(label.withColumnRenamed("node", "cid"), "cid", "left").select(
            "cls", "rep", F.coalesce("component", "cid").alias("comp")
        )
    else:
        named = named.withColumn("comp", F.col("cid"))
    named = materialize(named.select("cls", "rep", "comp"), "minhash-components")
    smallest = materialize(named.groupBy("comp").agg(F.min("rep").alias("component_id")), "minhash-smallest")
    of_class = materialize(named.join(smallest, "comp").select("cls", "comp", "component_id"), "minhash-of-class")
    out = w.rows.select("doc_id", "th", "n_shingles", "cls").join(of_class, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    found = out.select("doc_id", "th", "n_shingles", F.col("comp").alias("group"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    )
    found._tables = [w.rows, of_class]  # what it reads, for a caller that writes it
    return found


def dedup(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """One document of each group: the smallest doc_id (null last, then the
    smallest text hash); rows that repeat doc_id and text count once. Documents
    without words have no group and all stay."""
    every = near_duplicates(docs.select("doc_id", "text"), width)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th").alias("key")
    rows = materialize(every.select("group", key), "minhash-rows")
    discard(*every._tables)
    again = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    found = rows.filter("group is not null")
    first = materialize(found.groupBy("group").agg(F.min("key").alias("first")), "minhash-firsts")
    gone = found.join(first, "group").filter(F.col("key") != F.col("first")).select("key").distinct()
    # keys whose rows are not simply kept: all go, or one stays
    some = gone.withColumn("_goes", F.lit(True)).unionByName(again.withColumn("_goes", F.lit(False)))
    some = materialize(some.groupBy("key").agg(F.bool_or("_goes").alias("_goes")).select(F.col("key.doc_id").alias("_key_id"), F.col("key.th").alias("_th"), "_goes"), "minhash-some")
    text = text_or_empty()
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.xxhash64(text, F.octet_length(text)).alias("_hash"), F.col("doc_id").alias("_id"),
    ).withColumn("_maybe", bloom.maybe(some.select("_th"), F.col("_hash")))
    same = (F.col("_hash") == F.col("_th")) & F.col("_id").eqNullSafe(F.col("_key_id"))
    asked = keyed.filter("_maybe").join(some, same, "left").filter(~F.coalesce("_goes", F.lit(False)))
    stays = asked.filter("_goes is null").select("_row")
    once = asked.filter("_goes is not null").dropDuplicates(["_hash", "_id"]).select("_row")
    return keyed.filter("not _maybe").select("_row").unionByName(stays).unionByName(once).select("_row.*")


def op1_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=4).select("doc_id", "n_shingles", "component_id", "kept")
