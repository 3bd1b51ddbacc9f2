"""Exact Jaccard self-join of shingle sets by universe partition and pigeonhole.

Sets x and y with Jaccard similarity t or more differ in at most
h = (|x| + |y|) (1 - t) / (1 + t) elements.  Sets are cut into size bands; a
pair belongs to the band of its larger set, so a set also takes part in the
bands that a larger partner could lie in.  In a band the universe of shingles
is hashed into segments.  A segment compared exactly absorbs no difference, a
segment compared with one-deletion neighbourhoods absorbs one; if segments
with a + b signatures give (exact) 1 and (one deletion) 2 units, and the units
exceed h, then some segment of x and y must match (pigeonhole).

Cost-based allocation: per band, the number of exact and of one-deletion
segments and of spare units is the cheapest by expected signatures and expected
accidental matches (``allocate``).  A set signs only the first segments of a
band, as many as its own size and that of its largest partner ask for.  Empty
segments are the usual accidental match: a set with no more of them than the
spare units allow signs none of them.  What is left of its spare units a set
uses to drop the signatures that most sets of the corpus have, such as those of
common passages.  Empty segments first, then signatures by falling frequency, is
one order for all sets, so the matches that one set of a pair drops and those
that the other drops are both the first ones of their common matches: together
they are no more than the spare units, and no pair is lost.  (A set with too
many empty segments drops nothing, and signatures that have one-deletion
neighbours are never dropped.)

Signatures that only one set has are dropped at once; copies of one set share
one key, so that they don't make a signature shared.  In a bucket of equal
signatures not all pairs are emitted: a few hubs per bucket are verified
against the other members, linked sets are joined into components, and only
members of different components are compared in the next round, with 64
times as many hubs; in a bucket with no more members than that all are hubs.
A bucket ends when its members are in one component or all have been hubs.
Every pair of a bucket is thus verified or already in one component, and
components are exact.  The labels of components are kept from round to round:
only the links of a round are merged, between the components as they were.

Two steps decide a pair.  The parities of a set's elements in 512 hash classes
differ in no more classes than two sets differ in elements, so a pair whose
parities differ in more than h classes is no link; this is tested where
the pair is made, and such a pair is never stored.  Verification of the others compares the shingle
sets of the two whole texts.

In buckets a set goes by a number of 8 bytes; classes and links go by digests
of 16 bytes, so that two sets with one number stay two classes.

Equal sets are one class, whatever the number of their copies.

Defined results: null text and text without words has no shingles and is
linked with nothing; fewer words than a shingle make one shingle of the whole
sequence; repeated rows are in one class; a null id takes part, and names a
component only if it has no other id; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tillpoint.llm.common import encoded, map_batches, pick, texts, written
from tillpoint.llm.components import components

BAND = 1.4              # the sizes of a band differ by this factor at most
SPARES = (0.12, 0.25)       # units beyond h + 1, as a share of them
HUB_GROWTH = 64
VERIFIED_BY_TASK = 4_000
PIECE_BYTES = 4 << 20   # of a batch that a task looks at at a time
SEEN_PRINTS = 20_000    # that a task remembers, so that copies near each other are signed once
FILTER_WORDS = 1 << 18  # 64 bits each, for the ids whose texts are verified
BAND_BITS = 6           # a signature's low bits: its band, then whether it may be dropped
PARITIES = [f"k{i}" for i in range(8)]      # 512 parities as longs


def bands(n: int) -> int:
    """Number of the band of sets of size n (1 or more); band b ends at ``band_end(b)``."""
    b = max(0, int(math.log(max(n, 1)) / math.log(BAND)) - 1)
    while band_end(b) < n:
        b += 1
    return b


def band_end(b: int) -> int:
    return int(BAND ** (b + 1))


def most_different(sizes: int, num: int, den: int) -> int:
    """Largest symmetric difference of sets of together ``sizes`` elements with similarity num / den or more."""
    return sizes * (den - num) // (den + num)


@dataclass(frozen=True)
class Plan:
    segments: int       # all of them; the first ``deleted`` ones have one-deletion neighbourhoods
    deleted: int
    spare: int


def allocate(band: int, num: int, den: int, sets: int) -> Plan:
    """Segments of a band: the cheapest mix for about ``sets`` sets in it."""
    end = band_end(band)
    size = max(1.0, end / BAND)
    h = most_different(2 * end, num, den)
    best = None
    for spare in sorted({math.ceil(s * (h + 1)) for s in SPARES}) if h else (0,):
        units = h + 1 + spare
        for share in (0, 0.1, 0.25, 0.5, 1):
            deleted = int(share * units / 2)
            segments = units - deleted
            each = size / segments
            rows = segments + deleted * (each + 1)
            # sets that have nothing in a segment match in it by accident; no such one is signed up to the spare units
            empty = segments * math.exp(-each)
            left = max(0.0, empty + 3 * math.sqrt(empty) - spare)
            cost = rows + sets * math.exp(-each) * left
            if best is None or cost < best[0]:
                best = cost, Plan(segments, deleted, spare)
    return best[1]


def signed_segments(n: int, band: int, plan: Plan, num: int, den: int) -> int:
    """How many segments, from the first, a set of size n signs in a band; 0 if only equal sets are that similar."""
    h = most_different(n + min(band_end(band), n * den // num), num, den)
    units = h + 1 + plan.spare
    return min(plan.segments, max((units + 1) // 2, units - plan.deleted)) if h else 0


def shingles(text: str, n: int) -> list[tuple[bytes, ...]]:
    w = encoded(text).lower().split()
    if not w:
        return []
    return [tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))]


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(docs: list[str], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(docs):
        split, size = [], 0
        while at < len(docs) and (not split or size < 500_000):
            split.append(encoded(docs[at]).lower().split())     # bytes split at \x20 and \x09-\x0D alone
            size += len(split[-1])
            at += 1
        flat = [w for s in split for w in s]
        h = pd.util.hash_array(np.array(flat, dtype=object), categorize=True) if flat else np.zeros(0, np.uint64)
        begin = 0
        for s in split:
            own, k = h[begin:begin + len(s)], min(n, len(s))
            begin += len(s)
            x = np.full(max(0, len(s) - k + 1) if s else 0, k, np.uint64)
            for i in range(k):
                x = mixed(x + own[i:i + len(x)], i + 1)
            out.append(np.unique(x))
    return out


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether the number of elements in each hash class is odd, 64 classes to a number."""
    bits = 64 * len(PARITIES)
    odd = np.bincount((mixed(hashes, 11) >> np.uint64(40)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(hashes: np.ndarray, band: int, plan: Plan, first: int) -> tuple[np.ndarray, int]:
    """Signatures of the first segments, exact and of all one-deletion neighbours; how many may be dropped."""
    where = (mixed(hashes, 101 + band) >> np.uint64(11)).astype(np.float64) * (plan.segments / 2.0 ** 53)
    where = where.astype(np.int64)
    inside = where < first
    where, value = where[inside], mixed(hashes[inside], 7)
    order = np.argsort(where, kind="stable")
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value[order])))
    many = np.bincount(where, minlength=first)
    ends = np.cumsum(many)
    sums = total[ends] - total[ends - many]
    salt = mixed(np.arange(first, dtype=np.uint64), 1009 + band)
    gone = where < plan.deleted
    empty = many == 0
    empty[:plan.deleted] = False
    left = plan.spare - int(np.count_nonzero(empty))
    signed = ~empty if left >= 0 else np.ones(first, bool)
    sigs = mixed(np.concatenate(((sums + salt)[signed], sums[where[gone]] - value[gone] + salt[where[gone]])), 3)
    droppable = np.zeros(len(sigs), np.uint64)
    droppable[:np.count_nonzero(signed)] = np.flatnonzero(signed) >= plan.deleted
    low = np.uint64(BAND_BITS + 1)
    return sigs >> low << low | droppable << np.uint64(BAND_BITS) | np.uint64(band), max(0, left)


def _sign(n: int, num: int, den: int, sets: int):
    plans: dict[int, Plan] = {}
    seen: set[bytes] = set()

    def work(batch):
        if len(seen) > SEEN_PRINTS:
            seen.clear()
        sizes, prints, sigs, drops, parity = [], [], [], [], []
        for h in shingle_hashes(texts(batch), n):
            size = len(h)
            print_ = hashlib.blake2b(h.tobytes(), digest_size=16).digest() if size else None
            sizes.append(size)
            prints.append(print_)
            parity.append(parities(h))
            own, drop = [], []
            if size and print_ not in seen:
                seen.add(print_)
                for band in range(bands(size), bands(size * den // num) + 1):
                    plan = plans.get(band) or plans.setdefault(band, allocate(band, num, den, sets))
                    first = signed_segments(size, band, plan, num, den)
                    if first:
                        found, left = signatures(h, band, plan, first)
                        own.append(found.view(np.int64))
                        drop.append({"band": band, "left": left})
            sigs.append(np.concatenate(own) if own else np.zeros(0, np.int64))
            drops.append(drop)
        columns = np.array(parity, np.int64).reshape(-1, len(PARITIES)).T
        ends = np.cumsum([0] + [len(x) for x in sigs]).astype(np.int32)
        lists = pa.ListArray.from_arrays(ends, np.concatenate([*sigs, np.zeros(0, np.int64)]))
        yield {"id": batch.column("id"), "n": sizes, "print": prints, "sigs": lists, "drops": drops,
               **{k: np.ascontiguousarray(c) for k, c in zip(PARITIES, columns)}}
    return work


def _verify(n: int, num: int, den: int):
    """map_batches function: pairs whose texts' sets are similar enough; rows sorted by the first of the pair."""
    last: list = [None, set()]

    def work(batch):
        keep = []
        ta, tb = texts(batch, "ta"), texts(batch, "tb")
        for a, x, y in zip(batch.column("a").to_pylist(), ta, tb):
            if last[0] != (a, x):
                last[0], last[1] = (a, x), set(shingles(x, n))
            sx, sy = last[1], set(shingles(y, n))
            both = len(sx & sy)
            keep.append(den * both >= num * (len(sx) + len(sy) - both))
        yield {"a": batch.column("a"), "b": batch.column("b"), "linked": keep}
    return work


def jaccard_components(docs: DataFrame, shingle: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): sets with den * intersection >= num * union are linked."""
    rows = pick(docs, id=id_col, text=text_col)
    id_type = rows.dtypes[0][1]
    total = rows.count()
    sets = max(1, total // 8)                       # sets of one band, for the cost of accidental matches
    signed = written(map_batches(rows, lambda: _sign(shingle, num, den, sets), f"""id {id_type}, n int, print binary,
        {", ".join(f"{k} long" for k in PARITIES)}, sigs array<long>,
        drops array<struct<band: int, left: int>>""", PIECE_BYTES), "signatures")
    classes = written(signed.filter("n > 0").groupBy("print").agg(
        F.min("id").alias("rep"), F.first("n").alias("n"), *[F.first(k).alias(k) for k in PARITIES])
        .withColumn("key", F.xxhash64("print")), "classes")
    # sets that share a signature; a signature of one set alone has no pair
    same = Window.partitionBy("sig")
    every = signed.filter("n > 0").select(F.explode("sigs").alias("sig"), F.xxhash64("print").alias("key"))
    shared = (every.withColumn("lo", F.min("key").over(same)).withColumn("hi", F.max("key").over(same))
              .filter("lo < hi").select("sig", "key").distinct().withColumn("freq", F.count(F.lit(1)).over(same)))
    drops = (signed.filter(F.size("drops") > 0).select(F.xxhash64("print").alias("key"), F.inline("drops"))
             .groupBy("key", "band").agg(F.min("left").alias("left")))
    live = _rarer(shared, drops).withColumn("comp", F.col("key"))
    comps = _linked(written(_unsettled(live), "buckets"), rows, classes, shingle, num, den)
    if comps is None:
        labels = classes.select("print", F.col("rep").alias("low"))
    else:
        tagged = classes.join(comps, "print", "left").withColumn("comp", F.coalesce("comp", "print"))
        lows = tagged.groupBy("comp").agg(F.min("rep").alias("low"))
        labels = tagged.join(lows, "comp").select("print", "low")
    out = signed.select("id", "n", "print").join(labels, "print", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
                      F.coalesce("low", "id").alias("component_id"))


def _rarer(shared: DataFrame, drops: DataFrame) -> DataFrame:
    """Without the most frequent signatures of each set, as many as its spare units leave."""
    low = 1 << BAND_BITS
    kind = shared.withColumn("band", F.col("sig").bitwiseAND(F.lit(low - 1)).cast("int")).withColumn(
        "may", F.col("sig").bitwiseAND(F.lit(low)) != 0)
    rank = F.row_number().over(Window.partitionBy("key", "band").orderBy(F.desc("may"), F.desc("freq"), "sig"))
    return (kind.join(drops, ["key", "band"]).withColumn("rank", rank)
            .filter(~F.col("may") | (F.col("rank") > F.col("left"))).select("sig", "key"))


def _may_link(num: int, den: int) -> Column:
    """False where sizes, or the parities of two sets, differ more than those of two similar sets can."""
    n, m = F.col("x.n"), F.col("y.n")
    apart = sum((F.bit_count(F.col(f"x.{k}").bitwiseXOR(F.col(f"y.{k}"))) for k in PARITIES), F.lit(0))
    return (F.least(n, m) * den >= F.greatest(n, m) * num) & (apart * (den + num) <= (n + m) * (den - num))


def _linked(live: DataFrame, rows: DataFrame, classes: DataFrame, shingle: int, num: int, den: int) -> DataFrame | None:
    """(print, comp) of all set prints that have a link; comp is the smallest print that chains of links reach."""
    facts = classes.drop("rep")
    labels, tested, hubs, known = None, None, 1, 0
    left = live.count()
    while left:
        # every member of a bucket of no more members than hubs is a hub; otherwise one of each hash class is
        salt = F.when(F.col("size") <= hubs, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(hubs)))
        hub = (live.withColumn("salt", salt).groupBy("sig", "salt")
               .agg(F.min("key").alias("key"), F.min_by("comp", "key").alias("comp")).drop("salt"))
        x, y = live.join(facts, "key").alias("x"), hub.join(facts, "key").alias("y")
        # sizes and parities are tested where the pair is made; no other pair is ever a row
        pairs = (x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.key") != F.col("y.key"))
                        & (F.col("x.comp") != F.col("y.comp")) & _may_link(num, den))
                 .select(F.least("x.print", "y.print").alias("a"), F.greatest("x.print", "y.print").alias("b")).distinct())
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        many = pairs.count()
        rest = live.join(hub.select("sig", "key"), ["sig", "key"], "left_anti")
        # where no pair is left to verify, the hubs are done with and nothing else changes
        if many:
            tested = pairs if tested is None else tested.unionByName(pairs)
            new = written(verified(pairs, many, rows, classes, shingle, num, den).filter("linked").select("a", "b"),
                          "links", many, VERIFIED_BY_TASK)
            fresh = new.count()
            if fresh:
                known += 2 * fresh
                labels = _merged(labels, new, known)
                comps = labels.groupBy(F.xxhash64("print").alias("key")).agg(F.min(F.xxhash64("comp")).alias("now"))
                rest = rest.join(comps, "key", "left").withColumn("comp", F.coalesce("now", "comp")).drop("now")
        live = written(_unsettled(rest.select("sig", "key", "comp")), "buckets", left)
        left = live.count()
        hubs *= HUB_GROWTH
    return labels


def _merged(labels: DataFrame | None, links: DataFrame, most: int | None = None) -> DataFrame:
    """The labels (print, comp), ``most`` at most, after some more links (a, b); prints without one are their own."""
    if labels is None:
        return components(links).select(F.col("node").alias("print"), "comp")
    for end in ("a", "b"):
        of = labels.select(F.col("print").alias(end), F.col("comp").alias("to"))
        links = links.join(of, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    # the smallest print names a component, so the smallest name of merged ones is the smallest print of all
    moved = components(links.distinct()).select(F.col("node").alias("comp"), F.col("comp").alias("now"))
    fresh = moved.join(labels.select(F.col("print").alias("comp")), "comp", "left_anti")
    return written(labels.join(moved, "comp", "left").select("print", F.coalesce("now", "comp").alias("comp"))
                   .unionByName(fresh.select(F.col("comp").alias("print"), F.col("now").alias("comp"))), "components", most)


def _unsettled(members: DataFrame) -> DataFrame:
    """Members of the buckets that still hold two components, and the number of members of each such bucket.

    The buckets are counted by partial aggregates, so a signature that very many sets have is no hot group; the
    join back to its members is one that Spark splits.
    """
    open_ = (members.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size"))
             .filter("lo < hi").select("sig", "size"))
    return members.join(open_, "sig")


def verified(pairs: DataFrame, many: int, rows: DataFrame, classes: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """(a, b, linked) of ``many`` pairs of set prints, decided on the texts of one document of each."""
    reps = classes.select("print", "rep")
    wanted = pairs.select(F.col("a").alias("print")).unionByName(pairs.select(F.col("b").alias("print"))).distinct()
    who = written(reps.join(wanted, "print", "left_semi"), "wanted", 2 * many)
    own = (_mostly(rows, who).join(who, F.col("id").eqNullSafe(F.col("rep")))
           .withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))).select("print", "text"))
    found = written(_matching(own, shingle), "texts", 2 * many, VERIFIED_BY_TASK)
    both = (pairs.join(found.select(F.col("print").alias("b"), F.col("text").alias("tb")), "b")
            .join(found.select(F.col("print").alias("a"), F.col("text").alias("ta")), "a"))
    return map_batches(both.sortWithinPartitions("a").select("a", "b", "ta", "tb"),
                       lambda: _verify(shingle, num, den), "a binary, b binary, linked boolean", PIECE_BYTES)


def _mostly(rows: DataFrame, who: DataFrame) -> DataFrame:
    """Rows whose id's bit is set by a wanted id, so that few other texts are shuffled to the exact join.

    The broadcast side has at most FILTER_WORDS rows of two numbers, 4 MB, at any size of the tables.
    """
    def slot(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(FILTER_WORDS))

    def bit(c: str) -> Column:
        return F.expr(f"shiftleft(1L, cast(pmod(shiftright(xxhash64({c}), 40), 64) as int))")
    bits = who.groupBy(slot("rep").alias("slot")).agg(F.bit_or(bit("rep")).alias("bits"))
    return (rows.withColumn("slot", slot("id")).join(F.broadcast(bits), "slot")
            .filter(F.col("bits").bitwiseAND(bit("id")) != 0).select("id", "text"))


def _matching(own: DataFrame, shingle: int) -> DataFrame:
    """One text for each print: where an id stands for several texts, only one with that print is kept."""
    def start():
        def work(batch):
            got = texts(batch)
            right = [hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in shingle_hashes(got, shingle)]
            keep = np.array([p == r for p, r in zip(batch.column("print").to_pylist(), right)], bool)
            at = np.flatnonzero(keep)
            yield {"print": batch.column("print").take(at), "text": [got[i] for i in at]}
        return work
    return map_batches(own, start, "print binary, text string", PIECE_BYTES).groupBy("print").agg(F.min("text").alias("text"))
