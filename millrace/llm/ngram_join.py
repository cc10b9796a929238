"""N-gram Jaccard join: all links of similarity 0.9 (or another bound) between sets of word shingles, and components.

Universe-partition pigeonhole. Sets are banded by size; in a band whose sets have at most B shingles, two sets that
link differ in at most H = floor(2 B (1 - t) / (1 + t)) shingles. Shingles are hashed into m segments. A plain segment is
indexed by its subset of a set: if no indexed subset is shared, the segment costs a difference. A segment with deletions is
indexed by its subset and all subsets with one shingle deleted; not to share it costs two differences. Subsets of up to
`weak` shingles, the empty one always among them, are not indexed and cost nothing, since sets share them by chance.
For each band the number of segments, of deletion neighbourhoods and the weak size are the cheapest by a cost model: keys
written, and chance candidates, from the number of sets in the band (counted over all documents).

A set indexes its first segments until they cost more differences than it can have from any set of the band it links
with. Of two sets, the one with the shorter run proves that a key is shared: within its run the other would have to differ
in more. Sets whose segments cannot cost so much (poor sets: too many weak subsets) index all segments, and among
themselves they are indexed once more, by fewer and larger segments with deletions; those that are poor again (next to
none) by the plain scheme, in which every subset counts. Sets near a band's upper end are indexed in the next band too.

What sets of one block (HELD_KEYS keys of an Arrow batch) share is settled there: a key goes on once a block, so a key that a third of all
sets hold is as many rows as there are blocks. Candidates are never all pairs of a key's members: copies of a word sequence are one node,
and in each round members are compared with one pivot of the key, members already connected to it being left out. What is
still in different components of a key after the rounds is compared pair by pair, a key of many members being dealt out
over pairs of blocks of at most about BLOCK of them. A parity bitmap of 1024 bits rules out pairs first (its distance is
never above the difference of the sets); every other pair is verified on the shingles of the whole texts, which are told
apart by 128-bit BLAKE2b digests of their words; 64-bit hashes make candidates only.

Defined results: null and empty texts have 0 shingles and are components of their own; texts with fewer words than a
shingle are one shingle, the whole sequence; repeated texts are linked; repeated rows of a doc_id are one document's, and
each gets its row; a row without a doc_id links with nothing and has no component; an empty table gives an empty table;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import erfc, lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import BROADCAST_IDS, components, only_ids, written
from ._words import U, Words, firsts, mix, slices, utf8, windows

BITS = 1024
BAND_GROWTH = 1.5
#: Assumed chance that a shingle of one set is in another of its band; it moves cost only, never results. Counted over
#: all distinct sets of prose with copies, boilerplate and near copies: 0.0007 for three words, 0.0004 for five.
SHARED = 0.001
PIVOT_ROUNDS = 2
#: Subsets of at most so many shingles may be called weak; of poor sets the cost model allows this share.
MOST_WEAK, MOST_POOR = 4, 0.2
#: Keys held at once by a worker: what sets of a block share is settled among so many.
HELD_KEYS = 1 << 20
#: Members of a key that are compared pair by pair in one block.
BLOCK = 2000


@dataclass(frozen=True)
class Rule:
    """width: words of a shingle; two sets link if 100 * intersection >= percent * union."""

    width: int = 3
    percent: int = 90
    max_size: int = 1 << 40

    def bands(self) -> np.ndarray:
        """Least sizes of the bands; the last is beyond any size."""
        b = [1]
        while b[-1] < self.max_size:
            b.append(max(b[-1] + 1, int(b[-1] * BAND_GROWTH)))
        return np.array(b, np.int64)

    def differing(self, r, s):
        """Most shingles in which linked sets of these sizes differ."""
        return (r + s) * (100 - self.percent) // (100 + self.percent)


@dataclass(frozen=True)
class Plan:
    """Segments of a band; the first of them have deletions; subsets of up to so many shingles are not indexed."""

    segments: int
    deletions: int
    weak: int


def _counts(size: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of so many shingles fall into a segment (j), and the chance of it: binomial."""
    if segments == 1:
        return np.array([size]), np.ones(1)
    mean = size / segments
    j = np.arange(max(0, int(mean - 9 * mean**0.5 - 9)), min(size, int(mean + 9 * mean**0.5 + 9)) + 1)
    if mean > 200:  # as good as normal here
        p = np.exp(-((j - mean) ** 2) / (2 * mean))
        return j, p / p.sum()
    log = np.array([lgamma(size + 1) - lgamma(k + 1) - lgamma(size - k + 1) for k in j.tolist()])
    return j, np.exp(log + j * np.log(1 / segments) + (size - j) * np.log1p(-1 / segments))


def cost(size: int, differing: int, population: int, plan: Plan) -> tuple[float, float]:
    """(cost, share of poor sets) of a plan for so many sets of so many shingles: keys a set writes, and chance
    candidates it meets, poor sets being indexed twice."""
    j, p = _counts(size, plan.segments)
    one, two = j > plan.weak, j > plan.weak + 1
    plain, both = (p * one).sum(), one.astype(float) + two
    mean = plan.deletions * (p * both).sum() + (plan.segments - plan.deletions) * plain
    spread = plan.deletions * ((p * both**2).sum() - (p * both).sum() ** 2) + (plan.segments - plan.deletions) * plain * (1 - plain)
    need = differing + 1
    gap = mean - need + 0.5
    poor = 0.5 * erfc(gap / (2 * spread) ** 0.5) if spread > 1e-12 else float(gap < 0)
    first = min(float(plan.deletions), need / max((p * both).sum(), 1e-9))  # segments with deletions in a run
    rest = max(need - first * (p * both).sum(), 0.0)  # plain keys
    near = np.power(SHARED, np.minimum(j, 60) * 1.0)
    keys = first * (p * (one + two * j)).sum() + rest
    chance = first * (p * (one * near + two * 2 * j * near / SHARED)).sum() + (rest / plain * (p * one * near).sum() if plain > 1e-9 else 0.0)
    return keys + population * chance + poor * (5 * need + population * SHARED), poor


def allocate(size: int, differing: int, population: int) -> Plan:
    """The cheapest plan for a band of so many sets of up to so many shingles that differ in so many when they link."""
    if differing == 0:
        return Plan(1, 0, 0)
    need, best = differing + 1, None
    for share in np.linspace(0.5, 1.6, 23):
        m = max(1, round(need * share))
        for part in (0.0, 0.1, 0.25, 0.5, 0.75, 1.0):
            for weak in range(MOST_WEAK + 1):
                plan = Plan(m, round(m * part), weak)
                # the band's smaller sets have as much smaller segments
                price, poor = cost(size, differing, population, plan)
                small = cost(max(1, int(size / BAND_GROWTH)), int(differing / BAND_GROWTH), population, plan)[1]
                rank = (max(poor, small) > MOST_POOR, max(poor, small) if max(poor, small) > MOST_POOR else 0.0, price)
                if best is None or rank < best[0]:
                    best = (rank, plan)
    return best[1]


def again(differing: int, level: int) -> Plan:
    """Plans for sets that are poor: fewer, larger segments with deletions; then every subset counts, empty or not."""
    m = differing // 2 + 2 + differing // 8
    return Plan(m, m, 0) if level == 1 else Plan(differing + 1, 0, -1)


def _unique(doc: np.ndarray, *name: np.ndarray) -> tuple[np.ndarray, ...]:
    """The places of the distinct (doc, name), in order."""
    order = np.lexsort((*reversed(name), doc))
    same = np.ones(len(order), bool)
    for x in (doc, *name):
        same[1:] &= x[order[1:]] == x[order[:-1]]
    same[:1] = False
    return order[~same]


def _places(w: Words, width: int) -> list[tuple[int, np.ndarray]]:
    """(words, first words) of the shingles: whole texts where they have fewer words than a shingle."""
    return [(width, w.valid(width)), *((k, w.first[np.flatnonzero(w.counts == k)]) for k in range(1, width))]


def shingles(w: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of shingles, sorted within each document, and the first of each document: for candidates.
    And the number of distinct shingles of each document: those of equal hashes are told apart by their words."""
    h, at = w.hashes(), _places(w, width)
    x = np.concatenate([windows(h, places, k) for k, places in at])
    doc = np.concatenate([w.doc[places] for _, places in at])
    order = np.argsort(x)
    order = order[np.argsort(doc[order].astype(np.uint16), kind="stable")]
    x, doc = x[order], doc[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    more = np.zeros(w.docs, np.int64)
    if not new.all():
        same = ~new
        same[:-1] |= ~new[1:]
        size, place = np.repeat([k for k, _ in at], [len(p) for _, p in at])[order[same]], np.concatenate([p for _, p in at])[order[same]]
        name = np.zeros((len(place), 2), U)
        for k in np.unique(size).tolist():
            name[size == k] = w.digests(place[size == k], k)
        of = doc[same]
        more = np.bincount(of[_unique(of, name[:, 0], name[:, 1])], minlength=w.docs) - np.bincount(of[new[same]], minlength=w.docs)
    x, doc = x[new], doc[new]
    first = np.searchsorted(doc, np.arange(w.docs + 1))
    return x, first, np.diff(first) + more


def exact(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 128-bit digests of shingles (two columns), sorted within each document, and the first of each document."""
    at = _places(w, width)
    x = np.concatenate([w.digests(places, k) for k, places in at])
    doc = np.concatenate([w.doc[places] for _, places in at])
    order = _unique(doc, x[:, 0], x[:, 1])
    x, doc = x[order], doc[order]
    return x, np.searchsorted(doc, np.arange(w.docs + 1))


def common(r: np.ndarray, s: np.ndarray) -> int:
    """How many rows of two sorted sets of digests are in both."""
    if (r[1:, 0] == r[:-1, 0]).any() or (s[1:, 0] == s[:-1, 0]).any():
        return len(set(map(tuple, r.tolist())) & set(map(tuple, s.tolist())))
    _, a, b = np.intersect1d(r[:, 0], s[:, 0], assume_unique=True, return_indices=True)
    return int((r[a, 1] == s[b, 1]).sum())


def features(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n (shingles), a 128-bit digest of the word sequence (c1, c2), and the set's parity bitmap."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch["text"])
            for i, j in slices(offsets):
                w = Words(data, offsets, i, j, lower=True)
                x, first, n = shingles(w, rule.width)
                doc = np.repeat(np.arange(j - i), np.diff(first))
                odd = np.bincount(doc * BITS + (x >> U(54)).astype(np.int64), minlength=(j - i) * BITS) & 1
                bits = np.packbits(odd.astype(np.uint8).reshape(j - i, BITS), axis=1, bitorder="little").view("<i8")
                total = w.sequences().view("<i8")
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(total[:, 0].copy()), pa.array(total[:, 1].copy()), pa.FixedSizeListArray.from_arrays(pa.array(bits.ravel()), BITS // 64).cast(pa.list_(pa.int64()))],
                    names=["doc_id", "n", "c1", "c2", "bits"],
                )

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, n long, c1 long, c2 long, bits array<long>")


def subsets(x: np.ndarray, doc: np.ndarray, need: np.ndarray, m: np.ndarray, deletions: np.ndarray, weak: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, their sets, whether each set is poor). x: the hashes of the sets doc, each of which has m segments."""
    start = np.concatenate([[0], np.cumsum(m)])
    value = mix(x ^ U(0xD6E8FEB86659FD93))
    segment = ((x >> U(16)) % np.maximum(m, 1)[doc].astype(U)).astype(np.int64)
    at = start[doc] + segment
    total, count = np.zeros(start[-1], U), np.bincount(at, minlength=start[-1])
    np.add.at(total, at, value)
    owner = np.repeat(np.arange(len(m)), m)
    place = np.arange(start[-1]) - start[owner]
    more = place < deletions[owner]
    one = count > weak[owner]
    two = one & more & (count > weak[owner] + 1)
    costs = np.concatenate([[0], np.cumsum(one.astype(np.int64) + two)])
    run = costs[:-1] - costs[start[owner]] < need[owner]
    salted = mix(salt[owner] ^ place.astype(U))
    whole, less = run & one, (run & two)[at]
    poor = costs[start[1:]] - costs[start[:-1]] < need
    return np.concatenate([mix(total[whole] ^ salted[whole]), mix((total[at[less]] - value[less]) ^ salted[at[less]])]), np.concatenate([owner[whole], doc[less]]), poor


def signatures(docs: DataFrame, rule: Rule, plan: dict[int, Plan]) -> DataFrame:
    """(part, key, doc_id, known) of every indexed subset. plan: by band, what allocate() gives. The first set of a block
    that has a key stands for all with key null and part the key; the others are known to share it."""
    bands = rule.bands()
    least = rule.percent / 100

    def keys(x: np.ndarray, doc: np.ndarray, n: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = np.where(band >= 0, bands[np.minimum(band, len(bands) - 2) + 1] - 1, 0)
        need = rule.differing(n, np.minimum(top, n * 100 // rule.percent)) + 1
        found, owners = [], []
        on = np.array([b in plan for b in band.tolist()], bool) & (n > 0)
        for level in range(3):
            if not on.any():
                break
            of = {b: plan[b] if level == 0 else again(rule.differing(int(bands[b + 1]) - 1, int(bands[b + 1]) - 1), level) for b in np.unique(band[on]).tolist()}
            m, deletions, weak = (np.array([getattr(of[b], f) if o else 0 for b, o in zip(band.tolist(), on.tolist())], np.int64) for f in ("segments", "deletions", "weak"))
            mine = on[doc]
            key, owner, poor = subsets(x[mine], doc[mine], need, m, deletions, weak, mix(np.maximum(band, 0).astype(U) << U(44) ^ U(level << 60)))
            found.append(key)
            owners.append(owner)
            on = on & poor
        return np.concatenate([*found, np.zeros(0, U)]), np.concatenate([*owners, np.zeros(0, np.int64)])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch["text"])
            ids = np.asarray(batch["doc_id"])
            found, owners, held = [], [], 0
            cuts = list(slices(offsets))
            for i, j in cuts:
                x, first, n = shingles(Words(data, offsets, i, j, lower=True), rule.width)
                doc = np.repeat(np.arange(j - i), np.diff(first))
                band = np.searchsorted(bands, n, "right") - 1
                above = np.where((n > 0) & (n >= least * bands[np.minimum(band + 1, len(bands) - 1)] - 1e-9), band + 1, -1)
                for b in (band, above):
                    key, of_doc = keys(x, doc, n, b)
                    found.append(key)
                    owners.append(ids[i + of_doc])
                    held += len(key)
                if held < HELD_KEYS and j < cuts[-1][1]:
                    continue
                key, doc = np.concatenate(found), np.concatenate(owners)
                found, owners, held = [], [], 0
                order, lead, more = firsts(key, doc)
                key, doc = key[order], doc[order]
                part = np.where(lead, key, mix(key ^ mix(doc.view(U))))
                yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array(key.view(np.int64), mask=lead), pa.array(doc), pa.array(~lead | more)], names=["part", "key", "doc_id", "known"])

    return docs.select("doc_id", "text").mapInArrow(of, "part long, key long, doc_id long, known boolean")


def verify(pairs: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """Of the pairs (a, b), those whose whole texts link."""
    need = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "need")
    texts = written(only_ids(docs.select("doc_id", "text"), need), "texts")
    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (dx, ox), (dy, oy) = utf8(batch["x"]), utf8(batch["y"])
            fits = np.zeros(len(batch), bool)
            for i, j in slices(ox + oy):
                both = []
                for d, o in ((dx, ox), (dy, oy)):
                    both.append(exact(Words(d, o, i, j, lower=True), rule.width))
                for k in range(j - i):
                    r, s = (x[f[k] : f[k + 1]] for x, f in both)
                    both_have = common(r, s)
                    fits[i + k] = 100 * both_have >= rule.percent * (len(r) + len(s) - both_have)
            keep = pa.array(fits)
            yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], names=["a", "b"])

    return pairs.join(one, "a").join(two, "b").mapInArrow(of, "a long, b long")


def apart(bits_a: str, bits_b: str):
    """In how many bits two bitmaps differ."""
    return F.aggregate(F.zip_with(bits_a, bits_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def near(bits_a: str, bits_b: str, n_a: str, n_b: str, rule: Rule):
    """Whether sizes and bitmaps allow the pair to link: parity differs in no more bits than the sets may in shingles."""
    most = F.floor((F.col(n_a) + F.col(n_b)) * (100 - rule.percent) / (100 + rule.percent) + F.lit(1e-9))
    return (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * rule.percent) & (apart(bits_a, bits_b) <= most)


def link(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id with the same word sequence), component_id."""
    found = written(features(docs, rule), "features")
    full = found.where("n > 0 and doc_id is not null")
    classes = written(full.groupBy("n", "c1", "c2").agg(F.min("doc_id").alias("class_id")), "classes")
    member = written(found.select("doc_id", "n", "c1", "c2").join(classes, ["n", "c1", "c2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id")), "member")
    copies = written(member.where("doc_id <> class_id").select("doc_id"), "copies")
    nodes = only_ids(docs.select("doc_id", "text").where("doc_id is not null"), copies, how="left_anti")

    bands = rule.bands()
    band = F.when(F.lit(False), F.lit(0))
    for k in range(len(bands) - 1):
        band = band.when((F.col("n") >= int(bands[k])) & (F.col("n") < int(bands[k + 1])), F.lit(k))
    sizes = {r["band"]: r["count"] for r in full.groupBy(band.alias("band")).count().collect()}  # a row a band: about 70 at most
    plan = {}
    for k in sizes:
        top = int(bands[k + 1]) - 1
        plan[k] = allocate(top, rule.differing(top, top), sizes[k] + sizes.get(k - 1, 0))

    w = Window.partitionBy("part")
    rows = signatures(nodes, rule, plan).withColumns({"lo": F.min("doc_id").over(w), "hi": F.max("doc_id").over(w), "any": F.max("known").over(w)})
    members = written(rows.where("lo < hi or any").select(F.coalesce("key", "part").alias("key"), "doc_id").distinct(), "members")
    marks = written(found.join(members.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "n", "bits"), "marks")

    def with_marks(pairs: DataFrame) -> DataFrame:
        a, b = (marks.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
        both = pairs.join(a, "a").join(b, "b").where(near("bits_a", "bits_b", "n_a", "n_b", rule))
        return both.select("a", "b", apart("bits_a", "bits_b").alias("apart"))

    links = tested = None
    comp = members.select("doc_id", F.col("doc_id").alias("comp")).distinct()
    for k in range(PIVOT_ROUNDS + 1):
        now = members.join(comp, "doc_id")
        pivot = (F.min, F.max)[k % 2](F.struct("doc_id", "comp")).alias("p")
        open_keys = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), pivot).where("lo < hi")
        if k < PIVOT_ROUNDS:
            met = now.join(open_keys.select("key", "p"), "key").where(F.col("comp") != F.col("p.comp"))
            met = with_marks(met.select(F.col("doc_id").alias("a"), F.col("p.doc_id").alias("b")).distinct())
            best = met.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b"))  # the rest is left to the rounds after
            pairs = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        else:
            rest = now.join(open_keys.select("key"), "key", "left_semi")
            many = rest.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("parts")).where("parts > 1")
            many = written(many, "many")  # a row for BLOCK members at least
            # a key of many members is dealt out over pairs of blocks; within a pair of blocks each pair meets once
            rest = rest.join(F.broadcast(many) if many.count() <= BROADCAST_IDS // 4 else many.hint("merge"), "key", "left").withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1))))
            rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
            rest = rest.withColumn("key", F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))))
            rest = written(rest.select("key", "doc_id", "comp").join(marks, "doc_id"), "open")
            a, b = (rest.select("key", F.col("doc_id").alias(c), F.col("comp").alias(f"comp_{c}"), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
            both = a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & (F.col("comp_a") != F.col("comp_b")) & near("bits_a", "bits_b", "n_a", "n_b", rule))
            pairs = both.select("a", "b").distinct()
        pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        fits = written(verify(pairs, docs, rule), "links")
        if fits.isEmpty():
            tested = pairs if tested is None else tested.union(pairs)
            continue
        tested = pairs if tested is None else tested.union(pairs)
        links = fits if links is None else links.union(fits)
        grown = components(links)
        comp = written(members.select("doc_id").distinct().join(grown.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("comp")), "comp")
    out = member.join(comp.withColumnRenamed("doc_id", "class_id"), "class_id", "left")
    return out.select("doc_id", "n_shingles", "class_id", F.coalesce("comp", "class_id").alias("component_id"))
