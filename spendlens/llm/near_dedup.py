"""MinHash near-duplicates with bottom-k sketches from one hash function (operator 3).

A document is the set of its distinct word shingles; its sketch is the ``k`` smallest hashes of
that set.  Two documents link when 100 * |A & B| >= percent * |A | B|, decided on full sets.

1. Equal sets are one class (a digest), so copies are never paired with each other.
2. Inverted lists of retained values give candidates.  Two linked sets share at least ``need`` of
   their ``k`` values (``SURE`` standard deviations below the mean; sets of at most k shingles are
   their own sketch and the bound is exact), so ordering each sketch from the rarest value up, its
   first ``size - need + 1`` values must meet the other's: only those make lists.  Values that many
   documents share stand last and are mostly not listed; members of lists that are long all the same
   are listed by their full sets, where the bound is exact and such values hardly ever come up.
3. A list is not multiplied out.  Each member is paired with the list's most central member (linear).
   Pairs pass a union-sketch estimate, then exact Jaccard on full sets, and links are grouped into
   components.  Only then are pairs across components made, for lists that still hold several: a
   member outside the list's largest component meets all members of other components.  Pairs
   inside a component cannot change it, so nothing is lost.  A list's value also bounds what two members can
   share if it is their first common one, by their values from there on: copies with edits of their own, whose lone
   values stand first, are told apart so without a pair.
4. Components by alternating large-star and small-star steps over tables in the shared folder.

Result per document: n_shingles, component_id (smallest doc_id reachable), kept.

Cases: a null or empty text, or one without words, has an empty set and links with nothing; fewer
words than a shingle make the whole sequence one shingle; rows that repeat a doc_id are one node
and each gets its row; rows with a null doc_id are never linked and get a null component and
kept = false; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import SPACE_WORDS, chunks, hash_runs, hash_words, mix64, on_workers, release, stage, utf8

K = 64
SURE = 6.0
CROWD = 16  # longer lists are replaced by exact ones
VERIFY_MEMBERS = 256  # members checked against one set in one group; larger lists are split


def shared_values(k: int, percent: int) -> int:
    """Values that the sketches of two linked sets share, but for ``SURE`` standard deviations."""
    j = percent / 100
    return max(1, math.floor(k * j - SURE * math.sqrt(k * j * (1 - j))))


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    words, offsets = hash_words(texts, SPACE_WORDS)
    runs = hash_runs(words, n)
    out = []
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if high - low >= n:
            out.append(np.unique(runs[low : high - n + 1]))
        elif high > low:
            # the sequence itself, told apart from longer ones by its length
            out.append(mix64(hash_runs(words[low:high], high - low) + np.uint64(high - low)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def sketches(docs: DataFrame, n: int, k: int) -> DataFrame:
    """(doc_id, digest, n_shingles, sketch) of every row; sketch values are signed 64-bit."""

    def run(batches):
        for batch in batches:
            for low, texts in chunks(utf8(batch.column(1))):
                sets = shingle_sets(texts, n)
                small = [np.sort(s[:k]).astype(np.int64) for s in sets]  # sets are sorted: bottom k
                yield pa.record_batch(
                    [
                        batch.column(0).slice(low, len(texts)).cast(pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.ListArray.from_arrays(
                            np.cumsum([0, *map(len, small)]).astype(np.int32), pa.array(np.concatenate([*small, np.empty(0, np.int64)]))
                        ),
                    ],
                    names=["doc_id", "digest", "n_shingles", "sketch"],
                )

    schema = "doc_id long, digest binary, n_shingles long, sketch array<long>"
    return on_workers(docs).select("doc_id", "text").mapInArrow(run, schema)


def rarest(each: DataFrame, need) -> DataFrame:
    """(value, digest, n, central, left) of the listed values: each class's rarest ones, ``size - need + 1`` of them.

    ``left`` is the number of the class's values from this one on, in the order from the rarest.
    ``central`` is the mean number of classes that hold one of the class's values: of a text and its edited
    copies, the text itself has the largest one.

    ``each``: (digest, n, size, value), all values of every class.  Two classes that share ``need`` of
    their values have a common one among those.  Rarity is counted over all rows of ``each``; values of
    one class only meet nobody and are left out after they have taken their place in the order.
    """
    often = each.groupBy("value").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    ranked = each.join(often, "value").groupBy("digest").agg(
        F.first("n").alias("n"), F.first("size").alias("size"),
        F.sort_array(F.collect_list(F.struct("often", "value"))).alias("values"),  # of one document
        F.sum("often").alias("shared"),
    )
    lone = F.col("size") - F.size("values")
    central = (F.col("shared") + lone) / F.col("size")
    room = F.col("size") - need + 1 - lone  # places left after the lone values
    listed = ranked.withColumn("room", room.cast("int")).where("room > 0").withColumn("central", central)
    placed = listed.select("digest", "n", "central", F.size("values").alias("size"), F.posexplode(F.slice("values", F.lit(1), F.col("room"))).alias("place", "v"))
    return placed.select(F.col("v.value").alias("value"), "digest", "n", "central", (F.col("size") - F.col("place")).cast("long").alias("left"))


def whole_sets(percent: int):
    """Values that a set of n shares with any set it links with."""
    return F.ceil(F.col("n") * percent / 100.0)


def postings(classes: DataFrame, docs: DataFrame, rows: DataFrame, shingle: int, k: int, percent: int) -> DataFrame:
    """Inverted lists (value, digest, n, central, left) that hold a common value of any two classes that may link.

    The lists come from the sketches.  A sketch bound is loose (it allows for chance), so classes made
    mostly of common values, such as a passage in many documents, would fill long lists with pairs that
    never link.  Members of lists longer than ``CROWD`` are therefore listed by their full sets instead,
    where the bound is exact; two linked classes that only meet in a long list are both listed so.

    ``left`` bounds what a class shares with another if the list's value is the first common one: its values from there
    on, where all of its values and of any partner's are in the order, else the whole set.
    """
    each = classes.select("digest", F.col("n_shingles").alias("n"), F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    full = shared_values(k, percent)
    # a set of at most k shingles is its own sketch; so is every set it may link with if it is small enough
    need = (
        F.when(F.col("n") * 100 <= F.lit(k * percent), whole_sets(percent))
        .when(F.col("n") <= F.lit(k), F.least(F.lit(full), whole_sets(percent)))
        .otherwise(F.lit(full))
    )
    known = F.col("n") * 100 <= F.lit(k * percent)  # the class and all its partners are their own sketches
    listed = rarest(each, need).withColumn("left", F.when(known, F.col("left")).otherwise(F.col("n")))
    listed = stage(listed, "sketch-lists")
    members = listed.groupBy("value").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    sized = stage(listed.join(members, "value"), "sized-lists")
    crowded = stage(sized.where(F.col("members") > CROWD).select("digest").distinct(), "crowded")
    sets = full_sets(docs, rows, crowded, shingle, "crowded-sets")
    exact = rarest(shingles_of(sets.join(crowded, "digest", "left_semi")), whole_sets(percent))
    out = stage(sized.where(F.col("members") <= CROWD).select("value", "digest", "n", "central", "left").unionByName(exact), "postings")
    release(listed, sized, crowded, sets)
    return out


def full_sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, n: int, name: str) -> DataFrame:
    """(digest, members) of the wanted classes: the packed shingle hashes, from one document of each class.

    ``rows``: (doc_id, digest).  A repeated doc_id brings texts of other classes along; the digest is
    computed again, and one row per digest is kept.
    """
    sample = rows.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    texts = docs.select("doc_id", "text").join(sample.select("doc_id"), "doc_id", "left_semi")

    def sets(batches):
        for batch in batches:
            for _, some in chunks(utf8(batch.column(1))):
                found = [s for s in shingle_sets(some, n) if len(s)]
                yield pa.record_batch(
                    [
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found], pa.binary()),
                        pa.array([s.tobytes() for s in found], pa.binary()),
                    ],
                    names=["digest", "members"],
                )

    return stage(on_workers(texts).mapInArrow(sets, "digest binary, members binary").dropDuplicates(["digest"]), name)


def shingles_of(sets: DataFrame) -> DataFrame:
    """(digest, n, size, value): one row per member of full sets."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                found = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1).slice(low, 256)]
                sizes = np.array([len(x) for x in found], np.int64)
                digests = batch.column(0).slice(low, 256).take(pa.array(np.repeat(np.arange(len(found)), sizes)))
                each = pa.array(np.repeat(sizes, sizes))
                yield pa.record_batch([digests, each, each, pa.array(np.concatenate(found))], names=["digest", "n", "size", "value"])

    return on_workers(sets).mapInArrow(run, "digest binary, n long, size long, value long")


def _may_link(percent: int):
    """What the classes can share from the list's value on allows the similarity.

    A link needs 100 * shared >= percent * (n_a + n_b - shared).  A pair's first common value passes if the pair
    links, so a pair that fails here is found again or is no link.
    """
    return F.least("left_a", "left_b") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent


def star_pairs(listed: DataFrame, percent: int) -> DataFrame:
    """Every member of a list with the list's most central member.

    Edited copies of a text link with the text far more often than with each other, so the first round joins
    most of a group, whatever its size.
    """
    hub = listed.groupBy("value").agg(F.max(F.struct("central", "digest", "n", "left")).alias("hub"), F.count(F.lit(1)).alias("members"))
    pairs = listed.join(hub.where("members > 1"), "value").select(
        F.col("hub.digest").alias("a"), F.col("hub.n").alias("n_a"), F.col("hub.left").alias("left_a"),
        F.col("digest").alias("b"), F.col("n").alias("n_b"), F.col("left").alias("left_b"),
    )
    return pairs.where((F.col("a") != F.col("b")) & _may_link(percent)).select("a", "b").distinct()


def cross_pairs(listed: DataFrame, component: DataFrame, percent: int) -> DataFrame:
    """Pairs of one list in different components, without those inside the largest one.

    ``component``: (digest, comp); a class outside any link is its own component.
    """
    own = listed.join(component, "digest", "left").withColumn("comp", F.coalesce("comp", F.hex("digest")))
    sizes = own.groupBy("value", "comp").agg(F.count(F.lit(1)).alias("members"))
    main = sizes.groupBy("value").agg(F.max(F.struct("members", "comp")).getField("comp").alias("main"), F.count(F.lit(1)).alias("comps"))
    open_lists = own.join(main.where("comps > 1"), "value")
    left = open_lists.where("comp != main").select("value", F.col("digest").alias("a"), F.col("n").alias("n_a"), F.col("left").alias("left_a"), F.col("comp").alias("comp_a"))
    right = open_lists.select("value", F.col("digest").alias("b"), F.col("n").alias("n_b"), F.col("left").alias("left_b"), F.col("comp").alias("comp_b"), "main")
    # a pair of two outsiders would be made twice: once is enough
    once = (F.col("comp_b") == F.col("main")) | (F.col("a") < F.col("b"))
    pairs = left.join(right, "value").where((F.col("comp_a") != F.col("comp_b")) & once & _may_link(percent))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def estimated(pairs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose union-sketch estimate allows a link.

    The k smallest values of both sketches together are the union's sketch; the share of them
    that both hold estimates the Jaccard similarity.  Two sets of at most k shingles are their
    own sketches: their similarity is counted on the whole sets, without the cut to k values.
    """
    side = classes.select("digest", "sketch", (F.col("n_shingles") <= k).alias("whole"))
    both = pairs.join(side.select(F.col("digest").alias("a"), F.col("sketch").alias("sa"), F.col("whole").alias("wa")), "a").join(
        side.select(F.col("digest").alias("b"), F.col("sketch").alias("sb"), F.col("whole").alias("wb")), "b"
    )
    floor = shared_values(k, percent) / k

    def run(batches):
        for batch in batches:
            sides = []
            for c in ("sa", "sb"):
                lists = batch.column(c)
                sides.append((lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)))
            exact = pc.and_(batch.column("wa"), batch.column("wb")).to_pylist()
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.sort(values[at[i] : at[i + 1]]) for at, values in sides)
                shared = np.intersect1d(x, y, assume_unique=True)
                if exact[i]:
                    keep[i] = 100 * len(shared) >= percent * (len(x) + len(y) - len(shared))
                else:
                    union = np.union1d(x, y)[:k]
                    keep[i] = np.count_nonzero(shared <= union[-1]) >= floor * len(union)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "sa", "sb", "wa", "wb").mapInArrow(run, "a binary, b binary")


def verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets link.  ``rows``: (doc_id, digest), one text per digest is read.

    A set is sent to the groups that need it; a class with very many partners is split into
    groups of about ``VERIFY_MEMBERS``.
    """
    fan = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("fan"))
    dealt = pairs.join(fan, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("fan") / VERIFY_MEMBERS)).cast("int"))
    dealt = stage(dealt.select("a", "b", "salt"), "pairs")
    wanted = dealt.select(F.col("a").alias("digest")).unionAll(dealt.select("b")).distinct()
    full = full_sets(docs, rows, wanted, n, "sets")
    hubs = dealt.select("a", "salt").distinct().join(full.withColumnRenamed("digest", "a"), "a")
    partners = dealt.join(full.withColumnRenamed("digest", "b"), "b")
    together = hubs.select("a", "salt", F.lit(None).cast("binary").alias("b"), "members").unionAll(partners.select("a", "salt", "b", "members"))

    def compare(group: pa.Table) -> pa.Table:
        partner = group.column("b").is_valid()
        own = np.frombuffer(group.filter(pc.invert(partner)).column("members")[0].as_py(), np.uint64)
        others = group.filter(partner)
        keep = []
        for other in others.column("members"):
            them = np.frombuffer(other.as_buffer(), np.uint64)
            at = np.searchsorted(own, them)
            same = int(np.count_nonzero(own[np.minimum(at, len(own) - 1)] == them))
            keep.append(100 * same >= percent * (len(own) + len(them) - same))
        return others.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = stage(together.groupBy("a", "salt").applyInArrow(compare, "a binary, b binary"), "links")
    release(dealt, full)
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node of ``links`` (u, v): comp is the smallest node reachable.

    Large-star joins every larger neighbour to the smallest one, small-star every smaller
    neighbour; both together halve the height of each tree, so a few rounds end it.
    """
    stale = edges = stage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "links")
    mark = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stage(small.select("e.u", "e.v").where("u != v").distinct(), "star")
        release(stale)
        stale = edges
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    )


def near_duplicates(docs: DataFrame, shingle: int, percent: int, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    rows = stage(sketches(docs, shingle, k), "sketches")
    named = rows.where("doc_id is not null and digest is not null")
    # the class's name is its smallest doc_id
    classes = stage(named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "classes")
    ids = named.select("doc_id", "digest")
    listed = postings(classes, docs, ids, shingle, k, percent)
    of = classes.select("digest", "rep")

    # a repeated doc_id can stand in several classes: they are one node
    same = named.select("doc_id", "digest").distinct().join(of, "digest").where("doc_id != rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))

    def to_nodes(pairs: DataFrame) -> DataFrame:
        return pairs.join(of.select(F.col("digest").alias("a"), F.col("rep").alias("u")), "a").join(
            of.select(F.col("digest").alias("b"), F.col("rep").alias("v")), "b"
        ).select("u", "v")

    def links_of(pairs: DataFrame, name: str) -> DataFrame:
        likely = stage(estimated(pairs, classes, k, percent), name)
        links = verified(likely, docs, ids, shingle, percent)
        release(likely)
        return links

    stars = links_of(star_pairs(listed, percent), "star-pairs")
    comp = stage(components(to_nodes(stars).unionAll(same)), "first-components")
    of_class = of.join(comp, F.col("rep") == F.col("node")).select("digest", F.col("comp").cast("string").alias("comp"))
    rest = to_nodes(links_of(cross_pairs(listed, of_class, percent), "cross-pairs"))
    release(stars, listed)
    # the first round's components stand for its links
    whole = components(comp.where("node != comp").select(F.col("node").alias("u"), F.col("comp").alias("v")).unionAll(rest))
    found = rows.select("doc_id", "n_shingles").join(whole, F.col("doc_id") == F.col("node"), "left")
    out = found.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
