"""Near duplicates: an n-gram Jaccard join through a token-group matrix.

Documents are sets of hashed word shingles.  Only the rare end of each set (its prefix) is shuffled: two
sets that are similar enough must share enough of their prefixes.  First every token points its holders
at one leading set, which costs one pair per holder however common the token is; verified pairs form
groups of similar documents.  Then the matrix of tokens and groups bounds how much a document can
overlap any member of another group, and only groups whose bound qualifies are opened.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableprep.llm.common import LOWER, NOT_SPACE, Chunk, Rolling, annotate, chunks, mix
from tableprep.session import scratch_scope, written

WIDTH = 5  # words in a shingle
# Similarity 3/4: sets x, y are linked when 4 * common >= 3 * (|x| + |y| - common).
SAMPLE_DOCS = 10_000  # documents whose shingles tell which are frequent, at least
SAMPLE_SHARE = 5  # one document of so many, where that is more
FREQUENT = 1_000_000  # most shingles remembered as frequent
HUBS = 8  # foremost holders of a token that sets of other groups are held against
SEEN_SETS = 500_000  # ids of sets that a task remembers
SALTS = 64  # parts a frequent token's holders are dealt over
BROADCAST_IDS = 2_000_000
HASH_BITS = 57


def shingle_sets(chunk: Chunk) -> list[np.ndarray]:
    """Distinct shingle hashes of every text, ascending."""
    data, texts = LOWER[chunk.data], len(chunk.texts)
    starts, ends, owner = chunk.words(NOT_SPACE)
    words = Rolling(data).of(starts, ends)
    counts = np.bincount(owner, minlength=texts)
    first = np.cumsum(counts) - counts
    # full windows, and the whole sequence of shorter texts
    at = np.flatnonzero(np.arange(len(words)) + WIDTH <= (first + counts)[owner]) if len(words) else np.zeros(0, np.int64)
    values = sequence_hash(words, at, WIDTH)
    short = {}
    for length in range(1, WIDTH):
        whole = np.flatnonzero(counts == length)
        short.update(zip(whole.tolist(), sequence_hash(words, first[whole], length)))
    ends = np.cumsum(np.maximum(counts - WIDTH + 1, 0))
    sets = [np.unique(part) for part in np.split(values, ends[:-1])] if texts else []
    for k, value in short.items():
        sets[k] = np.array([value], dtype=np.uint64)
    return sets


def sequence_hash(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    value = np.full(len(at), length, dtype=np.uint64)
    for step in range(length):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + words[at + step])
    return value


class Order:
    """The global order of tokens: rare ones first, frequent ones by their count in a sample."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.counts = tokens[order], counts[order]

    def ranks(self, values: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(values), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.tokens, values), len(self.tokens) - 1)
        return np.where(self.tokens[at] == values, self.counts[at], 0)

    def describe(self, values: np.ndarray) -> tuple[int, np.ndarray, int]:
        """A set's id, its prefix, and how many tokens of the prefix are rare; those come first.

        The id starts with the number of rare tokens, on a log scale, so that the smallest id among
        similar sets is the one that has least of its own: the text the others are copies of.
        """
        n = len(values)
        ranks = self.ranks(values)
        rare = values[ranks == 0]
        size = n - (3 * n + 3) // 4 + 1
        prefix = rare[:size]
        if len(prefix) < size:
            often = np.flatnonzero(ranks)
            order = often[np.argsort(ranks[often], kind="stable")]
            prefix = np.concatenate([prefix, values[order[: size - len(prefix)]]])
        digest = int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little")
        own = min(63, int(8 * math.log2(1 + len(rare))))
        sid = own << HASH_BITS | (digest >> (64 - HASH_BITS))
        return sid, prefix, min(size, len(rare))


def frequent_tokens(docs: DataFrame, sample: int = SAMPLE_DOCS) -> Order:
    """Tokens that more than one text of a sample of documents holds.

    The order only steers which tokens serve as prefixes: any order gives the same links.  The sample grows
    with the documents, so that the holders of a token that it misses do not.  Copies of a text count once:
    they add no sets that hold its shingles, and would use up ``FREQUENT``.
    """
    rows = docs.count()
    share = min(1.0, max(sample / max(rows, 1), 1 / SAMPLE_SHARE)) if sample else 0.0
    picked = docs.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, chunk in chunks(batch.column(0).cast(pa.binary()).to_pylist(), 1 << 20):
                tokens, n = np.unique(np.concatenate([*shingle_sets(chunk), np.zeros(0, np.uint64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

    counted = picked.select("text").dropDuplicates().mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.where("n > 1").orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    return Order(top["token"].to_numpy().view(np.uint64), top["n"].to_numpy())


def set_table(docs: DataFrame, shared) -> DataFrame:
    """``doc_id, key, n_shingles, sid, n_rare, prefix`` per document; no id where the set is empty."""

    def compute(texts):
        counts, sids, rare, prefixes = [], [], [], []
        for _, _, chunk in chunks(texts):
            for values in shingle_sets(chunk):
                sid, prefix, n_rare = shared.value.describe(values) if len(values) else (None, values, 0)
                counts.append(len(values))
                sids.append(sid)
                rare.append(n_rare)
                prefixes.append(prefix.view(np.int64))
        return [counts, sids, rare, lists_of(prefixes)]

    made = annotate(docs, "text", "n_shingles long, sid long, n_rare int, prefix array<long>", compute)
    return made.drop("text")


def lists_of(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)])))


def full_sets(docs: DataFrame, wanted: DataFrame, shared) -> DataFrame:
    """``sid, n, tokens`` of the sets whose representing texts are ``wanted`` (by ``key``)."""

    def compute(texts):
        sets = [values for _, _, chunk in chunks(texts) for values in shingle_sets(chunk)]
        sids = [shared.value.describe(values)[0] if len(values) else None for values in sets]
        return [sids, [len(values) for values in sets], lists_of([values.view(np.int64) for values in sets])]

    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    chosen = docs.select("key", "text").join(F.broadcast(wanted) if few else wanted, "key", "left_semi")
    sets = annotate(chosen, "text", "sid long, n int, tokens array<long>", compute).select("sid", "n", "tokens")
    return sets.where("sid IS NOT NULL")


def least_common(x: Column, y: Column) -> Column:
    """Tokens that sets of these sizes must share to be linked."""
    return F.ceil((x + y) * 3 / F.lit(7))


def least_in_prefix(x: Column, y: Column) -> Column:
    """Of these, how many must lie in both prefixes: tokens outside of them number under 3/4 of a set."""
    outside = F.greatest(F.ceil(x * 3 / F.lit(4)), F.ceil(y * 3 / F.lit(4))) - 1
    return F.greatest(F.lit(1), least_common(x, y) - outside)


def sizes_fit(x: Column, y: Column) -> Column:
    return (4 * x >= 3 * y) & (4 * y >= 3 * x)


def reach_of(n: Column, at: Column) -> Column:
    """The most tokens of a set that may have its first token in common with this one at position ``at``.

    From there on a set of ``n`` has ``n - at`` tokens, and must have ``least_common`` of them in common.  So
    sets linked by a token that is the first both hold are each within the other's reach.
    """
    return F.floor((4 * n - 7 * at) / F.lit(3)).cast("int")


def once_per_task(sets: DataFrame) -> DataFrame:
    """The rows without those whose set the same task has seen: copies need no tokens, they meet again by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            new = []
            for i, sid in enumerate(batch.column(0).to_pylist()):
                if sid not in seen:
                    seen.add(sid)
                    new.append(i)
            if len(seen) > SEEN_SETS:  # bounds memory; copies that slip through are only extra work
                seen.clear()
            yield batch.take(pa.array(new, type=pa.int64()))

    return sets.mapInArrow(run, sets.schema)


def active_tokens(sets: DataFrame) -> DataFrame:
    """Prefix tokens of two or more different sets: ``token, sid, n, reach, leader``, each once.

    Tokens are dealt once, frequent ones over several parts.  The parts of a frequent token are brought
    together as one row each; there are no more of those tokens than ``FREQUENT``.
    """
    own = sets.where("sid IS NOT NULL").select("sid", F.col("n_shingles").cast("int").alias("n"), "n_rare", "prefix")
    spread = once_per_task(own).select("sid", "n", "n_rare", F.posexplode("prefix").alias("at", "token"))
    frequent = F.col("at") >= F.col("n_rare")
    salt = F.when(frequent, F.pmod("sid", F.lit(SALTS))).otherwise(0)
    reach = reach_of(F.col("n"), F.col("at")).alias("reach")
    dealt = spread.select("token", salt.alias("salt"), frequent.alias("frequent"), "sid", "n", reach)
    holders = Window.partitionBy("token", "salt")
    met = dealt.withColumns({"low": F.min("sid").over(holders), "high": F.max("sid").over(holders)})
    met = written(met.where("frequent OR low < high").drop("salt"), "met")
    ends = met.where("frequent").groupBy("token").agg(F.min("low").alias("leader"), F.max("high").alias("last"))
    ends = written(ends.where("leader < last").drop("last"), "leaders")
    often = met.where("frequent").join(F.broadcast(ends), "token").select("token", "sid", "n", "reach", "leader")
    rare = met.where("NOT frequent").select("token", "sid", "n", "reach", F.col("low").alias("leader"))
    return rare.unionAll(often).distinct()


def links_to(pairs: DataFrame, docs: DataFrame, representing: DataFrame, shared) -> DataFrame:
    """Those of the candidate pairs (``a, b``) whose sets are similar enough."""
    ids = pairs.select(F.col("a").alias("sid")).unionAll(pairs.select(F.col("b").alias("sid"))).distinct()
    wanted = written(ids.join(representing, "sid").select("key"), "wanted")
    sets = written(full_sets(docs, wanted, shared).dropDuplicates(["sid"]), "sets")
    left = sets.select(F.col("sid").alias("a"), F.col("n").alias("a_n"), F.col("tokens").alias("a_tokens"))
    right = sets.select(F.col("sid").alias("b"), F.col("n").alias("b_n"), F.col("tokens").alias("b_tokens"))
    met = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return met.where(4 * common >= 3 * (F.col("a_n") + F.col("b_n") - common)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``sid, label``: the smallest id in the component of every set that has a link.

    Edges are rewritten to point at smaller ids until they form stars (large-star, small-star).
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        # no edge changed when neither their number nor the mix of their hashes did: they are stars
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("mix")).first()
        if now["n"] == 0 or before is not None and now["n"] == before["n"] and now["mix"] == before["mix"]:
            break
        before = now
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        star = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
        edges = written(star.where("u <> v").distinct(), "edges")
    return edges.select(F.col("u").alias("sid"), F.col("v").alias("label")).unionAll(
        edges.select(F.col("v").alias("sid"), F.col("v").alias("label")).distinct()
    )


def in_groups(active: DataFrame, labels: DataFrame) -> DataFrame:
    """``token, sid, n, reach, label`` of tokens that several groups hold; a set without links is its own group."""
    grouped = active.select("token", "sid", "n", "reach").join(labels, "sid", "left")
    grouped = written(grouped.withColumn("label", F.coalesce("label", "sid")), "grouped")
    mixed = grouped.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return written(grouped.join(mixed.select("token"), "token", "left_semi"), "mixed")


def to_hubs(mixed: DataFrame) -> DataFrame:
    """Pairs of sets with one or two of the ``HUBS`` foremost holders of their tokens, in other groups.

    These settle most of what is still apart; nothing depends on which they are.
    """
    foremost = F.row_number().over(Window.partitionBy("token").orderBy("sid"))
    hubs = mixed.withColumn("at", foremost).where(F.col("at") <= HUBS)
    hubs = hubs.select("token", F.col("sid").alias("b"), F.col("n").alias("b_n"), F.col("label").alias("b_label"))
    met = mixed.withColumnsRenamed({"sid": "a", "n": "a_n"}).join(hubs, "token")
    met = met.where((F.col("label") != F.col("b_label")) & sizes_fit(F.col("a_n"), F.col("b_n")))
    counted = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"))
    likely = counted.where(F.col("shared") >= least_in_prefix(F.col("a_n"), F.col("b_n")))
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("shared"), "b"))
    return likely.withColumn("at", best).where("at <= 2").select("a", "b")


def least_in_any_prefix(x: Column, low: Column, high: Column) -> Column:
    """The smallest ``least_in_prefix`` of a set with sets of ``low`` to ``high`` tokens.

    It grows with the other set's size up to the set's own and falls from there; as it is rounded, it can
    be lower up to six sizes before the end.
    """
    last = [F.greatest(low, high - k) for k in range(7)]
    return F.least(least_in_prefix(x, low), *[least_in_prefix(x, y) for y in last])


def to_groups(mixed: DataFrame) -> DataFrame:
    """Pairs of sets with the members of groups that the matrix of tokens and groups lets them open.

    A set meets a group by the tokens that can be the first it has in common with a member: each within
    the other's ``reach``.  Without that column any token of a prefix can be the first.
    """
    if "reach" not in mixed.columns:
        mixed = mixed.withColumn("reach", reach_of(F.col("n"), F.lit(0)))
    matrix = mixed.groupBy("token", F.col("label").alias("group")).agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max("reach").alias("far"),
        F.min("sid").alias("first"), F.max("sid").alias("last"), F.count(F.lit(1)).alias("held"),
    )
    # most groups are one set, which names them
    matrix = written(matrix.withColumns({c: F.nullif(F.col(c), F.col("group")) for c in ("first", "last")}), "matrix")
    n, least, most = F.col("n"), F.col("least"), F.col("most")
    may_fit = (4 * most >= 3 * n) & (4 * n >= 3 * least)
    may_start = (least <= F.col("reach")) & (n <= F.col("far"))
    met = mixed.join(matrix, "token").where((F.col("label") < F.col("group")) & may_start & may_fit)
    met = met.groupBy("sid", "group").agg(
        F.first("n").alias("n"), F.max("most").alias("most"),
        F.min(F.coalesce("first", "group")).alias("first"), F.max(F.coalesce("last", "group")).alias("last"),
    )
    met = written(met, "met_groups")
    # where one member alone holds the tokens that they meet by, it is the only one that can be linked
    alone = F.col("first") == F.col("last")
    direct = met.where(alone).select(F.col("sid").alias("a"), F.col("first").alias("b"), F.col("n").alias("a_n"), F.col("most").alias("b_n"))
    several = met.where(~alone).select("sid", "group")
    cells = matrix.drop("first", "last", "far")
    shared = mixed.select("token", "sid", "n").join(several, "sid").join(cells, ["token", "group"]).where(may_fit)
    bounds = shared.groupBy("sid", "group").agg(
        F.count(F.lit(1)).alias("shared"), F.first("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")
    )
    low, high = F.greatest(least, F.ceil(n * 3 / F.lit(4))), F.least(most, F.floor(n * 4 / F.lit(3)))
    opened = bounds.withColumn("spare", F.col("shared") - least_in_any_prefix(n, low, high)).where("spare >= 0")
    opened = written(opened.select("sid", "group", "spare"), "opened")
    # A member must hold ``needed`` of the shared tokens, so one of any ``spare + 1``: the rarest in the group.
    asked = mixed.select("token", "sid", "n").join(opened, "sid").join(cells, ["token", "group"]).where(may_fit)
    rarest = F.row_number().over(Window.partitionBy("sid", "group").orderBy("held", "token"))
    asked = asked.withColumn("at", rarest).where("at <= spare + 1").select("token", "group", F.col("sid").alias("a"), F.col("n").alias("a_n"))
    members = mixed.select("token", F.col("label").alias("group"), F.col("sid").alias("b"), F.col("n").alias("b_n"))
    inside = asked.join(members, ["token", "group"]).where(sizes_fit(F.col("a_n"), F.col("b_n")))
    pairs = written(inside.select("a", "b", "a_n", "b_n").distinct().unionAll(direct), "inside")
    # what both hold, from the prefixes' shared tokens as lists
    lists = mixed.groupBy("sid").agg(F.collect_list("token").alias("tokens"))
    both = pairs.join(lists.toDF("a", "a_tokens"), "a").join(lists.toDF("b", "b_tokens"), "b")
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return both.where(common >= least_in_prefix(F.col("a_n"), F.col("b_n"))).select("a", "b")


def similar_sets(active: DataFrame, docs: DataFrame, representing: DataFrame, shared) -> DataFrame:
    """``sid, label`` of the sets that have links: sets connected by similarity share a label.

    Every set is first held against the leading set of each of its tokens; sets that this leaves in
    different groups, against a few foremost holders; what is then still apart, against all groups.
    """
    sizes = active.groupBy("sid").agg(F.first("n").alias("b_n")).withColumnRenamed("sid", "b")
    stars = active.where("sid <> leader").groupBy(F.col("sid").alias("a"), F.col("leader").alias("b")).agg(
        F.count(F.lit(1)).alias("shared"), F.first("n").alias("a_n")
    )
    likely = (F.col("shared") >= least_in_prefix(F.col("a_n"), F.col("b_n"))) & sizes_fit(F.col("a_n"), F.col("b_n"))
    pairs = written(stars.join(sizes, "b").where(likely).select("a", "b"), "stars")
    links = written(links_to(pairs, docs, representing, shared), "links")
    labels = components(links)
    mixed = in_groups(active, labels)
    for candidates in (to_hubs, to_groups):
        pairs = written(candidates(mixed), "pairs")
        if not pairs.isEmpty():
            links = written(links.unionAll(links_to(pairs, docs, representing, shared)), "links")
            labels = components(links)
            mixed = in_groups(active, labels) if candidates is to_hubs else mixed
    return labels


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id, key, n_shingles, label, component_id, stays``: ``stays`` marks one text of each component."""
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent_tokens(own))
    with scratch_scope(spark) as keep:  # prefixes are many times larger than what comes of them
        table = written(set_table(own, shared), "prefixes")
        sets = keep(written(table.select("doc_id", "key", "n_shingles", "sid"), "sets"))
        active = keep(written(active_tokens(table), "active"))
    representing = sets.where("sid IS NOT NULL").groupBy("sid").agg(F.min("key").alias("key"))
    with scratch_scope(spark) as keep:
        labels = keep(written(similar_sets(active, own, representing, shared), "labels"))
    shared.destroy()  # all that was made with the order is written
    named = sets.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    head = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("head")
    heads = named.where("label IS NOT NULL").groupBy("label").agg(head, F.count(F.lit(1)).alias("rows")).where("rows > 1")
    first = F.coalesce(F.col("head.doc_id"), F.col("doc_id")).alias("component_id")
    is_head = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & F.col("key").eqNullSafe(F.col("head.key"))
    met = named.join(heads.drop("rows"), "label", "left")
    return met.select("doc_id", "key", "n_shingles", "label", first, (F.col("head").isNull() | is_head).alias("stays"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document.

    Words are runs of non-spaces, lower-cased A-Z; a set holds the distinct 5-word shingles, or the whole
    sequence of a shorter text.  Null and empty texts have empty sets and stay alone, with their own id
    as component.  Documents with equal sets are linked.  A component is named by its smallest doc_id;
    rows that repeat a doc_id are judged by their texts; null ids never name a component others are in.
    Other columns are not read.  Shingles are told apart by 64-bit hashes, sets by 57-bit ones.
    """
    return judged(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component with all its columns: the one with the smallest doc_id.

    Of rows that repeat it, id and text, one stays.  A component without any id keeps one text.  Empty
    texts are components of their own and stay.
    """
    found = written(judged(docs), "near_duplicates")
    gone = written(found.where("NOT stays").select("doc_id", "key").distinct(), "gone")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    key = F.xxhash64(docs["text"])

    def same(other: DataFrame) -> Column:
        return docs["doc_id"].eqNullSafe(other["doc_id"]) & (key == other["key"])

    left = docs.join(F.broadcast(gone) if few else gone, same(gone), "left_anti")
    again = found.where("stays AND label IS NOT NULL").groupBy("doc_id", "key").count().where("count > 1")
    again = written(again.select("doc_id", "key"), "again")
    if again.isEmpty():
        return left
    once = left.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, same(again), "left_anti").unionAll(once)
