"""N-gram Jaccard join by a token-group matrix.

Two documents link when their sets of five-word shingles have a Jaccard
similarity of at least 80 %. Documents of equal sets form a class with one
representative. Then:

1. Partition similar documents into groups. Representatives that share a minimum
   hash meet the most central of them; those that truly link to it join it. Groups
   are the connected components of these links, cut into pieces of about ``GROUP``
   members.
2. Store each group's token union as a matrix of groups by tokens: an index of
   the tokens in its members' prefixes (the part of a set in which any two linked
   sets share a token, under one order of all tokens) with their places there, and
   a row over hashed token columns that counts, column by column, the most tokens
   of any member.
3. Bound query-group overlap: a query reaches a group of another component by a
   shared prefix token from whose place on both sets still have enough tokens for a
   link, as they have from the first one they share; the sum over columns of the
   smaller of both counts is at least any overlap with a member.
4. Open groups whose bound allows a link: their members are bounded in the same
   way by their own rows, and whole sets are compared where that allows a link.

The order of tokens puts very frequent ones last; which they are only steers the
cost, never the result. Components make pairs inside a group of near copies
needless, so the number of pairs does not grow with the square of its size.

Defined results: a null text, or one without words, has an empty set and links
with nothing; fewer than five words are one shingle; repeated rows are one class;
rows with a null doc_id are returned with a null component and link with nothing;
an empty table gives no rows. Shingles are 64-bit hashes, sets are told apart by a
64-bit hash and their size. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import LOWER, text_bytes

WORDS, PERCENT = 5, 80
#: Members of a group, on average, and minimum hashes by which groups are found.
GROUP, HASHES = 16, 3
#: Tokens in at least LOCAL of the documents that a task works on together are
#: counted, and those of at least OFTEN in all come last in the order of tokens, the
#: most frequent FREQUENT of them at most (3 MB).
LOCAL, OFTEN, FREQUENT = 2, 12, 400_000
#: Sets whose tokens are counted together, and documents handed to Python at a time.
COUNTED, BATCH = 6_000, 1_500
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _mix(x: np.ndarray, k: int = 0) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MUL[1 + k % 3]
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b"\0few " + b" ".join(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    x = h[:n].copy()
    for k in range(1, WORDS):
        x = x * _MUL[0] + h[k:k + n]
    x = np.sort(_mix(x))
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def linked(a: int, b: int, both: int) -> bool:
    """Whether sets of sizes a and b with ``both`` common members link."""
    return both > 0 and 100 * both >= PERCENT * (a + b - both)


def least_overlap(query: int, smallest: int) -> int:
    """Common members that a link of a query with a set of at least this size has."""
    s = max(smallest, -(-query * PERCENT // 100))
    return -(-PERCENT * (query + s) // (100 + PERCENT))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Common members of two sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int(np.count_nonzero(b[at] == a))


def cells(s: np.ndarray) -> np.ndarray:
    """Tokens by hashed column, of which there are a power of two, about a quarter
    of the set's size; 255 stands for more."""
    n = 1 << max(0, (len(s) - 1) // 4).bit_length()
    return np.minimum(np.bincount((s & np.uint64(n - 1)).astype(np.int64), minlength=n), 255).astype(np.uint8)


def wide(row: np.ndarray) -> np.ndarray:
    row = row.astype(np.int64)
    row[row == 255] = 1 << 40
    return row


def bound(a: np.ndarray, b: np.ndarray) -> int:
    """At least the number of common tokens of two rows of the matrix; the longer
    row is folded to the columns of the shorter."""
    n = min(len(a), len(b))
    return int(np.minimum(a.reshape(-1, n).sum(0), b.reshape(-1, n).sum(0)).sum())


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _profile_rows(batches, schema: pa.Schema):
    """A row for each document (frequent = 0), and one for each token that many
    sets of a task have, with their number, counted COUNTED sets at a time."""
    seen, tokens = set(), []
    for batch in batches:
        doc, n, sig, mins, rows = batch.column(0), [], [], [], []
        for t in batch.column(1):
            s = shingles(text_bytes(t.as_py()))
            key = xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0
            n.append(len(s))
            sig.append(key)
            mins.append(_signed([_mix(s ^ _MUL[k], k).min() for k in range(HASHES)]) if len(s) else [])
            rows.append(cells(s).tobytes())
            if len(s) and key not in seen:
                seen.add(key)
                tokens.append(s)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(len(n), np.int64)), doc, pa.array(n, pa.int64()), pa.array(_signed(sig)),
             pa.array(mins, pa.list_(pa.int64())), pa.array(rows, pa.binary())], schema=schema)
        if len(tokens) >= COUNTED:
            yield _frequent_rows(tokens, schema)
            seen, tokens = set(), []
    yield _frequent_rows(tokens, schema)


def _frequent_rows(tokens: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    often, counts = _frequent_of(tokens)
    n = len(often)
    return pa.RecordBatch.from_arrays(
        [pa.array(counts), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(often.view(np.int64)),
         pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.binary())], schema=schema)


def _frequent_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in at least LOCAL sets, counted a range of tokens at a time."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    edges = [k << 61 for k in range(8)] + [(1 << 64) - 1]
    cuts = [np.searchsorted(s, np.array(edges[1:-1], np.uint64)) for s in sets]
    for k in range(8):
        parts = [s[(c[k - 1] if k else 0):(c[k] if k < 7 else len(s))] for s, c in zip(sets, cuts)]
        if parts:
            u, c = np.unique(np.concatenate(parts), return_counts=True)
            keys.append(u[c >= LOCAL])
            counts.append(c[c >= LOCAL])
    return np.concatenate(keys), np.concatenate(counts)


def profiles(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("frequent", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()),
                        ("mins", pa.list_(pa.int64())), ("cells", pa.binary())])
    return docs.mapInArrow(lambda batches: _profile_rows(batches, schema),
                           "frequent long, doc_id long, n long, sig long, mins array<long>, cells binary")


def prefix(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first tokens of a set in the order of all tokens; two sets that link
    share one of them."""
    length = len(s) - -(-PERCENT * len(s) // 100) + 1
    if not len(frequent):
        return s[:length]
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    last = frequent[at] == s
    rare = s[~last][:length]
    return rare if len(rare) == length else np.concatenate([rare, s[last][:length - len(rare)]])


def _prefix_rows(batches, frequent, schema: pa.Schema):
    """(token, doc_id, n, place) of each distinct set of a batch, by its smallest id."""
    often = frequent.value
    for batch in batches:
        best: dict[tuple, tuple] = {}
        for doc, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            s = shingles(text_bytes(t.as_py()))
            if len(s):
                key = (xxhash.xxh3_64_intdigest(s.tobytes()), len(s))
                if key not in best or doc < best[key][0]:
                    best[key] = (doc, prefix(s, often))
        if best:
            parts = [p for _, p in best.values()]
            sizes = [len(p) for p in parts]
            token = _signed(np.concatenate(parts))
            doc = np.repeat([d for d, _ in best.values()], sizes)
            n = np.repeat([k[1] for k in best], sizes)
            place = np.concatenate([np.arange(k) for k in sizes])
            for at in range(0, len(token), 200_000):
                cut = slice(at, at + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(x[cut]) for x in (token, doc, n, place)], schema=schema)


def _shared_rows(batches, schema: pa.Schema):
    """Of rows sorted by token, those whose token the row before or after has."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(c) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate([h[0], c]) for h, c in zip(held, cols)]
            flagged = held[0][1]
        else:
            flagged = False
        same = cols[0][1:] == cols[0][:-1]
        keep = np.zeros(len(cols[0]), bool)
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] |= flagged
        last = bool(keep[-1])
        out = keep[:-1]
        held = [(c[-1:], last) for c in cols]
        yield pa.RecordBatch.from_arrays([pa.array(c[:-1][out]) for c in cols], schema=schema)
    if held is not None and held[0][1]:
        yield pa.RecordBatch.from_arrays([pa.array(h[0]) for h in held], schema=schema)


def shared_prefixes(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """The token-group matrix before its groups are known: prefix tokens that more
    than one document has, as (token, doc_id, n, place)."""
    schema = pa.schema([(c, pa.int64()) for c in ("token", "doc_id", "n", "place")])
    often = docs.sparkSession.sparkContext.broadcast(frequent)
    ddl = "token long, doc_id long, n long, place long"
    rows = docs.mapInArrow(lambda batches: _prefix_rows(batches, often, schema), ddl)
    return rows.repartition("token").sortWithinPartitions("token").mapInArrow(
        lambda batches: _shared_rows(batches, schema), ddl)


def _place(bits: int) -> Column:
    """The bit of a doc_id, counted from 1 as bitmap buckets are."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(bits)) + 1


def _bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    """Bit set of the hashed ids; at most 2**28 bits whatever their number."""
    place = _place(bits)
    rows = (ids.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("b"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m")).collect())
    out = np.zeros(max(1, bits >> 15) * 4096 + 4096, np.uint8)
    for r in rows:
        out[(r["b"] - 1) * 4096:r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)
    return out


def _set_rows(batches, wanted, schema: pa.Schema):
    bits = wanted.value
    for batch in batches:
        at = np.asarray(batch.column(2))
        # bucket k holds the bits from 32768 k + 1 on, counted from 1
        hit = np.nonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)[0]
        for cut in range(0, len(hit), 500):
            rows = hit[cut:cut + 500]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)),
                 pa.array([shingles(text_bytes(batch.column(1)[int(i)].as_py())).tobytes() for i in rows], pa.binary())],
                schema=schema)


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, tokens) for the ids, and for a few others that a fixed-size bit set
    lets pass."""
    ids = materialize(ids, "join-ids")
    bits = 1 << min(28, max(20, math.ceil(math.log2(32 * max(1, ids.count())))))
    wanted = docs.sparkSession.sparkContext.broadcast(_bitmap(ids, bits))
    schema = pa.schema([("doc_id", pa.int64()), ("tokens", pa.binary())])
    place = _place(bits)
    at = (F.bitmap_bucket_number(place) - 1) * 32768 + F.bitmap_bit_position(place)
    return docs.select("doc_id", "text", at.alias("at")).mapInArrow(
        lambda batches: _set_rows(batches, wanted, schema), "doc_id long, tokens binary")


def _open(size: pa.Array, query: pa.Array, group: pa.Array, members: pa.Array) -> pa.Array:
    """For each query the members of its group that it may link with; the group's
    row of the matrix tells whether it needs to be opened."""
    out, last, union, rows, smallest = [], None, None, [], 0
    for n, q, g, m in zip(size.to_pylist(), query, group.to_pylist(), members):
        row = wide(np.frombuffer(q.as_buffer(), np.uint8))
        if g != last:
            last = g
            rows = [(x["doc_id"].as_py(), x["n"].as_py(), wide(np.frombuffer(x["cells"].as_buffer(), np.uint8))) for x in m]
            columns, smallest = min(len(r) for _, _, r in rows), min(x for _, x, _ in rows)
            union = np.max([r.reshape(-1, columns).sum(0) for _, _, r in rows], axis=0)
        found = []
        if bound(row, union) >= least_overlap(n, smallest):
            found = [d for d, x, r in rows if linked(n, x, min(n, x, bound(row, r)))]
        out.append(found)
    return pa.array(out, pa.list_(pa.int64()))


def _same(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether two sets link."""
    sets = ((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(a, b))
    return pa.array([linked(len(x), len(y), common(x, y)) for x, y in sets], pa.bool_())


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """Links (a, b) of the queries in ``pairs`` (doc_id, grp) with the members
    (grp, doc_id) of their groups; ``classes`` has the rows of the matrix."""
    pairs = materialize(pairs, f"{name}-pairs")
    rows = classes.select("doc_id", "n", "cells")
    reached = members.join(pairs.select("grp").distinct(), "grp", "left_semi").join(rows, "doc_id")
    groups = reached.groupBy("grp").agg(F.collect_list(F.struct("doc_id", "n", "cells")).alias("members"))
    asked = pairs.join(rows, "doc_id").join(groups, "grp")
    opened = asked.select(F.col("doc_id").alias("a"), F.arrow_udf(_open, "array<long>")("n", "cells", "grp", "members").alias("found"))
    likely = materialize(opened.select("a", F.explode("found").alias("b")).filter("a <> b").distinct(), f"{name}-likely")
    ids = likely.select(F.col("a").alias("doc_id")).unionByName(likely.select(F.col("b").alias("doc_id"))).distinct()
    sets = materialize(sets_of(docs, ids), f"{name}-sets")
    both = (likely.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("s")), "a")
            .join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("t")), "b"))
    return materialize(both.filter(F.arrow_udf(_same, "boolean")("s", "t")).select("a", "b"), f"{name}-links")


def components(links: DataFrame) -> DataFrame:
    """(doc_id, component) of every document in a link: alternating large-star and
    small-star steps until every document points at the smallest of its component."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(),
                        "join-edges")
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            break
        mark = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                             F.col("m").alias("v")).filter("u <> v")
        edges = materialize(small.distinct(), "join-edges")
    roots = edges.select(F.col("v").alias("doc_id")).distinct().withColumn("component", F.col("doc_id"))
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component")).unionByName(roots)


def _fits(a: Column, b: Column) -> Column:
    """Whether sets of sizes a and b may link."""
    return (100 * F.least(a, b)) >= (PERCENT * F.greatest(a, b))


def _may_link(a: Column, at: Column, b: Column, bt: Column) -> Column:
    """Whether sets of sizes a and b may link whose first common token has the places
    at and bt: what follows these, they included, must hold a link's overlap."""
    return ((100 + PERCENT) * F.least(a - at, b - bt)) >= (PERCENT * (a + b))


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id of the same set) and
    component_id (smallest doc_id reachable by links) of every document."""
    conf = docs.sparkSession.conf
    before = conf.get(BATCH_CONF)
    conf.set(BATCH_CONF, str(BATCH))  # every Python step below runs before the return
    try:
        return _classes(docs)
    finally:
        conf.set(BATCH_CONF, before)


def _classes(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keyed = docs.filter("doc_id is not null")
    table = materialize(profiles(docs), "join-profiles")
    rows = table.filter("frequent = 0").drop("frequent")
    usable = rows.filter("n > 0 and doc_id is not null")
    classes = materialize(usable.groupBy("sig", "n").agg(F.min("doc_id").alias("doc_id"), F.min("mins").alias("mins"),
                          F.min("cells").alias("cells")), "join-classes")

    # token-group matrix over prefixes
    often = table.filter("frequent > 0").groupBy(F.col("sig").alias("token")).agg(F.sum("frequent").alias("c"))
    often = often.filter(F.col("c") >= OFTEN).orderBy(F.desc("c"), "token").limit(FREQUENT).toArrow()
    frequent = np.sort(np.asarray(often["token"].combine_chunks()).view(np.uint64))
    matrix = materialize(shared_prefixes(keyed, frequent), "join-matrix")

    # groups of similar documents around hubs; the hub is the most central one, with
    # the largest share of prefix tokens that others have too
    length = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    shared = matrix.groupBy("doc_id").agg(F.count_distinct("token").alias("shared"))
    central = classes.join(shared, "doc_id").withColumn("central", F.col("shared") / length)
    minimal = central.select("doc_id", "n", "central", F.posexplode("mins").alias("k", "h"))
    hubs = (minimal.groupBy("k", "h").agg(F.min(F.struct((-F.col("central")).alias("c"), "doc_id", "n")).alias("hub"),
                                          F.count(F.lit(1)).alias("c")).filter("c > 1"))
    near = (minimal.join(hubs.drop("c"), ["k", "h"]).filter(F.col("hub.doc_id") != F.col("doc_id")).filter(_fits(F.col("n"), F.col("hub.n")))
            .select("doc_id", F.col("hub.doc_id").alias("grp")).distinct())
    alone = classes.select(F.col("doc_id").alias("grp"), "doc_id")
    first = verified(keyed, classes, near, alone, "join-hub")
    grouped = materialize(components(first), "join-components")

    # queries and the groups they reach
    ids = usable.select("doc_id", "sig", "n").join(
        classes.select("sig", "n", F.col("doc_id").alias("class_id")), ["sig", "n"]).select("doc_id", "class_id").distinct()
    ids = materialize(ids, "join-ids-of-classes")
    pieces = grouped.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP)).alias("pieces"))
    placed = grouped.join(pieces, "component").select(
        F.col("doc_id").alias("class_id"), "component", F.pmod(F.xxhash64("doc_id"), F.col("pieces")).alias("piece"))
    where = ids.join(placed, "class_id", "left").select(
        "doc_id", "class_id", F.coalesce("component", "class_id").alias("component"), F.coalesce("piece", F.lit(0)).alias("piece"))
    where = materialize(where, "join-groups")
    cells = materialize(matrix.join(where, "doc_id").select(
        "token", "n", "place", "class_id", "component", F.xxhash64("component", "piece").alias("grp")).distinct(), "join-cells")
    left = cells.select("token", F.col("n").alias("qn"), F.col("place").alias("qp"), F.col("class_id").alias("doc_id"),
                        F.col("component").alias("qc"))
    reached = left.join(cells.select("token", "n", "place", "component", "grp").distinct(), "token").filter(
        (F.col("qc") > F.col("component")) & _may_link(F.col("qn"), F.col("qp"), F.col("n"), F.col("place"))
    ).select("doc_id", "grp").distinct()
    members = where.filter("doc_id = class_id").select(F.xxhash64("component", "piece").alias("grp"), "doc_id").distinct()
    second = verified(keyed, classes, reached, members, "join-group")

    final = components(first.unionByName(second)).select(F.col("doc_id").alias("class_id"), F.col("component").alias("component_id"))
    named = ids.join(final, "class_id", "left").select("doc_id", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    # a doc_id whose rows have different texts is one document: the smallest counts
    named = named.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.min("component_id").alias("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles")).join(named, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("component_id", "doc_id").alias("component_id"))
