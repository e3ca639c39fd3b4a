"""Near-duplicate documents by SuperMinHash, banding, verification and union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.bloom import bloom_bits, may_be_among, might_hold
from runledger.llm.graph import connected_components
from runledger.llm.hashing import chunks, mix, set_digest, shingle_hashes
from runledger.llm.minhash import short_signature, superminhash
from runledger.session import stage

BANDS, ROWS = 24, 5
_DIGEST = ["n_shingles", "d1", "d2"]
_BLOCK = 256
_SLACK = 0.15

_SIGNED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_shingles", pa.int64()),
        ("d1", pa.int64()),
        ("d2", pa.int64()),
        ("signature", pa.binary()),
    ]
)


def sign_documents(docs: DataFrame, k: int) -> DataFrame:
    """Size, digest and signature of each document's set of shingles."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                sets = [np.unique(s) for s in shingle_hashes(texts, k)]
                digests = [set_digest(s) for s in sets]
                signatures = [short_signature(superminhash(s, BANDS * ROWS)) for s in sets]
                yield pa.record_batch(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([d[0] for d in digests], pa.int64()),
                        pa.array([d[1] for d in digests], pa.int64()),
                        pa.array(signatures, pa.binary()),
                    ],
                    schema=_SIGNED,
                )

    schema = "doc_id long, n_shingles long, d1 long, d2 long, signature binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, schema)


def texts_of(docs: DataFrame, nodes: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """One text ``(node, text)`` per set in ``nodes(node)``, without a shuffle of all texts.

    Documents are sought by the id a set was kept under, then held to the set's digest, as
    an id can stand over several texts; texts with the same digest have the same set.
    """
    wanted = stage(nodes.distinct().join(sets.select("node", "id"), "node"), "nodes")
    shared = docs.sparkSession.sparkContext.broadcast(bloom_bits(wanted, F.xxhash64("id")))
    name = F.col("doc_id").cast("long")
    kept = docs.where("doc_id IS NOT NULL").select(name.alias("id"), "text", F.xxhash64(name).alias("hash"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            sought = might_hold(bitmap, batch.column("hash").to_numpy().view(np.uint64))
            for part, texts in chunks(batch.filter(pa.array(sought)).select(["id", "text"])):
                ones = [set_digest(np.unique(s))[0] for s in shingle_hashes(texts, k)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(ones, pa.int64())], names=["id", "text", "node"]
                )

    named = kept.mapInArrow(digest, "id long, text string, node long").join(wanted, ["node", "id"])
    return stage(named.groupBy("node").agg(F.first("text").alias("text")), "texts")


def _nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def verified(
    pairs: DataFrame, docs: DataFrame, sets: DataFrame, k: int, part: tuple[int, int]
) -> DataFrame:
    """Of ``pairs(a, b)`` of sets those that are similar enough, taken whole from their texts."""
    texts = texts_of(docs, _nodes_of(pairs), sets, k)
    num, den = part

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            ids = [batch.column(c).to_pylist() for c in ("a", "b")]
            keep = []
            for at in range(batch.num_rows):
                sets = []
                for side, text in enumerate(("a_text", "b_text")):
                    name = ids[side][at]
                    found = held.get(name) if side == 0 else None
                    if found is None:
                        found = np.unique(shingle_hashes([batch.column(text)[at].as_py()], k)[0])
                        if side == 0:
                            held = {name: found}
                    sets.append(found)
                both = len(np.intersect1d(*sets, assume_unique=True))
                keep.append(den * both >= num * (len(sets[0]) + len(sets[1]) - both) and both > 0)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    b_side = texts.select(F.col("node").alias("b"), F.col("text").alias("b_text"))
    a_side = texts.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
    met = pairs.join(b_side, "b").join(a_side, "a").select("a", "b", "a_text", "b_text")
    return stage(met.mapInArrow(similar, "a long, b long").distinct(), "links")


def _whole_sets(docs: DataFrame, nodes: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """Sorted hashes of the shingles of each set in ``nodes(node)``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                whole = [np.unique(s).tobytes() for s in shingle_hashes(texts, k)]
                yield pa.record_batch(
                    [part.column("node"), pa.array(whole, pa.binary())], names=["node", "members"]
                )

    texts = texts_of(docs, nodes, sets, k)
    return stage(texts.mapInArrow(build, "node long, members binary"), "members")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal ``keys``, whole, however batches cut them."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        columns = [table.column(c).to_numpy() for c in keys]
        change = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            yield table.slice(start, stop - start)
        rest = table.slice(cuts[-1]) if table.num_rows else None
    if rest is not None and rest.num_rows:
        yield rest


def _agreement(signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all pairs of rows: how many values agree, and the first band that does."""
    n = len(signs)
    agree = np.zeros((n, n), dtype=np.int16)
    first = np.full((n, n), BANDS, dtype=np.int16)
    if n * n * signs.shape[1] <= 1 << 18:
        same = signs[:, None, :] == signs[None, :, :]
        bands = same.reshape(n, n, BANDS, ROWS).all(axis=3)
        found = bands.any(axis=2)
        first[found] = bands.argmax(axis=2)[found]
        return same.sum(axis=2, dtype=np.int16), first
    columns = np.ascontiguousarray(signs.T)
    for band in range(BANDS):
        whole = np.ones((n, n), dtype=bool)
        for row in range(ROWS):
            values = columns[band * ROWS + row]
            same = values[:, None] == values[None, :]
            agree += same
            whole &= same
        first[whole & (first == BANDS)] = band
    return agree, first


def _meet(rows: pa.Table, part: tuple[int, int]) -> list[tuple[int, int]]:
    """Links within one pair of blocks that join components, found on whole sets.

    A link joins its components for the pairs after it, so fewer links come out than there
    are rows, however many pairs are similar. Pairs whose signatures agree far less than
    linked ones do are left (see ``near_duplicates``).
    """
    num, den = part
    ids = rows.column("node").to_numpy()
    group = rows.column("component").to_numpy()
    own = rows.column("own").to_numpy()
    band = rows.column("band")[0].as_py()
    blobs = rows.column("signature").to_pylist()
    signs = np.frombuffer(b"".join(blobs), dtype=np.uint16).reshape(len(ids), -1)
    members = [np.frombuffer(x, dtype=np.uint64) for x in rows.column("members").to_pylist()]
    size = np.array([len(x) for x in members])
    agree, first = _agreement(signs)
    least = int((num / den - _SLACK) * signs.shape[1])
    near = (agree >= least) & (first == band) & (group[:, None] != group[None, :])
    near &= den * np.minimum.outer(size, size) >= num * np.maximum.outer(size, size)
    if rows.column("i")[0].as_py() != rows.column("j")[0].as_py():
        near &= own[:, None] != own[None, :]
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    found = []
    for x, y in zip(*(v.tolist() for v in np.nonzero(np.triu(near, 1))), strict=True):
        a, b = top(int(group[x])), top(int(group[y]))
        if a == b:
            continue
        at = np.searchsorted(members[x], members[y])
        at[at == size[x]] = 0
        shared = int((members[x][at] == members[y]).sum())
        if den * shared >= num * (int(size[x] + size[y]) - shared) and shared > 0:
            found.append((int(min(ids[x], ids[y])), int(max(ids[x], ids[y]))))
            root[max(a, b)] = min(a, b)
    return found


def _rest(
    banded: DataFrame,
    sets: DataFrame,
    groups: DataFrame,
    docs: DataFrame,
    k: int,
    part: tuple[int, int],
) -> DataFrame:
    """Links between sets that share a band and lie in different components.

    Only buckets that still span components are looked at. The sets of a bucket's largest
    component and the others are dealt into blocks apart; blocks of others meet all blocks,
    those of the largest component do not meet each other, so a large component with a
    few strangers costs one copy of it per block of strangers. A task holds two blocks
    however large the bucket, and compares a pair in the first band it shares. Whole sets
    are compared where they meet, so what comes out needs no second look at the texts.
    """
    placed = banded.join(groups, "node", "left")
    placed = stage(placed.withColumn("component", F.coalesce("component", "node")), "placed")
    shares = placed.groupBy("band", "key", "component").agg(F.count("*").alias("n"))
    spans = shares.groupBy("band", "key").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("kinds")
    )
    spans = spans.where("kinds > 1").select(
        "band",
        "key",
        F.col("main.component").alias("main"),
        F.ceil((F.col("n") - F.col("main.n")) / _BLOCK).cast("int").alias("others"),
        F.ceil(F.col("main.n") / _BLOCK).cast("int").alias("mains"),
    )
    # Read back, so that the rows of a hot bucket can be split over tasks.
    open_rows = stage(placed.join(stage(spans, "spans"), ["band", "key"]), "open")
    nodes = open_rows.select("node").distinct()
    members = sets.select("node", "signature").join(_whole_sets(docs, nodes, sets, k), "node")
    inner, place = F.col("component") == F.col("main"), F.xxhash64("node")
    own = F.when(inner, F.col("others") + F.pmod(place, "mains")).otherwise(F.pmod(place, "others"))
    last = F.when(inner, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    dealt = open_rows.withColumn("own", own.cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    keys = ["band", "key", "i", "j"]
    dealt = dealt.select(
        "band",
        "key",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        "own",
        "node",
        "component",
    )
    met = dealt.join(stage(members, "signatures"), "node").repartition(*keys).sortWithinPartitions(*keys)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, keys):
            if rows.num_rows > 1:
                found = _meet(rows, part)
                if found:
                    yield pa.record_batch(
                        [pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)],
                        names=["a", "b"],
                    )

    return stage(met.mapInArrow(meet, "a long, b long").distinct(), "rest")


def _grouped(docs: DataFrame, k: int, part: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Signed rows, and every set's digest with its component and the least id under it."""
    docs = docs.select("doc_id", "text")
    signed = stage(sign_documents(docs, k), "signed")
    named = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = named.groupBy(*_DIGEST).agg(
        F.min("doc_id").alias("id"), F.first("signature").alias("signature")
    )
    sets = stage(sets.withColumn("node", F.col("d1")), "sets")
    width = 2 * ROWS
    keys = F.posexplode(
        F.transform(
            F.sequence(F.lit(0), F.lit(BANDS - 1)),
            lambda i: F.xxhash64(i, F.substring(F.col("signature"), i * width + 1, F.lit(width))),
        )
    ).alias("band", "key")
    banded = sets.select("node", keys)
    buckets = banded.groupBy("band", "key").agg(F.min("node").alias("a"), F.count("*").alias("n"))
    buckets = stage(buckets.where("n > 1").drop("n"), "buckets")
    shared = stage(banded.join(buckets, ["band", "key"]).select("band", "key", "a", "node"), "shared")
    star = shared.where("a < node").select("a", F.col("node").alias("b")).distinct()
    star = stage(star, "pairs")
    links = verified(star, docs, sets, k, part)
    groups = stage(connected_components(links), "groups")
    rest = _rest(shared.drop("a"), sets, groups, docs, k, part)
    if rest.limit(1).count():
        groups = stage(connected_components(links.union(rest)), "groups")
    held = sets.drop("signature").join(groups, "node", "left")
    return signed, stage(held.withColumn("component", F.coalesce("component", "node")), "held")


def near_duplicates(
    docs: DataFrame, k: int = 5, part: tuple[int, int] = (4, 5)
) -> DataFrame:
    """The group of near copies each row of ``docs`` belongs to.

    Two documents are linked when ``den * |A & B| >= num * |A | B|`` holds for their sets
    of ``k``-word shingles (``part = (num, den)``). Reads ``doc_id, text``; returns
    ``doc_id, n_shingles, component_id`` (least ``doc_id`` reachable over links) and
    ``kept`` (that is its own), a row for each row. Other columns are not read.

    Documents with equal sets are folded to the least id first. Signatures of 120 values
    are cut into 24 bands of 5; each set of a bucket is verified against the bucket's
    least one, and where a bucket still spans components its sets meet in blocks.
    Verification compares full sets. What banding misses has probability 8e-7 for a pair
    at 0.85 and 8e-5 at 0.8; of the pairs met in blocks those whose signatures agree in
    under the threshold less 0.15 are left, which befalls a pair at the threshold with
    probability below 2e-5 (independent values; those of SuperMinHash vary less).

    A text without words, or null, has no shingle, is linked with nothing and kept. Rows
    that share an id each follow their own text. A row without
    an id cannot be named: its component is null and it is kept. An empty table gives an
    empty result.
    """
    signed, held = _grouped(docs, k, part)
    names = stage(held.groupBy("component").agg(F.min("id").alias("component_id")), "names")
    named_sets = stage(held.join(names, "component").select(*_DIGEST, "component_id"), "named")
    grouped = signed.select("doc_id", *_DIGEST).join(named_sets, _DIGEST, "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == own, F.lit(True))
    return grouped.select(
        "doc_id", "n_shingles", own.alias("component_id"), kept.alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, k: int = 5, part: tuple[int, int] = (4, 5)) -> DataFrame:
    """``docs`` with one row of each group, one with the least id.

    Rows are dropped by id and set of shingles: an id over several texts loses only those
    that are copies, and of rows repeated under one id with one set a single one stays. A
    row without an id stays if no row with an id has its set, one for each set. Texts
    without words are copies of nothing. Only rows that may go are shuffled.
    """
    signed, held = _grouped(docs, k, part)
    first = stage(held.groupBy("component").agg(F.min(F.struct("id", "node")).alias("first")), "first")
    best = held.join(first, "component").select(
        *_DIGEST, F.when(F.col("first.node") == F.col("node"), F.col("id")).alias("keeper")
    )
    counts = signed.where("n_shingles > 0").groupBy("doc_id", *_DIGEST).agg(F.count("*").alias("n"))
    met = counts.join(stage(best.withColumn("known", F.lit(True)), "best"), _DIGEST, "left")
    stays = F.when(F.col("known"), F.coalesce(F.col("doc_id") == F.col("keeper"), F.lit(False))).otherwise(True)
    decided = met.select("doc_id", "d1", "n", stays.alias("stays"))
    decided = stage(decided.where("NOT stays OR n > 1 OR doc_id IS NULL"), "decided")
    name = F.col("doc_id").cast("long")
    # Null ids are suspect; for others a filter on the id decides before any text is looked at.
    known = may_be_among(name, decided.where("doc_id IS NOT NULL"), "doc_id")
    suspect = name.isNull() | F.coalesce(known, F.lit(True))
    suspects = stage(docs.where(suspect).withColumn("__id", name), "suspects")
    suspects = suspects.withColumn("__set", _set_number(k)(F.col("text")))
    verdict = decided.select(
        F.col("doc_id").alias("__doc"), F.col("d1").alias("__d1"), F.col("stays").alias("__stays")
    )
    on = F.col("__id").eqNullSafe(F.col("__doc")) & (F.col("__set") == F.col("__d1"))
    judged = suspects.join(verdict, on, "left")
    clear = judged.where("__stays IS NULL").select(docs.columns)
    single = judged.where("__stays").dropDuplicates(["__id", "__set"]).select(docs.columns)
    return docs.where(~suspect).union(clear).union(single)


def _set_number(k: int):
    """The first number of the digest of a text's set of shingles, null without words."""

    @F.arrow_udf("long")
    def number(texts: pa.Array) -> pa.Array:
        out: list[int | None] = []
        for _, part in chunks(pa.RecordBatch.from_arrays([texts], names=["text"])):
            sets = [np.unique(s) for s in shingle_hashes(part, k)]
            out += [set_digest(s)[0] if len(s) else None for s in sets]
        return pa.array(out, pa.int64())

    return number
